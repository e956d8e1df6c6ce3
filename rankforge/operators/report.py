"""Report rows: evidence, highlights, data quality, depth, and short wordings of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, half_up

#: Fixed value: the order in which a business's signals are shown.
SIGNAL_ORDER = ("momentum", "offer", "hiring", "risk", "change", "social")


def evidence(audits: DataFrame, follows: DataFrame) -> DataFrame:
    """(id, ord, kind, confidence, url): the homepage high, linked pages medium, failed ones low.

    audits: id, url, status (an unavailable audit with a url has one low row); follows: id, ord, url, failed.
    """
    down = F.col("status") == "unavailable"
    home = audits.where("url IS NOT NULL").select("id", F.lit(0).alias("ord"), F.when(down, "failed_audit").otherwise("homepage").alias("kind"), F.when(down, "low").otherwise("high").alias("confidence"), "url")
    more = follows.select("id", "ord", F.lit("linked_page").alias("kind"), F.when(F.col("failed"), "low").otherwise("medium").alias("confidence"), "url")
    return home.unionByName(more)


#: What an audit measures, and the type of each.
METRICS = {
    **dict.fromkeys(("h1_count", "heading_count", "word_count", "cta_count", "html_bytes", "fetch_ms", "website_score", "seo", "conversion", "trust", "content", "technical"), "int"),
    **dict.fromkeys(("has_phone", "has_email", "has_contact", "has_booking", "has_pricing", "has_services", "has_about", "has_blog", "has_careers", "has_testimonials", "has_trust", "has_gallery", "has_social", "has_viewport", "is_https"), "boolean"),
}


def failed_audits(failures: DataFrame) -> DataFrame:
    """Adds audit_status ``unavailable``, every one of METRICS as null, no links, and evidence: one item of low confidence if the audit had a source.

    failures: url, reason, reason_code, source_ids and what else names the audit. Null or empty source_ids: no evidence. A row
    that failed has no zeros, so no mean or score counts it.
    """
    some = F.coalesce(F.size("source_ids") > 0, F.lit(False))
    item = F.struct(F.concat(F.lit("No audit of the website: "), F.coalesce("reason", F.lit("unknown")), F.lit(".")).alias("claim"), F.col("url").alias("source_url"), F.lit("homepage").alias("source_type"), F.col("source_ids"), F.lit("low").alias("confidence"))
    out = failures.withColumns({"audit_status": F.lit("unavailable"), **{m: F.lit(None).cast(t) for m, t in METRICS.items()}})
    return out.withColumns({"links": F.lit(None).cast("array<string>"), "evidence": F.filter(F.array(item), lambda _: some)})


def audit_status(follows: DataFrame) -> DataFrame:
    """(id, status): partial if a followed page failed."""
    return follows.groupBy("id").agg(F.when(F.bool_or("failed"), "partial").otherwise("complete").alias("status"))


def join_audits(candidates: DataFrame, audits: DataFrame) -> DataFrame:
    """Candidates with their audits; a missing one has null metrics and a reason by case."""
    j = candidates.join(audits, ["market_id", "id"], "left")
    reason = F.when(F.col("audit_status").isNotNull(), None).when(F.col("website").isNull(), "no_website").when(F.col("is_chain"), "chain").otherwise("not_selected")
    return j.withColumn("audit_reason", reason).withColumn("audit_status", F.coalesce("audit_status", F.lit("unavailable")))


def highlights(ranked: DataFrame, signals: DataFrame, most: int = 5) -> DataFrame:
    """(market_id, place, id, signal): the first scored competitors with the first signal they have by category."""
    order = F.array_position(F.array(*[F.lit(s) for s in SIGNAL_ORDER]), F.col("category"))
    first = signals.withColumn("_o", order).where("_o > 0").groupBy("market_id", "id").agg(F.min_by("label", F.struct("_o", "label")).alias("signal"))
    shown = F.col("scored") & ~F.col("is_user")
    # filtered after the window: before it, the optimizer would copy the whole score expression into the filter
    place = F.row_number().over(Window.partitionBy("market_id").orderBy(F.desc(shown), F.desc("final_score"), "id"))
    top = ranked.withColumn("place", place).where((F.col("place") <= most) & shown)
    return top.join(first, ["market_id", "id"], "left").select("market_id", "place", "id", "signal")


def data_quality(records: DataFrame) -> DataFrame:
    """Per market: failed and partial audits, and which inputs any business lacks, in the order of the columns named ``p_``.

    records: market_id, audit_status and the p_ inputs.
    """
    inputs = [c for c in records.columns if c.startswith("p_")]
    lacking = F.array_compact(F.array(*[F.when(F.count_if(F.col(c).isNull()) > 0, c[2:]) for c in inputs]))
    g = records.groupBy("market_id").agg(F.count_if(F.col("audit_status") == "unavailable").alias("failed"), F.count_if(F.col("audit_status") == "partial").alias("partial"), F.count("*").alias("n"), lacking.alias("unavailable_fields"))
    return g.withColumn("coverage", F.when(F.col("failed") == 0, "full").when(F.col("failed") < F.col("n"), "limited").otherwise("none"))


def report_depth(counts: DataFrame) -> DataFrame:
    """Adds deep: at least ten sources, two ranked, three competitors and a recommendation."""
    return counts.withColumn("deep", (F.col("n_sources") >= 10) & (F.col("n_ranked") >= 2) & (F.col("n_competitors") >= 3) & (F.col("n_recommendations") >= 1))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))


def market_names(names: DataFrame, most: int = 3) -> DataFrame:
    """(market_id, names): the first ``most`` names of each market in words and how many more; no market is gathered whole."""
    n = F.row_number().over(Window.partitionBy("market_id").orderBy("name"))
    top = names.withColumn("_n", n).where(F.col("_n") <= most + 1).groupBy("market_id").agg(F.sort_array(F.collect_list("name")).alias("ns"))
    total = names.groupBy("market_id").agg(F.count("*").alias("n"))
    more = F.concat(F.array_join(F.slice("ns", 1, most), ", "), F.lit(" and "), (F.col("n") - most).cast("string"), F.lit(" more"))
    return top.join(total, "market_id").select("market_id", F.when(F.col("n") <= most, list_names(F.col("ns"), most)).otherwise(more).alias("names"))


def distance_range(records: DataFrame) -> DataFrame:
    """(market_id, distances): the nearest and the farthest finite distance in words, one number if both read alike; null without any."""
    km = lambda c: F.when(c < 10, F.format_string("%.1f", half_up(c, 1))).otherwise(half_up(c).cast("string"))
    g = records.groupBy("market_id").agg(F.min(finite(F.col("distance_km"))).alias("a"), F.max(finite(F.col("distance_km"))).alias("b"))
    a, b = km(F.col("a")), km(F.col("b"))
    return g.select("market_id", F.when(a == b, F.concat(a, F.lit(" km"))).otherwise(F.concat(a, F.lit("–"), b, F.lit(" km"))).alias("distances"))


def list_names(names: Column, most: int = 3) -> Column:
    """a, a and b, or a, b and n more."""
    n = F.size(names)
    return F.when(n == 0, "").when(n == 1, F.get(names, F.lit(0))).when(n <= most, F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.get(names, n - 1))).otherwise(F.concat(F.array_join(F.slice(names, 1, most), ", "), F.lit(" and "), (n - most).cast("string"), F.lit(" more")))


def metric(value: Column, suffix: str = "", signed: bool = False) -> Column:
    sign = F.when(F.lit(signed) & (value > 0), "+").otherwise("")
    return F.coalesce(F.concat(sign, value.cast("string"), F.lit(suffix)), F.lit("N/A"))


def rank_text(rank: Column, tied: Column) -> Column:
    return F.coalesce(F.concat(F.when(tied, "tied #").otherwise("#"), rank.cast("string")), F.lit("unranked"))


def position_text(summary: DataFrame) -> DataFrame:
    """(market_id, text): one sentence of a market's position, in our own words."""
    head = F.when(F.col("your_rank").isNull(), "No rank: too few scored businesses.").otherwise(F.concat(F.lit("Place "), F.col("your_rank").cast("string"), F.lit(" among "), plural(F.col("audited") + 1, "scored business", "scored businesses"), F.lit(".")))
    gap = F.when(F.col("market_gap").isNull(), "").otherwise(F.concat(F.lit(" Difference to the average: "), metric(F.col("market_gap"), " points", True), F.lit(".")))
    return summary.select("market_id", F.concat(head, gap).alias("text"))


#: Our wording of what scores rest on.
METHODOLOGY = "Scores rest on what fetched homepages and directory rows show. An input that was not observed is N/A and leaves the score. Equal scores share a rank; chain locations are listed without one."


def report_notes(records: DataFrame, recommended: DataFrame) -> DataFrame:
    """(market_id, quality, summary, action): the texts on a market's data, findings and lack of a plan, in our own words.

    records: ranked rows with ``outcome`` and ``audit_status``; recommended: market_id, n_recommendations. With
    recommendations there is no action text.
    """
    state = lambda s: F.count_if(F.col("audit_status") == s)
    other = ~F.col("is_user")
    outcome = lambda o: F.count_if(other & F.col("outcome").startswith(o))
    g = records.groupBy("market_id").agg(
        F.count("*").alias("n"), F.count_if(other).alias("others"), state("unavailable").alias("failed"), state("partial").alias("limited"), F.count_if(~other & F.col("scored")).alias("own"),
        *[outcome(o).alias(f"n_{o}") for o in ("chain", "scored", "no_website", "not_attempted", "failed")],
    ).join(recommended, "market_id")
    said = lambda c, text: F.when(F.col(c) > 0, text)
    num = lambda c, words: F.concat(F.col(c).cast("string"), F.lit(words))
    parts = F.concat_ws(", ", num("n_scored", " scored"), said("n_no_website", num("n_no_website", " without a website")), said("n_failed", plural(F.col("n_failed"), "failed audit", "failed audits")), said("n_not_attempted", num("n_not_attempted", " beyond the audit limit")), said("n_chain", plural(F.col("n_chain"), "chain location", "chain locations")))
    coverage = F.when(F.col("failed") == 0, "Full").when(F.col("failed") < F.col("n"), "Limited").otherwise("No")
    nearby = F.coalesce(said("others", F.concat(F.lit(" Nearby: "), parts, F.lit("."))), F.lit(""))
    thin = F.coalesce(said("limited", F.concat(F.lit(" "), plural(F.col("limited"), "audit", "audits"), F.lit(" saw the homepage only."))), F.lit(""))
    summary = F.concat(F.lit("Found "), plural(F.col("others"), "business", "businesses"), F.lit(" nearby; "), num("n_scored", " could be scored. What was not observed is N/A and never zero."))
    action = F.when(F.col("n_recommendations") > 0, None).when(F.col("own") == 0, "Nothing to act on: the own audit was unavailable.").when(F.col("n_scored") == 0, "Nothing to act on: no other business was scored.").otherwise("No gap: every element checked was seen.")
    return g.select("market_id", F.concat(coverage, F.lit(" coverage."), nearby, thin).alias("quality"), summary.alias("summary"), action.alias("action"))


def snapshot_rows(ranked: DataFrame, signals: DataFrame, most: int = 10) -> DataFrame:
    """Table rows of a market: rank order, the user first on a tie, unranked last, with the first available signal."""
    order = F.array_position(F.array(*[F.lit(s) for s in SIGNAL_ORDER]), F.col("category"))
    first = signals.withColumn("_o", order).where("_o > 0").groupBy("market_id", "id").agg(F.min_by("label", F.struct("_o", "label")).alias("signal"))
    place = F.row_number().over(Window.partitionBy("market_id").orderBy(F.asc_nulls_last("rank"), F.desc("is_user"), "ord"))
    top = ranked.withColumn("place", place).where(F.col("place") <= most)
    return top.join(first, ["market_id", "id"], "left").select("market_id", "place", "id", rank_text(F.col("rank"), F.col("tied")).alias("rank"), metric(F.col("final_score")).alias("score"), F.coalesce("signal", F.lit("-")).alias("signal"))
