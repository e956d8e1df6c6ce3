"""Invariants of whole reports: envelope, sources, citations, record states and the reconciliation of summaries.

Each function returns one row a broken rule, so a sound report gives none. Rules are columns of one pass; a null in a
stated value breaks a rule only where the value is required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .market import market_summary, outcome_counts

#: What a sound report states.
SCHEMA_VERSION = 2
SCORING_VERSION = 2
POLICY = "real-only"
KINDS = ("user_input", "nominatim", "openstreetmap", "homepage", "linked_page", "news_article")
URL_KINDS = ("homepage", "linked_page", "news_article")
STATUSES = ("used", "limited", "unavailable")
#: Audit fields that an unavailable audit leaves null.
AUDIT_FIELDS = (
    "h1_count", "heading_count", "word_count", "cta_count", "has_phone", "has_email", "has_contact", "has_booking", "has_pricing", "has_services", "has_about",
    "has_blog", "has_careers", "has_testimonials", "has_trust", "has_gallery", "has_social", "has_viewport", "is_https", "html_bytes", "fetch_ms", "website_score",
)
#: Scores from 0 to 100, and whether a row with an audit must have them.
SCORES = {"category_match": False, "local_presence": False, "website_score": True, "momentum": True, "risk": True, "change": True, "final_score": True}


def _broken(rows: DataFrame, ids: tuple[str, ...], rules: dict[str, Column]) -> DataFrame:
    hits = F.array(*[F.when(bad, rule) for rule, bad in rules.items()])
    return rows.select(*ids, F.explode(F.array_compact(hits)).alias("rule"))


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def envelope_violations(reports: DataFrame) -> DataFrame:
    """(report_id, rule) of a report's ``envelope_rules``."""
    return _broken(reports, ("report_id",), envelope_rules())


def envelope_rules() -> dict[str, Column]:
    """When each rule is broken, of report_id, schema_version, policy, synthetic, scoring_version, n_sources, lat, lon, generated_at (text)."""
    inside = lambda c, most: F.coalesce(F.col(c).between(-most, most), F.lit(False))
    return {
        "schema_version": ~F.col("schema_version").eqNullSafe(SCHEMA_VERSION),
        "policy": ~F.col("policy").eqNullSafe(POLICY),
        "synthetic": ~F.col("synthetic").eqNullSafe(False),
        "no_sources": F.coalesce("n_sources", F.lit(0)) == 0,
        "coordinates": ~(inside("lat", 90.0) & inside("lon", 180.0)),
        "scoring_version": F.col("scoring_version") != SCORING_VERSION,
        "generated_at": F.expr("try_cast(generated_at AS timestamp) IS NULL"),
    }


def source_row_violations(sources: DataFrame) -> DataFrame:
    """(report_id, source_id, rule) of report_id, source_id, kind, provider, title, accessed_at (text), status, url."""
    rules = {
        "provider": _blank("provider"),
        "title": _blank("title"),
        "kind": ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)),
        "accessed_at": F.expr("try_cast(accessed_at AS timestamp) IS NULL"),
        "status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "url_missing": F.col("kind").isin(*URL_KINDS) & _blank("url"),
        "url_scheme": ~_blank("url") & ~F.coalesce(F.lower("url").rlike(r"^https?://[^/?#]"), F.lit(False)),
    }
    return _broken(sources, ("report_id", "source_id"), rules)


def citation_violations(citations: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(report_id, label, rule) of report_id, label, required and source_ids (array): missing, empty, repeated or unknown ids.

    sources: report_id, source_id. Ids are exploded and joined, so no report's sources are gathered in a row. Without sources,
    citations have ``unknown``, as where a report's sources came with them.
    """
    n = F.size("source_ids")
    rules = {
        "missing": F.col("source_ids").isNull(),
        "empty": F.col("source_ids").isNotNull() & F.col("required") & (n == 0),
        "repeated": F.size(F.array_distinct("source_ids")) < n,
    }
    if sources is None:
        return _broken(citations, ("report_id", "label"), rules | {"unknown": F.col("unknown")})
    cited = citations.select("report_id", "label", F.explode("source_ids").alias("source_id"))
    known = sources.select("report_id", "source_id").distinct()
    lost = cited.join(known, ["report_id", "source_id"], "left_anti").select("report_id", "label", F.lit("unknown").alias("rule")).distinct()
    return _broken(citations, ("report_id", "label"), rules).unionByName(lost)


def record_state_violations(records: DataFrame, fields: tuple[str, ...] = AUDIT_FIELDS) -> DataFrame:
    """(market_id, id, rule) of ranked records: scores out of range or lacking, and states that contradict each other.

    records: market_id, id, available, is_chain, skipped, audit_status, signal_status, rank, tied, the scores and
    ``fields``. Chain locations have no final score and no rank; an unavailable audit is skipped and has no field.
    """
    up, chain = F.col("available"), F.coalesce("is_chain", F.lit(False))
    # NaN is above all numbers in Spark's order, so it is out of range too
    rules = {f"{c}_range": ~F.col(c).between(0, 100) for c in SCORES}
    rules |= {f"{c}_missing": up & F.col(c).isNull() & (~chain if c == "final_score" else F.lit(True)) for c, needed in SCORES.items() if needed}
    rules |= {f"{c}_observed": ~up & F.col(c).isNotNull() for c in fields}
    rules |= {
        "chain_scored": chain & (F.col("final_score").isNotNull() | F.col("rank").isNotNull()),
        "unavailable_ranked": ~up & F.col("rank").isNotNull(),
        "not_skipped": ~up & ~F.coalesce("skipped", F.lit(False)),
        "audit_states": ~F.col("audit_status").eqNullSafe(F.col("signal_status")),
        "tied": ~F.coalesce("tied", F.lit(False)).eqNullSafe(F.col("_ties") > 1),
    }
    score = F.when(F.col("rank").isNotNull(), F.col("final_score"))
    ties = F.count(score).over(Window.partitionBy("market_id", score))
    return _broken(records.withColumn("_ties", ties), ("market_id", "id"), rules)


def summary_violations(stated: DataFrame, records: DataFrame) -> DataFrame:
    """(market_id, rule) where a stated summary differs from what the records give; also markets without one.

    stated: market_id, competitors, audited, average_website, average_final, your_rank, your_tied, market_gap, status,
    failed, limited and the counts of outcomes; records: ranked rows with ``outcome`` and ``audit_status``.
    """
    outcomes = ("chains", "scored", "no_website", "not_attempted", "audit_failed")
    mine = F.coalesce(F.bool_or(F.when(F.col("is_user"), F.col("tied"))), F.lit(False))
    state = lambda s: F.count_if(F.col("audit_status") == s)
    states = records.groupBy("market_id").agg(state("unavailable").alias("failed"), state("partial").alias("limited"), mine.alias("your_tied"), F.count_if(F.col("is_user") & F.col("scored")).alias("_user"))
    others = outcome_counts(records.where("NOT is_user")).withColumnRenamed("failed", "audit_failed")
    true = market_summary(records).join(states, "market_id").join(others, "market_id", "left").fillna(0, list(outcomes))
    checked = ("competitors", "audited", "average_website", "average_final", "your_rank", "your_tied", "market_gap", "status", "failed", "limited", *outcomes)
    both = true.join(stated.select("market_id", F.lit(True).alias("_stated"), *[F.col(c).alias(f"s_{c}") for c in checked]), "market_id", "left")
    rules = {c: F.col("_stated") & ~F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in checked}
    rules["summary_missing"] = F.col("_stated").isNull()
    rules["no_evidence"] = (F.col("_user") == 0) & (F.col("competitors") == 0)
    return _broken(both, ("market_id",), rules)
