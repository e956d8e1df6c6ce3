"""Numbered sources and report checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url

#: The order of statuses of a shared source, the worst first.
STATUS_ORDER = ("unavailable", "limited", "used")


def source_registry(uses: DataFrame) -> DataFrame:
    """(report_id, source_id, kind, provider, title, url, business, shared, status): one row a distinct source.

    uses: report_id, seq, kind, provider, title, url, business, status. Sources of one canonical url are one; without a
    url those of one kind, provider, title and business. Ids run from 1 in order of first use. A source that two or more
    businesses use has no business and its best status; one of a single business has its last status.
    """
    lower = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    key = F.when(F.col("url").isNotNull(), F.concat(F.lit("u|"), canonical_url(F.col("url")))).otherwise(F.concat_ws("|", F.lit("k"), lower("kind"), lower("provider"), lower("title"), lower("business")))
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    first = lambda c: F.min_by(c, "seq")
    g = uses.withColumn("_key", key).groupBy("report_id", "_key").agg(F.min("seq").alias("seq"), *[first(c).alias(c) for c in ("kind", "provider", "title", "url", "business")], F.count_distinct(F.lower("business")).alias("n"), F.max_by("status", "seq").alias("last"), F.max(rank).alias("best"))
    shared = F.col("n") >= 2
    status = F.when(shared, F.get(F.array(*[F.lit(s) for s in STATUS_ORDER]), (F.col("best") - 1).cast("int"))).otherwise(F.col("last"))
    ident = F.row_number().over(Window.partitionBy("report_id").orderBy("seq", "_key"))
    return g.select("report_id", ident.alias("source_id"), "kind", "provider", F.when(shared, F.concat_ws(" ", F.lit("Shared source:"), "provider")).otherwise(F.col("title")).alias("title"), "url", F.when(~shared, F.col("business")).alias("business"), shared.alias("shared"), status.alias("status"))


def provider_counts(sources: DataFrame) -> DataFrame:
    return sources.where("status <> 'unavailable'").groupBy("report_id", "provider").agg(F.count("*").alias("n_sources"))


def observation_ids(evidence: DataFrame) -> DataFrame:
    """(id, source_ids): sources of homepage evidence above low confidence in order, else the audit's first source.

    evidence: id, ord, kind, confidence, source_ids (array).
    """
    good = (F.col("kind") == "homepage") & (F.col("confidence") != "low")
    g = evidence.groupBy("id").agg(F.sort_array(F.collect_list(F.when(good, F.struct("ord", "source_ids")))).alias("g"), F.min_by("source_ids", "ord").alias("f"))
    ids = F.array_distinct(F.flatten(F.transform("g", lambda x: x["source_ids"])))
    return g.select("id", F.when(F.size(ids) > 0, ids).otherwise(F.slice("f", 1, 1)).alias("source_ids"))


def _violation(df: DataFrame, rule: str, bad: Column) -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(False))).select("market_id", F.col("id"), F.lit(rule).alias("rule"))


def record_violations(records: DataFrame) -> DataFrame:
    """(market_id, id, rule) of every broken rule of ranked records, in one pass over them and one over their markets.

    Rules: unavailable rows have no scores; scores are in range; website_score is the sum of its categories; the final
    score follows from its parts; scored rows of markets with two are ranked by the count of better ones; others aren't.
    """
    from .scoring import CATEGORIES, final_score

    names = [c for c, _ in CATEGORIES]
    any_score = F.coalesce(*[F.col(c).cast("double") for c in (*names, "website_score", "momentum")])
    total = sum((F.col(c) for c in names), F.lit(0))
    w = Window.partitionBy("market_id")
    scored = F.count_if("scored").over(w)
    better = F.when(F.col("scored"), F.rank().over(w.orderBy(F.desc_nulls_last(F.when(F.col("scored"), F.col("final_score"))))))
    r = records.withColumn("_n", scored).withColumn("_r", better)
    rules = [F.when(~F.col("available") & any_score.isNotNull(), "unavailable_has_score")]
    rules += [F.when(F.col(c).isNotNull() & ~F.col(c).between(0, m), f"{c}_range") for c, m in CATEGORIES]
    rules += [F.when(F.col("website_score") != total, "website_sum"), F.when(F.col("final_score") != final_score(F.col("website_score"), F.col("local_presence"), F.col("momentum"), F.col("risk")), "final_arithmetic")]
    rules += [F.when((F.col("_n") >= 2) & F.col("scored") & ~F.col("rank").eqNullSafe(F.col("_r")), "rank"), F.when((~F.col("scored") | (F.col("_n") < 2)) & F.col("rank").isNotNull(), "rank_of_unscored")]
    return r.select("market_id", "id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def source_violations(sources: DataFrame, citations: DataFrame) -> DataFrame:
    """(report_id, rule, source_id): cited ids that don't exist, gaps in ids, urls listed twice."""
    lost = citations.join(sources.select("report_id", "source_id"), ["report_id", "source_id"], "left_anti").select("report_id", F.lit("unknown_source").alias("rule"), "source_id")
    gap = sources.groupBy("report_id").agg(F.max("source_id").alias("source_id"), F.count("*").alias("n")).where("source_id <> n").select("report_id", F.lit("id_gap").alias("rule"), "source_id")
    twice = sources.where("url IS NOT NULL").groupBy("report_id", canonical_url(F.col("url")).alias("u")).agg(F.count("*").alias("n"), F.max("source_id").alias("source_id")).where("n > 1").select("report_id", F.lit("url_twice").alias("rule"), "source_id")
    return lost.unionByName(gap).unionByName(twice)


def forbidden_values(reports: DataFrame, pattern: str) -> DataFrame:
    """(report_id, found) of forbidden words at any depth of a report's JSON text."""
    hits = F.array_distinct(F.regexp_extract_all("payload", F.lit(pattern), F.lit(0)))
    return reports.select("report_id", F.explode(hits).alias("found"))


def snapshot_gate(summaries: DataFrame) -> DataFrame:
    """Adds violations: what keeps a report from becoming a snapshot.

    summaries: report_id, n_rule_violations, user_status, n_competitors, n_complete.
    """
    bad = [F.when(F.col("n_rule_violations") > 0, "invariants"), F.when(F.col("user_status") != "complete", "user_audit"), F.when(F.col("n_competitors") < 4, "competitors"), F.when(F.col("n_complete") < 2, "complete_audits")]
    return summaries.withColumn("violations", F.array_compact(F.array(*bad)))
