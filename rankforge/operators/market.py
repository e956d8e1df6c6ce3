"""Ranks, summaries, comparisons and recommendations of each market.

Every operator groups by ``market_id``; its largest group is a market's businesses. Records have market_id, id, name,
is_user, is_chain, available, website_score, final_score, the five category scores, and ord (arrival order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import half_up
from .joins import salted_join
from .scoring import CATEGORIES, is_scored, position_status


def market() -> WindowSpec:
    return Window.partitionBy("market_id")


def competition_rank(records: DataFrame, by: str = "id") -> DataFrame:
    """Adds scored, rank (1224 style, null for unscored rows or fewer than two scored) and tied.

    Ranks come from each market's counts by score, which meet its rows by market and a salt of column ``by``: scores are whole
    numbers to 100, so a market of all rows has 101 counts and is never sorted or gathered. No filter and no join key is a score,
    so the optimizer doesn't copy its expression. Rows without a market get no rank. ``records`` is read twice.
    """
    r = records.withColumn("scored", is_scored(F.col("available"), F.col("final_score"), F.col("is_chain")))
    r = r.withColumn("_s", F.when(F.col("scored"), F.col("final_score")))
    n = r.groupBy("market_id", "_s").agg(F.count("*").alias("_n"))
    counts = n.groupBy("market_id").agg(F.collect_list(F.struct("_s", "_n")).alias("_counts"))
    out = salted_join(r, counts, ["market_id"], [by], "left")
    rows = lambda fits: F.aggregate("_counts", F.lit(0).cast("bigint"), lambda acc, e: acc + F.when(fits(e["_s"]), e["_n"]).otherwise(0))
    ranked = F.col("scored") & (rows(lambda s: s.isNotNull()) >= 2)
    rank = F.when(ranked, rows(lambda s: s > F.col("_s")) + 1).cast("int")
    tied = F.coalesce(ranked & (rows(lambda s: s == F.col("_s")) > 1), F.lit(False))
    return out.select(*r.drop("_s").columns, rank.alias("rank"), tied.alias("tied"))


def display_order(ranked: DataFrame) -> DataFrame:
    """Adds place: scored by score, the user first on a tie, then id; unscored after them as they arrived."""
    order = market().orderBy(F.desc("scored"), F.desc_nulls_last(F.when(F.col("scored"), F.col("final_score"))), F.desc(F.col("scored") & F.col("is_user")), F.when(F.col("scored"), F.col("id")).asc_nulls_last(), "ord")
    return ranked.withColumn("place", F.row_number().over(order))


def outcome_counts(records: DataFrame) -> DataFrame:
    """Per market, counts of the five outcomes in column ``outcome`` (failed with any reason)."""
    n = lambda c: F.count_if(c)
    o = F.col("outcome")
    return records.groupBy("market_id").agg(n(o == "chain").alias("chains"), n(o == "scored").alias("scored"), n(o == "no_website").alias("no_website"), n(o == "not_attempted").alias("not_attempted"), n(o.startswith("failed")).alias("failed"))


def unpivot_categories(records: DataFrame) -> DataFrame:
    items = [F.struct(F.lit(k).alias("category_ord"), F.lit(c).alias("category"), F.lit(m).alias("max_score"), F.col(c).cast("double").alias("score")) for k, (c, m) in enumerate(CATEGORIES)]
    return records.select("market_id", "is_user", F.expr("scored"), F.inline(F.array(*items)))


def category_comparison(ranked: DataFrame) -> DataFrame:
    """Per market and category: the user's score against the scored competitors that have one (no row without either)."""
    u = unpivot_categories(ranked)
    user = F.max(F.when(F.col("is_user"), F.col("score")))
    u = u.withColumn("user_score", user.over(Window.partitionBy("market_id", "category")))
    other = ~F.col("is_user") & F.col("scored") & F.col("score").isNotNull()
    g = u.where("user_score is not null").groupBy("market_id", "category", "category_ord", "max_score", "user_score").agg(F.avg(F.when(other, F.col("score"))).alias("raw"), F.count_if(other & (F.col("score") > F.col("user_score"))).alias("ahead"), F.count_if(other).alias("n"))
    return g.where("n > 0").select("market_id", "category", "category_ord", "max_score", "user_score", half_up(F.col("raw"), 1).alias("average"), half_up(F.col("raw") - F.col("user_score"), 1).alias("gap"), "ahead", "n")


def weakest_category(records: DataFrame) -> DataFrame:
    """Per record id, the category with the smallest share of its maximum; full and null ones are left out."""
    items = [F.struct((F.col(c) / F.lit(float(m))).alias("share"), F.lit(-m).alias("m"), F.lit(k).alias("k"), F.lit(c).alias("c"), F.col(c).isNotNull().alias("has")) for k, (c, m) in enumerate(CATEGORIES)]
    best = F.array_min(F.filter(F.array(*items), lambda x: x["has"] & (x["share"] < 1)))
    return records.select("market_id", "id", best["c"].alias("weakest"))


def market_summary(ranked: DataFrame) -> DataFrame:
    """One row a market."""
    other = ~F.col("is_user")
    sc = other & F.col("scored")
    user = lambda c: F.max(F.when(F.col("is_user"), F.col(c)))
    best = F.min_by(F.col("name"), F.when(sc, F.struct((-F.col("final_score")).alias("s"), F.col("id"))))
    g = ranked.groupBy("market_id").agg(F.count_if(other).alias("competitors"), F.count_if(sc).alias("audited"), F.avg(F.when(sc, F.col("website_score"))).alias("w"), F.avg(F.when(sc, F.col("final_score"))).alias("f"), user("rank").alias("your_rank"), F.max(F.when(F.col("is_user") & F.col("scored"), F.col("final_score"))).alias("u"), best.alias("strongest"))
    gap = F.col("u") - F.col("f")
    return g.select("market_id", "competitors", "audited", half_up(F.col("w")).alias("average_website"), half_up(F.col("f")).alias("average_final"), F.col("your_rank").cast("int").alias("your_rank"), half_up(gap).alias("market_gap"), position_status(F.col("your_rank"), gap).alias("status"), "strongest")


def element_gaps(matrix: DataFrame) -> DataFrame:
    """Elements that the user lacks: adopters and observed among scored competitors.

    matrix: market_id, is_user, scored, ord, key, category, points, covered_by, observed.
    """
    missing = matrix.where("is_user AND observed = false").select("market_id", "ord", "key", "category", "points", "covered_by")
    seen = matrix.where("NOT is_user AND scored").groupBy("market_id", "key").agg(F.count_if(F.col("observed")).alias("adopters"), F.count("observed").alias("observed_by"))
    g = missing.join(seen, ["market_id", "key"], "left").fillna(0, ["adopters", "observed_by"])
    return g.withColumn("share", F.when(F.col("observed_by") > 0, F.col("adopters") / F.col("observed_by")).otherwise(0.0))


def recommendations(gaps: DataFrame, most: int = 5) -> DataFrame:
    """The first gaps by share and points, without those whose covering element is missing too."""
    keys = gaps.select("market_id", F.col("key").alias("covered_by"))
    free = gaps.join(keys, ["market_id", "covered_by"], "left_anti")
    place = F.row_number().over(market().orderBy(F.desc("share"), F.desc("points"), "ord"))
    priority = F.when((F.col("share") >= 0.5) & (F.col("points") >= 5), "high").when(F.col("share") > 0, "medium").otherwise("low")
    return free.withColumn("place", place).where(F.col("place") <= most).select("market_id", "place", "key", "category", "points", "adopters", "observed_by", priority.alias("priority"))


def top_findings(summary: DataFrame, comparison: DataFrame, most: int = 3) -> DataFrame:
    """Position first, then category gaps above 0.5 by size; confidence by the number of scored competitors."""
    head = summary.where("your_rank IS NOT NULL AND average_final IS NOT NULL").select("market_id", F.lit(0).alias("kind"), F.lit(0.0).alias("gap"), F.lit(-1).alias("category_ord"), F.lit("position").alias("finding"))
    body = comparison.where("gap > 0.5").select("market_id", F.lit(1).alias("kind"), "gap", "category_ord", F.col("category").alias("finding"))
    both = head.unionByName(body).withColumn("place", F.row_number().over(market().orderBy("kind", F.desc("gap"), "category_ord")))
    conf = F.when(F.col("audited") >= 5, "high").when(F.col("audited") >= 3, "medium").otherwise("low")
    return both.where(F.col("place") <= most).join(summary.select("market_id", conf.alias("confidence")), "market_id").select("market_id", "place", "finding", "gap", "confidence")


def top_risks(signals: DataFrame, most: int = 3) -> DataFrame:
    """signals: market_id, record_ord (0: user), kind_ord (0: risk, 1: change), id, label, evidence; the first distinct ones."""
    first = signals.groupBy("market_id", "id", "label", "evidence").agg(F.min(F.struct("record_ord", "kind_ord")).alias("o"))
    place = F.row_number().over(market().orderBy("o", "id", "label", "evidence"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("market_id", "place", "id", "label", "evidence")


def select_audits(candidates: DataFrame, attempts: int = 10, successes: int = 7) -> DataFrame:
    """Candidates (market_id, id, distance_km, website, is_chain, success) that are audited: nearest first, until enough succeed."""
    able = candidates.where("website IS NOT NULL AND NOT is_chain")
    order = market().orderBy("distance_km", "id")
    before = F.coalesce(F.sum(F.col("success").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return able.withColumn("attempt", F.row_number().over(order)).withColumn("before", before).where((F.col("attempt") <= attempts) & (F.col("before") < successes)).drop("before")


def listed_competitors(candidates: DataFrame, audited: DataFrame, most: int = 10) -> DataFrame:
    """All audited candidates and the nearest others up to ``most``, nearest first."""
    marked = candidates.join(audited.select("market_id", "id", F.lit(True).alias("audited")), ["market_id", "id"], "left").fillna(False, ["audited"])
    kept = marked.withColumn("_n", F.row_number().over(market().orderBy(F.desc("audited"), "distance_km", "id"))).where(F.col("_n") <= most)
    return kept.withColumn("place", F.row_number().over(market().orderBy("distance_km", "id"))).drop("_n")
