"""The given tables as the operators' inputs, by column arithmetic that any SQL engine repeats.

Businesses are customers and markets their nations; scores, flags and places follow from the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: SQL over customer that both engines read alike.
RECORDS = {
    "market_id": "c_nationkey",
    "k": "c_custkey",
    "id": "concat('b-', lpad(cast(c_custkey as varchar(20)), 9, '0'))",
    "name": "c_name",
    "is_chain": "c_custkey % 11 = 0",
    "available": "c_custkey % 13 <> 0",
    "website": "case when c_custkey % 17 = 0 then null else concat('https://site', cast(c_custkey % 911 as varchar(20)), '.example') end",
    "seo": "cast(case when c_custkey % 13 = 0 then null else c_custkey * 37 % 26 end as int)",
    "conversion": "cast(case when c_custkey % 13 = 0 then null else c_custkey * 41 % 26 end as int)",
    "trust": "cast(case when c_custkey % 13 = 0 then null else c_custkey * 43 % 21 end as int)",
    "content": "cast(case when c_custkey % 13 = 0 then null else c_custkey * 47 % 21 end as int)",
    "technical": "cast(case when c_custkey % 13 = 0 then null else c_custkey * 53 % 11 end as int)",
    "p_website": "case when c_custkey % 7 = 0 then null else c_custkey % 3 <> 0 end",
    "p_listing": "case when c_custkey % 19 = 0 then null else c_custkey % 4 <> 0 end",
    "p_contact": "case when c_custkey % 5 = 0 then null else c_custkey % 2 = 0 end",
    "p_match": "case when c_custkey % 23 = 0 then null else c_custkey % 6 <> 0 end",
    "p_complete": "case when c_custkey % 29 = 0 then null else (c_custkey % 5) / 4.0e0 end",
    "s_momentum": "cast(c_custkey % 2 as int)",
    "s_offer": "cast(c_custkey / 2 as bigint) % 2",
    "s_hiring": "cast(c_custkey % 5 % 2 as int)",
    "s_social": "cast(c_custkey % 7 as int)",
    "s_news": "cast(c_custkey % 4 as int)",
    "s_risk": "cast(c_custkey % 3 % 2 as int)",
    "lat": "37.0e0 + (floor(c_custkey / 3) * 7919 % 5000) / 10000.0e0 + (c_custkey % 3) * 0.0012e0",
    "lon": "-122.5e0 + (floor(c_custkey / 3) * 104729 % 5000) / 10000.0e0",
    "name_key": "concat(lower(c_mktsegment), cast(cast(floor(c_custkey / 3) as bigint) as varchar(20)))",
    "tag_value": "lower(c_mktsegment)",
}
RECORDS["s_offer"] = "cast(floor(c_custkey / 2) as bigint) % 2"
RECORDS_SQL = f"base AS (SELECT {', '.join(f'{e} AS {n}' for n, e in RECORDS.items())} FROM customer), users AS (SELECT market_id AS um, min(k) AS uk FROM base GROUP BY market_id), rec0 AS (SELECT base.*, k = uk AS is_user FROM base JOIN users ON market_id = um)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Businesses with raw inputs; the user of a market is its smallest key."""
    from pyspark.sql import functions as F

    base = table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in RECORDS.items()])
    users = base.groupBy(base["market_id"].alias("um")).agg(F.min("k").alias("uk"))
    return base.join(users, base["market_id"] == users["um"]).withColumn("is_user", F.col("k") == F.col("uk")).drop("um", "uk")


def scored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with website_score, local_presence, momentum, risk, final_score and ord."""
    from pyspark.sql import functions as F

    from ..operators import scoring as S

    r = records(spark, sf_dir)
    r = r.withColumn("website_score", (F.col("seo") + F.col("conversion") + F.col("trust") + F.col("content") + F.col("technical")))
    r = r.withColumn("local_presence", S.local_presence(*[F.col(c) for c in ("p_website", "p_listing", "p_contact", "p_match", "p_complete")]))
    r = r.withColumn("momentum", S.momentum_score(F.col("s_momentum"), F.col("s_offer"), F.col("s_hiring"), F.col("s_social"), F.col("s_news"), F.col("market_id") % 2 == 0, F.col("available")))
    r = r.withColumn("risk", S.risk_score(F.col("s_risk"), F.col("available")))
    return r.withColumn("final_score", S.final_score(F.col("website_score"), F.col("local_presence"), F.col("momentum"), F.col("risk"))).withColumn("ord", F.col("k"))


_LANGUAGE = "least(55, 15 * s_momentum + 8 * s_offer + 10 * s_hiring) + least(20, 4 * s_social)"
_PRESENCE = " + ".join(f"coalesce({w}e0 * cast({c} as double), 0)" for c, w in (("p_website", "30.0"), ("p_listing", "20.0"), ("p_contact", "20.0"), ("p_match", "20.0"), ("p_complete", "10.0")))
_WEIGHT = " + ".join(f"(case when {c} is null then 0e0 else {w}e0 end)" for c, w in (("p_website", "30.0"), ("p_listing", "20.0"), ("p_contact", "20.0"), ("p_match", "20.0"), ("p_complete", "10.0")))
#: The same in SQL for DuckDB: rec has the columns of scored_records.
SCORED_SQL = f"""{RECORDS_SQL},
rec1 AS (SELECT *, seo + conversion + trust + content + technical AS website_score,
    CAST(floor(100.0e0 * ({_PRESENCE}) / nullif({_WEIGHT}, 0e0) + 0.5e0) AS BIGINT) AS local_presence,
    CASE WHEN available THEN CAST(CASE WHEN market_id % 2 = 0 THEN {_LANGUAGE} + least(25, 10 * s_news) ELSE floor(({_LANGUAGE}) * 100.0e0 / 75.0e0 + 0.5e0) END AS BIGINT) END AS momentum,
    CASE WHEN available THEN least(100, 20 * s_risk) END AS risk FROM rec0),
rec AS (SELECT *, CAST(floor(0.6e0 * website_score + 0.2e0 * local_presence + 0.15e0 * momentum + 0.05e0 * (100 - risk) + 0.5e0) AS BIGINT) AS final_score, k AS ord FROM rec1),
sc AS (SELECT *, coalesce(available AND final_score IS NOT NULL AND NOT is_chain, false) AS scored FROM rec),
rk AS (SELECT *, CASE WHEN scored AND count(CASE WHEN scored THEN 1 END) OVER (PARTITION BY market_id) >= 2
        THEN rank() OVER (PARTITION BY market_id ORDER BY CASE WHEN scored THEN final_score END DESC NULLS LAST) END AS rnk FROM sc)"""
