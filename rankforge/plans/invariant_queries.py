"""Queries that hold reports against their invariants, and the notes of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import invariants, market, report, scoring
from . import market_queries as M
from .bindings import SCORED_SQL, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rules(pairs: dict[str, str]) -> str:
    return "unnest([" + ", ".join(f"CASE WHEN {bad} THEN '{rule}' END" for rule, bad in pairs.items()) + "]) AS rule"


#: Orders as reports: versions, places and times follow from their columns.
_ENVELOPE = {
    "schema_version": "CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 2 END",
    "policy": "CASE WHEN o_orderstatus = 'P' THEN 'any' ELSE 'real-only' END",
    "synthetic": "o_custkey % 9 = 0",
    "scoring_version": "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_custkey % 7 = 0 THEN 1 ELSE 2 END",
    "n_sources": "o_custkey % 5",
    "lat": "o_totalprice / 4000.0e0",
    "lon": "-(o_totalprice / 2000.0e0)",
    "generated_at": "CASE WHEN o_orderkey % 8 = 3 THEN o_orderstatus ELSE '2026-01-01T00:00:00' END",
}
_ENVELOPE_RULES = {"schema_version": "schema_version IS DISTINCT FROM 2", "policy": "policy <> 'real-only'", "synthetic": "synthetic", "no_sources": "n_sources = 0", "coordinates": "abs(lat) > 90 OR abs(lon) > 180", "scoring_version": "scoring_version <> 2", "generated_at": "try_cast(generated_at AS TIMESTAMP) IS NULL"}


@query(f"WITH r AS (SELECT o_orderkey AS report_id, {', '.join(f'{e} AS {n}' for n, e in _ENVELOPE.items())} FROM orders), v AS (SELECT report_id, {_rules(_ENVELOPE_RULES)} FROM r) SELECT * FROM v WHERE rule IS NOT NULL")
def envelope_violations(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "orders").selectExpr("o_orderkey AS report_id", *[f"{e} AS {n}" for n, e in _ENVELOPE.items()])
    return invariants.envelope_violations(r)


#: Pages as sources of reports of eight.
_SOURCE = {
    "kind": "CASE WHEN page_id % 11 = 0 THEN 'blog' WHEN page_id % 3 = 0 THEN 'openstreetmap' ELSE 'homepage' END",
    "provider": "CASE WHEN page_id % 13 = 0 THEN ' ' WHEN page_id % 14 = 0 THEN NULL ELSE 'p' END",
    "title": "CASE WHEN page_id % 17 = 0 THEN '' ELSE url END",
    "accessed_at": "CASE WHEN page_id % 10 = 0 THEN url ELSE '2026-02-03' END",
    "status": "CASE WHEN page_id % 19 = 0 THEN 'lost' WHEN page_id % 2 = 0 THEN 'limited' ELSE 'used' END",
    "link": "CASE WHEN page_id % 12 = 0 THEN concat('ftp', url) WHEN page_id % 5 = 0 THEN NULL ELSE url END",
}
_SOURCE_RULES = {"provider": "coalesce(trim(provider), '') = ''", "title": "coalesce(trim(title), '') = ''", "kind": "kind = 'blog'", "accessed_at": "page_id % 10 = 0", "status": "status = 'lost'", "url_missing": "kind = 'homepage' AND coalesce(trim(link), '') = ''", "url_scheme": r"trim(link) <> '' AND NOT regexp_matches(lower(link), '^https?://[^/?#]')"}


@query(f"WITH s AS (SELECT page_id // 8 AS report_id, page_id AS source_id, page_id, {', '.join(f'{e} AS {n}' for n, e in _SOURCE.items())} FROM pages), v AS (SELECT report_id, source_id, {_rules(_SOURCE_RULES)} FROM s) SELECT * FROM v WHERE rule IS NOT NULL")
def source_row_violations(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "pages").selectExpr("page_id div 8 AS report_id", "page_id AS source_id", *[f"{e} AS {n}" for n, e in _SOURCE.items()])
    return invariants.source_row_violations(s.withColumnRenamed("link", "url"))


@query("""WITH l AS (SELECT l_orderkey AS report_id, l_linenumber AS n, l_partkey AS p FROM lineitem), src AS (SELECT report_id, n FROM l WHERE p % 10 <> 0),
c AS (SELECT report_id, n AS label, CASE WHEN p % 9 = 0 THEN NULL WHEN p % 8 = 0 THEN [] WHEN p % 7 = 0 THEN [n, n] ELSE [n, greatest(n - 1, 1)] END AS ids, n <> 2 AS required FROM l),
v AS (SELECT report_id, label, unnest([CASE WHEN ids IS NULL THEN 'missing' END, CASE WHEN required AND len(ids) = 0 THEN 'empty' END, CASE WHEN len(list_distinct(ids)) < len(ids) THEN 'repeated' END]) AS rule FROM c),
x AS (SELECT report_id, label, unnest(ids) AS n FROM c)
SELECT report_id, label, rule FROM v WHERE rule IS NOT NULL UNION ALL SELECT DISTINCT report_id, label, 'unknown' FROM x WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.report_id = x.report_id AND src.n = x.n)""")
def citation_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order cite themselves and the line before; one line in ten is no source."""
    li = table(spark, sf, "lineitem").selectExpr("l_orderkey AS report_id", "l_linenumber AS n", "l_partkey AS p")
    ids = "CASE WHEN p % 9 = 0 THEN NULL WHEN p % 8 = 0 THEN slice(array(n), 1, 0) WHEN p % 7 = 0 THEN array(n, n) ELSE array(n, greatest(n - 1, 1)) END"
    c = li.selectExpr("report_id", "n AS label", f"{ids} AS source_ids", "n <> 2 AS required")
    return invariants.citation_violations(c, li.where("p % 10 <> 0").selectExpr("report_id", "n AS source_id"))


_STATE = {
    "category_match": "CASE WHEN k % 3 = 0 THEN NULL ELSE k % 120 END",
    "change": "CASE WHEN available AND k % 12 <> 0 THEN 25 * s_risk END",
    "word_count": "CASE WHEN available OR k % 26 = 0 THEN k END",
    "is_https": "CASE WHEN available THEN true END",
    "skipped": "NOT available AND k % 39 <> 0",
    "audit_status": "CASE WHEN available THEN 'complete' ELSE 'unavailable' END",
    "signal_status": "CASE WHEN available AND k % 15 <> 0 THEN 'complete' ELSE 'unavailable' END",
}
_STATE_RULES = {
    "category_match_range": "category_match NOT BETWEEN 0 AND 100", "final_score_missing": "available AND NOT is_chain AND final_score IS NULL", "change_missing": "available AND change IS NULL", "word_count_observed": "NOT available AND word_count IS NOT NULL",
    "chain_scored": "is_chain AND (final_score IS NOT NULL OR rnk IS NOT NULL)", "not_skipped": "NOT available AND NOT skipped", "audit_states": "audit_status <> signal_status", "tied": "(k % 2 = 0 AND rnk IS NOT NULL) <> (rnk IS NOT NULL AND ties > 1)",
}


@query(f"WITH {SCORED_SQL}, t AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _STATE.items())}, count(CASE WHEN rnk IS NOT NULL THEN final_score END) OVER (PARTITION BY market_id, CASE WHEN rnk IS NOT NULL THEN final_score END) AS ties FROM rk), v AS (SELECT market_id, id, {_rules(_STATE_RULES)} FROM t) SELECT * FROM v WHERE rule IS NOT NULL")
def record_state_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked records whose tie flags follow from their keys, so that the rule has work."""
    r = M._ranked(spark, sf).selectExpr("* EXCEPT (tied)", "k % 2 = 0 AND rank IS NOT NULL AS tied", *[f"{e} AS {n}" for n, e in _STATE.items()])
    return invariants.record_state_violations(r, ("word_count", "is_https"))


_STATES = "CASE WHEN NOT available THEN 'unavailable' WHEN k % 6 = 0 THEN 'partial' ELSE 'complete' END"
_OUTCOME_SQL = "CASE WHEN is_chain THEN 'chain' WHEN scored THEN 'scored' WHEN website IS NULL THEN 'no_website' WHEN k % 5 = 0 THEN 'not_attempted' ELSE 'failed' END"
_COUNTS_SQL = f"oc AS (SELECT *, {_OUTCOME_SQL} AS o, {_STATES} AS st, rnk IS NOT NULL AND count(CASE WHEN scored THEN 1 END) OVER (PARTITION BY market_id, CASE WHEN scored THEN final_score END) > 1 AS tied FROM rk), cn AS (SELECT market_id, count(*) AS n, count_if(scored) AS n_scored, count_if(st = 'unavailable') AS failed, count_if(st = 'partial') AS limited, count_if(o = 'failed') AS o_failed, coalesce(bool_or(CASE WHEN is_user THEN tied END), false) AS your_tied, " + ", ".join(f"count_if(NOT is_user AND o = '{o}') AS {c}" for o, c in (("chain", "chains"), ("scored", "scored"), ("no_website", "no_website"), ("not_attempted", "not_attempted"), ("failed", "audit_failed"))) + " FROM oc GROUP BY market_id)"
_SUMMARY_RULES = {
    "competitors": "market_id % 3 = 0", "audited": "summ.audited <> n_scored", "average_website": "floor(w) <> average_website", "average_final": "floor(f) <> average_final", "your_rank": "market_id % 4 = 0 AND summ.your_rank IS NOT NULL", "your_tied": "your_tied",
    "market_gap": "floor(u) - floor(f) <> market_gap", "status": "status IS DISTINCT FROM CASE WHEN u >= 80 THEN 'leading' WHEN u >= 65 THEN 'competitive' WHEN u >= 45 THEN 'recoverable' WHEN u IS NOT NULL THEN 'low_visibility' END",
    "failed": "cn.failed <> o_failed", "audit_failed": "audit_failed <> o_failed",
}


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return M._outcomes(spark, sf).selectExpr("*", f"{_STATES} AS audit_status")


@query(f"WITH {M._SUMMARY}, {_COUNTS_SQL}, v AS (SELECT market_id, {_rules(_SUMMARY_RULES)} FROM summ JOIN g USING (market_id) JOIN cn USING (market_id)) SELECT * FROM v WHERE rule IS NOT NULL")
def summary_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries that count the user, cut halves off and take the status from the score alone."""
    r = _outcomes(spark, sf)
    other = F.col("scored") & ~F.col("is_user")
    avg = lambda c: F.floor(F.avg(F.when(other, F.col(c))))
    mine = lambda c: F.max(F.when(F.col("is_user") & F.col("scored"), F.col(c)))
    true = market.outcome_counts(r.where("NOT is_user")).select("market_id", "chains", "scored", "no_website", "not_attempted")
    count = F.count_if(F.col("outcome").startswith("failed"))
    said = r.groupBy("market_id").agg(
        F.when(F.col("market_id") % 3 == 0, F.count("*")).otherwise(F.count("*") - 1).alias("competitors"), F.count_if("scored").alias("audited"), avg("website_score").alias("average_website"), avg("final_score").alias("average_final"),
        F.when(F.col("market_id") % 4 != 0, mine("rank")).alias("your_rank"), F.lit(False).alias("your_tied"), (mine("final_score") - avg("final_score")).alias("market_gap"), scoring.score_band(mine("final_score")).alias("status"),
        count.alias("failed"), F.count_if(F.col("audit_status") == "partial").alias("limited"), count.alias("audit_failed"),
    )
    return invariants.summary_violations(said.join(true, "market_id"), r)


_NOTE = """WITH {summary}, {counts} SELECT market_id,
    CASE WHEN cn.failed = 0 THEN 'Full' WHEN cn.failed < n THEN 'Limited' ELSE 'No' END || ' coverage.' || CASE WHEN summ.competitors > 0 THEN ' Nearby: ' || concat_ws(', ', cn.scored || ' scored', CASE WHEN no_website > 0 THEN no_website || ' without a website' END, CASE WHEN audit_failed > 0 THEN audit_failed || CASE WHEN audit_failed = 1 THEN ' failed audit' ELSE ' failed audits' END END, CASE WHEN not_attempted > 0 THEN not_attempted || ' beyond the audit limit' END, CASE WHEN chains > 0 THEN chains || CASE WHEN chains = 1 THEN ' chain location' ELSE ' chain locations' END END) || '.' ELSE '' END
        || CASE WHEN limited > 0 THEN ' ' || limited || CASE WHEN limited = 1 THEN ' audit' ELSE ' audits' END || ' saw the homepage only.' ELSE '' END AS quality,
    'Found ' || summ.competitors || CASE WHEN summ.competitors = 1 THEN ' business' ELSE ' businesses' END || ' nearby; ' || summ.audited || ' could be scored. What was not observed is N/A and never zero.' AS summary,
    CASE WHEN market_id % 2 = 0 THEN NULL WHEN u IS NULL THEN 'Nothing to act on: the own audit was unavailable.' WHEN summ.audited = 0 THEN 'Nothing to act on: no other business was scored.' ELSE 'No gap: every element checked was seen.' END AS action
FROM summ JOIN g USING (market_id) JOIN cn USING (market_id)"""


@query(_NOTE.format(summary=M._SUMMARY, counts=_COUNTS_SQL))
def report_notes(spark: SparkSession, sf: str) -> DataFrame:
    r = _outcomes(spark, sf)
    n = F.when(F.col("market_id") % 2 == 0, 1).otherwise(0)
    return report.report_notes(r, r.select("market_id", n.alias("n_recommendations")).distinct())
