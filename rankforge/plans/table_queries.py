"""Queries on requests, events, orders and conversations: resolution, news, provenance, reports, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, entity, provenance, resolve, signals
from ..sources import reports
from ..streaming import quota
from .bindings import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("ord"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"))


@query("WITH e AS (SELECT event_id, user_id, ts, floor(epoch(ts) / 86400)::BIGINT * 86400 AS w FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, w ORDER BY ts, event_id) AS n FROM e) SELECT event_id AS ord, user_id AS key, n <= 2 AS admitted, (n - 1)::BIGINT AS used_before, w + 86400 AS reset_s FROM n")
def quota_tumbling(spark, sf):
    q = quota.quota_tumbling(_events(spark, sf), 86400, 2)
    return q.select("ord", "key", "admitted", "used_before", F.unix_seconds("reset_at").alias("reset_s"))


@query("WITH RECURSIVE e AS (SELECT event_id AS ord, user_id AS key, epoch_us(ts) AS t FROM events), w(key, no, s) AS (SELECT key, 1::BIGINT, min(t) FROM e GROUP BY key UNION ALL SELECT * FROM (SELECT key, no + 1, (SELECT min(t) FROM e WHERE e.key IS NOT DISTINCT FROM w.key AND t >= s + 86400000000) AS s FROM w) WHERE s IS NOT NULL), j AS (SELECT ord, e.key, no, s, t, row_number() OVER (PARTITION BY e.key, no ORDER BY t, ord) AS n FROM e JOIN w ON e.key IS NOT DISTINCT FROM w.key AND t >= s AND t < s + 86400000000) SELECT ord, key, no AS window_no, n <= 2 AS admitted, greatest(0, 2 - n) AS remaining, (s + 86400000000 - t) // 1000 AS reset_ms FROM j")
def quota_anchored(spark, sf):
    return quota.quota_anchored(_events(spark, sf), 86400, 2).select("ord", "key", "window_no", "admitted", "remaining", "reset_ms")


@query("WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), l AS (SELECT *, CASE WHEN day - lag(day) OVER (ORDER BY day) < 2 THEN 0 ELSE 1 END AS new FROM d), s AS (SELECT *, sum(new) OVER (ORDER BY day) AS life FROM l) SELECT life::BIGINT AS life, min(day) AS first_day, max(day) AS last_day, sum(n)::BIGINT AS n_events FROM s GROUP BY 1")
def retention_sessions(spark, sf):
    return quota.retention_sessions(_events(spark, sf), 2)


@query("WITH r AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderdate + to_days((o_orderkey % 500)::INTEGER) AS a, o_orderkey % 2 = 0 AS live_failed FROM orders), j AS (SELECT id, k, a, live_failed, max(o_orderdate) AS s FROM r LEFT JOIN orders ON o_custkey = k AND o_orderkey % 3 = 0 AND o_orderdate <= a AND date_diff('microsecond', o_orderdate::TIMESTAMP, a::TIMESTAMP) / 3.6e9 <= 8760 GROUP BY ALL), t AS (SELECT *, CASE WHEN s IS NULL THEN 'none' WHEN date_diff('microsecond', s::TIMESTAMP, a::TIMESTAMP) / 3.6e9 <= 2190 THEN 'fresh' WHEN live_failed THEN 'stale' ELSE 'none' END AS state FROM j) SELECT id, k AS key, state, CASE WHEN state <> 'none' THEN epoch(s)::BIGINT END AS snapshot_s FROM t")
def asof_snapshot(spark, sf):
    """Every order asks, up to 500 days after it was made, for its customer's last saved answer; every third order saved one."""
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    r = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), (day + F.make_dt_interval(days=(F.col("o_orderkey") % 500).cast("int"))).alias("as_of"), (F.col("o_orderkey") % 2 == 0).alias("live_failed"))
    saved = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("key"), day.alias("saved_at"))
    return entity.asof_snapshot(r, saved, 2190, 8760).select("id", "key", "state", F.unix_seconds(F.col("snapshot_at").cast("timestamp")).alias("snapshot_s"))


def _uses(spark: SparkSession, sf: str) -> DataFrame:
    s = "CASE event_id % 3 WHEN 0 THEN 'used' WHEN 1 THEN 'limited' ELSE 'unavailable' END"
    return table(spark, sf, "events").selectExpr("user_id AS report_id", "event_id AS seq", "event_type AS kind", "concat('p', cast(event_id % 4 as string)) AS provider", "event_type AS title", "CASE WHEN event_id % 5 <> 0 THEN concat('https://Ex.com/', cast(event_id % 7 as string), '/') END AS url", "concat('B', cast(event_id % 3 as string)) AS business", f"{s} AS status")


_USES = "us AS (SELECT user_id AS report_id, event_id AS seq, event_type AS kind, concat('p', event_id % 4) AS provider, CASE WHEN event_id % 5 <> 0 THEN concat('https://Ex.com/', event_id % 7, '/') END AS url, concat('B', event_id % 3) AS business, CASE event_id % 3 WHEN 0 THEN 'used' WHEN 1 THEN 'limited' ELSE 'unavailable' END AS status FROM events)"
_REG = f"{_USES}, ks AS (SELECT *, CASE WHEN url IS NOT NULL THEN 'u|' || rtrim(lower(url), '/') ELSE concat_ws('|', 'k', lower(kind), provider, lower(kind), lower(business)) END AS key FROM us), g AS (SELECT report_id, key, min(seq) AS seq, arg_min(kind, seq) AS kind, arg_min(provider, seq) AS provider, arg_min(business, seq) AS business, count(DISTINCT lower(business)) AS n, arg_max(status, seq) AS last, max(CASE status WHEN 'unavailable' THEN 1 WHEN 'limited' THEN 2 ELSE 3 END) AS best FROM ks GROUP BY ALL), reg AS (SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY seq)::INTEGER AS source_id, kind, provider, CASE WHEN n < 2 THEN business END AS business, n >= 2 AS shared, CASE WHEN n < 2 THEN last ELSE ['unavailable', 'limited', 'used'][best] END AS status FROM g)"


@query(f"WITH {_REG} SELECT * FROM reg")
def source_registry(spark, sf):
    return provenance.source_registry(_uses(spark, sf)).select("report_id", "source_id", "kind", "provider", "business", "shared", "status")


@query(f"WITH {_REG} SELECT report_id, provider, count(*)::BIGINT AS n_sources FROM reg WHERE status <> 'unavailable' GROUP BY ALL")
def provider_counts(spark, sf):
    return provenance.provider_counts(provenance.source_registry(_uses(spark, sf)))


@query(f"WITH {_REG}, c AS (SELECT user_id AS report_id, (event_id % 40 + 1)::INTEGER AS source_id FROM events) SELECT c.report_id, 'unknown_source' AS rule, c.source_id FROM c LEFT JOIN reg USING (report_id, source_id) WHERE reg.source_id IS NULL")
def source_violations(spark, sf):
    c = table(spark, sf, "events").selectExpr("user_id AS report_id", "cast(event_id % 40 + 1 as int) AS source_id")
    return provenance.source_violations(provenance.source_registry(_uses(spark, sf)), c)


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr("p_partkey AS request_id", "p_name AS business_name", "concat(CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'ftp://' ELSE 'https://' END, 'p', cast(p_partkey % 50 as string), '.example') AS business_url", "CASE WHEN p_partkey % 15 = 0 THEN concat('<', chr(9), 'x', '>') ELSE p_type END AS business_type", "CASE p_partkey % 8 WHEN 0 THEN 'Thon' WHEN 4 THEN 'Thon, C' WHEN 6 THEN ' , Thon' ELSE concat('Thon', cast(p_partkey % 10 as string), ', CA, ') END AS market")


_VIOLATIONS = "CASE WHEN length(n) > 80 THEN 'business_name:too_long' END, CASE WHEN length(trim(n)) < 2 THEN 'business_name:too_short' END, CASE WHEN k % 15 <> 0 AND length(t) > 80 THEN 'business_type:too_long' END, CASE WHEN k % 15 = 0 {short} THEN 'business_type:too_short' END, CASE WHEN k % 9 < 2 THEN 'business_url:not_http' END, CASE WHEN k % 8 IN (0, 4, 6) THEN 'market:no_region' END"
_MESSAGE = "CASE WHEN k % 9 < 2 THEN 'business_url:not_http' WHEN k % 8 IN (0, 4, 6) THEN 'market:no_region' WHEN v <> '' THEN 'invalid' END"


@query(f"WITH r AS (SELECT p_partkey AS k, p_name AS n, p_type AS t FROM part), v AS (SELECT *, concat_ws(',', {_VIOLATIONS.format(short='')}) AS v FROM r) SELECT k AS request_id, v AS violations, {_MESSAGE} AS message FROM v")
def validate_requests(spark, sf):
    return resolve.validate_requests(_requests(spark, sf)).select("request_id", F.array_join("violations", ",").alias("violations"), "message")


@query(f"WITH r AS (SELECT p_partkey AS k, p_name AS n, p_type AS t FROM part), v AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'body:not_object' ELSE concat_ws(',', CASE WHEN k % 11 = 0 THEN 'unknown:a,unknown:b' END, CASE WHEN k % 13 < 3 THEN 'business_type:not_text' END, {_VIOLATIONS.format(short='AND k % 13 > 2')}) END AS v FROM r) SELECT k AS request_id, v AS violations, CASE WHEN k % 17 = 0 THEN 'invalid' ELSE {_MESSAGE} END AS message FROM v")
def read_requests(spark, sf):
    """Requests as JSON bodies: some with unknown keys, a business type that is no text or absent, or cut short."""
    r = _requests(spark, sf)
    k = F.col("request_id")
    known = lambda kind: F.struct(F.col("business_name").alias("businessName"), F.col("business_url").alias("businessUrl"), *kind, "market")
    texts = F.to_json(known([F.col("business_type").alias("businessType")]))
    body = F.when(k % 13 == 0, F.to_json(known([k.alias("businessType")]))).when(k % 13 == 1, F.to_json(known([F.array("business_type").alias("businessType")]))).when(k % 13 == 2, F.to_json(known([]))).otherwise(texts)
    body = F.when(k % 17 == 0, F.left(body, F.length(body) - 1)).when(k % 11 == 0, F.concat(F.lit('{"b": 1, "a": null, '), F.substr(body, F.lit(2)))).otherwise(body)
    v = resolve.validate_requests(resolve.read_requests(r.select("request_id", body.alias("body"))))
    return v.select("request_id", F.array_join("violations", ",").alias("violations"), "message")


def _category_map(spark: SparkSession) -> DataFrame:
    rows = [("copper", 0, "craft", "metal"), ("copper", 1, "shop", "metal"), ("anodized tin", 0, "craft", "tin"), ("brushed", 0, None, None), ("small plated copper", 0, "shop", "plated")]
    return spark.createDataFrame(rows, "keyword string, ord int, key string, value string")


#: What follows a part's type in a request's industry; both engines read it alike.
_TRADE = "CASE p_partkey % 7 WHEN 1 THEN ' plated  copper' WHEN 2 THEN ' & Anodized Tin' WHEN 3 THEN ' brushed' WHEN 4 THEN ' tin for the copper' WHEN 5 THEN ' copper, brushed' WHEN 6 THEN ' and the tool' ELSE '' END"
_STOP = "('and', 'the', 'of', 'for', 'in', 'a')"


@query(f"""WITH r AS (SELECT p_partkey AS k, string_split(trim(regexp_replace(lower(p_type || {_TRADE}), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM part),
c AS (SELECT *, [x FOR x IN w IF x NOT IN {_STOP}] AS cw FROM r),
tries AS (SELECT k, 1 AS stage, 0 AS a, 0 AS b, array_to_string(w, ' ') AS phrase FROM r UNION ALL SELECT k, 2, -3, i, array_to_string(w[i + 1:i + 3], ' ') FROM r, unnest(range(0, len(w) - 2)) t(i)
    UNION ALL SELECT k, 2, -2, i, array_to_string(w[i + 1:i + 2], ' ') FROM r, unnest(range(0, len(w) - 1)) t(i) UNION ALL SELECT k, 3, 0, -i, cw[i] FROM c, unnest(range(1, len(cw) + 1)) t(i)),
known(phrase, n) AS (VALUES ('copper', 2), ('anodized tin', 1), ('brushed', 0), ('small plated copper', 1)),
hit AS (SELECT k, phrase, n FROM tries JOIN known USING (phrase) QUALIFY row_number() OVER (PARTITION BY k ORDER BY stage, a, b) = 1),
probe AS (SELECT k, 6 * len(list_distinct(CASE WHEN len(cw) > 1 THEN [array_to_string(cw, '_')] ELSE [] END || cw)) AS m FROM c)
SELECT k AS request_id, CASE WHEN n > 0 THEN 'map' WHEN n = 0 OR m = 0 THEN 'none' ELSE 'probe' END AS stage, phrase AS keyword, least(24, coalesce(n, m))::INTEGER AS n_tags FROM probe LEFT JOIN hit USING (k)""")
def resolve_industry(spark, sf):
    requests = table(spark, sf, "part").selectExpr("p_partkey AS request_id", f"concat(p_type, {_TRADE}) AS business_type")
    r = resolve.resolve_industry(requests, _category_map(spark))
    return r.select("request_id", "stage", "keyword", F.size("tags").alias("n_tags"))


@query()
def resolve_market(spark, sf):
    s = table(spark, sf, "supplier")
    g = s.selectExpr("s_nationkey AS market_id", "cast(s_suppkey as int) AS input_rank", "s_name AS display_name", "CASE WHEN s_suppkey % 5 = 0 THEN 'county' ELSE 'city' END AS addresstype", "s_suppkey * 37 % 101 / 100D AS importance", "'us' AS country", "concat('st', cast(s_suppkey % 3 as string)) AS state", "array(concat('st', cast(s_suppkey % 3 as string))) AS regions")
    r = table(spark, sf, "nation").selectExpr("n_nationkey AS market_id", "concat(n_name, ', st', cast(n_nationkey % 4 as string)) AS market")
    return resolve.resolve_market(r, g)


SQL["resolve_market"] = "WITH g AS (SELECT s_nationkey AS market_id, s_suppkey AS r, s_name AS dn, s_suppkey * 37 % 101 / 100e0 AS imp, 'st' || s_suppkey % 3 AS st, 'st' || s_suppkey % 3 = 'st' || s_nationkey % 4 AS fits FROM supplier WHERE s_suppkey % 5 <> 0), p AS (SELECT * FROM g QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY market_id)), n AS (SELECT *, row_number() OVER w AS n, first_value(imp) OVER w AS top, first_value(st) OVER w AS ts FROM p WINDOW w AS (PARTITION BY market_id ORDER BY imp DESC, r)), a AS (SELECT market_id, bool_or(n > 1 AND st <> ts AND top > 0 AND imp >= top * 0.85e0) AS amb, arg_min(dn, n) AS dn, string_agg(dn, '; ' ORDER BY n) FILTER (WHERE n = 1 OR (st <> ts AND top > 0 AND imp >= top * 0.85e0)) AS labels FROM n GROUP BY 1) SELECT n_nationkey AS market_id, CASE WHEN amb IS NULL THEN 'not_found' WHEN amb THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN NOT amb THEN dn END AS display_name, CASE WHEN amb THEN labels END AS labels FROM nation LEFT JOIN a ON market_id = n_nationkey"


@query("SELECT c_custkey AS market_id, CASE WHEN c_custkey % 7 = 0 THEN 'not_found' WHEN c_custkey % 5 = 0 THEN 'type_unresolved' WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'no_competitors' ELSE 'type_unresolved' END WHEN c_custkey % 11 = 0 THEN 'subject_unavailable' ELSE 'ok' END AS code, c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 11 = 0 AS retryable FROM customer")
def market_status(spark, sf):
    s = table(spark, sf, "customer").selectExpr("c_custkey AS market_id", "CASE WHEN c_custkey % 7 = 0 THEN 'not_found' ELSE 'ok' END AS geo_status", "CASE WHEN c_custkey % 5 = 0 THEN 'none' WHEN c_custkey % 2 = 0 THEN 'map' ELSE 'probe' END AS industry_stage", "CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 4 END AS n_competitors", "CASE WHEN c_custkey % 11 = 0 THEN 'timeout' END AS subject_failure")
    return resolve.market_status(s).select("market_id", "code", F.coalesce("retryable", F.lit(False)).alias("retryable"))


@query(r"WITH e AS (SELECT conv_id * 1000 + turn AS o, lower(trim(concat(role, cast(conv_id % 50 AS VARCHAR), '@x.org '))) AS email, role, CASE WHEN turn % 2 = 0 THEN text END AS m FROM conversations) SELECT email, min(o) AS first_ord, min_by(role, o) AS source, count(*)::BIGINT AS n_events, string_agg('[' || o || '] ' || trim(m), chr(10) ORDER BY o) FILTER (WHERE trim(m) <> '') AS messages FROM e GROUP BY email")
def merge_signups(spark, sf):
    e = table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS event_ord", "concat(role, cast(conv_id % 50 as string), '@x.org ') AS email", "role AS source", "CASE WHEN turn % 2 = 0 THEN text END AS message")
    return reports.merge_signups(e).select("email", "first_ord", "source", "n_events", "messages")


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'v2' ELSE 'legacy' END AS generation, count(*)::BIGINT AS n_reports, sum(CASE WHEN event_id % 10 <> 0 THEN event_id % 8 END)::BIGINT AS n_competitors, count_if(event_id % 10 = 0)::BIGINT AS n_unreadable FROM events WHERE event_id % 3 <> 2 GROUP BY 1")
def report_volume(spark, sf):
    s = table(spark, sf, "events").selectExpr("concat(CASE event_id % 3 WHEN 0 THEN 'report:v2:' WHEN 1 THEN 'report:' ELSE 'other:' END, cast(event_id as string)) AS key", "CASE WHEN event_id % 10 = 0 THEN '{broken' ELSE concat('{\"report\":{\"summary\":{\"competitorCount\":', cast(event_id % 8 as string), '}}}') END AS payload")
    return reports.report_volume(s)


@query("SELECT event_id AS report_id, CASE event_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'legacy' WHEN 2 THEN 'ok' ELSE 'invalid' END AS status FROM events")
def report_read_status(spark, sf):
    s = table(spark, sf, "events").selectExpr("cast(event_id as string) AS report_id", "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '{\"old\":1}' WHEN 2 THEN concat('{\"version\":2,\"id\":\"', cast(event_id as string), '\",\"createdAt\":\"2026-01-01T00:00:00Z\"}') ELSE '{\"version\":2,\"id\":\"x\",\"createdAt\":\"2026-01-01T00:00:00Z\"}' END AS payload")
    return reports.report_status(s).select(F.col("report_id").cast("bigint").alias("report_id"), "status")


_SNAP = "sn AS (SELECT o_orderkey AS id, o_orderdate AS generated_at, date_diff('microsecond', o_orderdate, TIMESTAMP '1997-01-01') / 3.6e9 AS age FROM orders), ok AS (SELECT * FROM sn WHERE age BETWEEN 0 AND 720)"


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("generated_at"))


@query(f"WITH {_SNAP}, a AS (SELECT id, generated_at, 'active' AS pool FROM ok WHERE age <= 72 ORDER BY generated_at DESC, id LIMIT 12) SELECT * FROM a UNION ALL SELECT id, generated_at, 'retained' FROM ok WHERE NOT EXISTS (SELECT 1 FROM a)")
def serving_pool(spark, sf):
    return reports.serving_pool(_snapshots(spark, sf), "1997-01-01")


@query(f"WITH {_SNAP} SELECT count_if(age <= 72)::BIGINT AS active, count(*)::BIGINT AS retained, floor(min(age) * 100 + 0.5e0) / 100 AS newest_h, floor(max(age) * 100 + 0.5e0) / 100 AS oldest_h, count_if(age <= 72) < 10 AS low_active, count_if(age <= 72) = 0 AS serving_retained, (SELECT count(*) FROM (SELECT DISTINCT o_orderkey AS id FROM orders) c WHERE id NOT IN (SELECT id FROM ok WHERE age <= 72))::BIGINT AS lacking FROM ok")
def pool_health(spark, sf):
    return reports.pool_health(_snapshots(spark, sf), _snapshots(spark, sf), "1997-01-01")


#: What a fetch met in each of twenty cases, beside a page of 200 OK: column, SQL value by event_id % 20.
_FETCH = {
    "timed_out": {2: "true"},
    "refusal": {3: "'dns_unresolved'", 4: "'dns_error'", 5: "'invalid_url'", 6: "'private_address'", 7: "'unsupported_scheme'"},
    "robots_allowed": {8: "false"},
    "status": {**{k: "cast(null as int)" for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)}, 12: "403", 13: "429", 14: "503", 15: "302", 16: "304"},
    "location": {15: "'/next'"},
    "error_codes": {1: "array('econnreset')", 9: "array('X', 'UND_ERR_CONNECT_TIMEOUT')", 10: "array('CERT_HAS_EXPIRED', 'EAI_NONAME')", 11: "array('EAI_AGAIN', 'EPROTO')"},
    "content_type": {17: "'image/png'"},
    "declared_length": {18: "2000000"},
    "word_count": {19: "39"},
}
_FETCH_ELSE = {"status": "200", "content_type": "'text/html; charset=utf-8'", "declared_length": "100", "word_count": "40"}


@query("SELECT event_id AS id, ['connection_failed', 'timeout', 'dns_unresolved', 'dns_error', 'invalid_url', 'blocked_url', 'blocked_url', 'robots_disallowed', 'timeout', 'dns_unresolved', 'tls_error', 'blocked_by_site', 'blocked_by_site', 'http_error', 'too_many_redirects', 'http_error', 'unsupported_content_type', 'too_large', 'insufficient_content'][event_id % 20] AS failure, CASE event_id % 20 WHEN 14 THEN '5xx' WHEN 16 THEN '3xx' END AS status_class FROM events")
def classify_fetch(spark, sf):
    cases = [f"CASE event_id % 20 {' '.join(f'WHEN {k} THEN {v}' for k, v in of.items())}{' ELSE ' + _FETCH_ELSE[c] if c in _FETCH_ELSE else ''} END AS {c}" for c, of in _FETCH.items()]
    return audit.classify_fetch(table(spark, sf, "events").selectExpr("event_id AS id", *cases)).select("id", "failure", "status_class")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 10 = 4 THEN 'warn' ELSE 'error' END AS severity FROM events")
def error_severity(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN 'ambiguous' END AS code", "100 * (event_id % 10) AS status")
    return signals.error_severity(e).select("event_id", "severity")


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("lang").alias("market_id"), F.col("doc_id").alias("article"), F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ").alias("title_norm"))


_NAMES = (("a", "of the"), ("b", "of the thon"), ("c", "the and"), ("d", "tion"), ("e", "de la"))


@query()
def attribute_articles(spark, sf):
    langs = table(spark, sf, "documents").select(F.col("lang").alias("market_id")).distinct()
    names = F.inline(F.array(*[F.struct(F.lit(i).alias("entity"), F.lit(n).alias("name_norm")) for i, n in _NAMES]))
    return signals.attribute_articles(_articles(spark, sf), signals.eligible_entities(langs.select("market_id", names)))


SQL["attribute_articles"] = "WITH a AS (SELECT lang AS market_id, doc_id AS article, regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') AS t FROM documents), e(entity, n) AS (VALUES ('a', 'of the'), ('b', 'of the thon'), ('c', 'the and'), ('d', 'tion'), ('e', 'de la')), h AS (SELECT * FROM a JOIN e ON contains(' ' || t || ' ', ' ' || n || ' ')), b AS (SELECT market_id, article, arg_max(entity, (length(n), n)) AS entity, arg_max(n, (length(n), n)) AS best, list(n) AS ns FROM h GROUP BY ALL) SELECT market_id, article, entity FROM b WHERE len(list_filter(ns, lambda x: NOT contains(' ' || best || ' ', ' ' || x || ' '))) = 0"


@query("WITH h AS (SELECT lang AS market_id, source AS entity, concat('u', doc_id % 700) AS url, doc_id AS ord FROM documents), f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY market_id, url ORDER BY ord) = 1), p AS (SELECT *, row_number() OVER (PARTITION BY market_id, entity ORDER BY ord) AS place FROM f) SELECT market_id, entity, url, ord, place::INTEGER AS place FROM p WHERE place <= 5")
def entity_news(spark, sf):
    h = table(spark, sf, "documents").selectExpr("lang AS market_id", "source AS entity", "concat('u', cast(doc_id % 700 as string)) AS url", "doc_id AS ord")
    return signals.entity_news(h).select("market_id", "entity", "url", "ord", "place")


@query("SELECT c_nationkey AS market_id, bool_and(c_custkey % 100 <> 0) AS news_counted FROM customer WHERE c_custkey % 11 <> 0 GROUP BY 1")
def news_coverage(spark, sf):
    r = table(spark, sf, "customer").selectExpr("c_nationkey AS market_id", "c_custkey % 11 <> 0 AS scored", "c_custkey % 100 <> 0 AS searched")
    return signals.news_coverage(r)


_ROBOTS = "User-agent: *\nDisallow: /es/\nDisallow: /*?utm_\n\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /es/*.html$\n"


@query()
def robots_allowed(spark, sf):
    """Each host's file holds a body of general rules and, for every seventh page of the host, its path, allowed or not, open or closed."""
    pages = table(spark, sf, "pages")
    u = pages.select(F.col("page_id").alias("id"), F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]+([^#]*)", 1).alias("path"))
    line = F.concat(F.when(F.col("id") % 2 == 0, "Disallow: ").otherwise("Allow: "), F.substring_index("path", "?", 1), F.when(F.col("id") % 3 == 0, "*=").when(F.col("id") % 3 == 1, "$").otherwise(""))
    own = u.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list(F.when((F.col("id") % 7 == 0) & (F.col("path") != ""), line))), "\n").alias("own"))
    robots = own.select("host", F.concat(F.lit(_ROBOTS), F.col("own")).alias("body"))
    return audit.robots_allowed(u, audit.robots_rules(robots, "bench", most=None))


SQL["robots_allowed"] = r"""WITH u AS (SELECT page_id AS id, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+([^#]*)', 1) AS path FROM pages),
r AS (SELECT host, id % 2 = 1 AS allow, string_split(path, '?')[1] || ['*=', '$', ''][id % 3 + 1] AS rule FROM u WHERE id % 7 = 0 AND path <> ''
    UNION SELECT host, allow, rule FROM (SELECT DISTINCT host FROM u), (VALUES (false, '/es/'), (false, '/*?utm_'), (true, '/es/*.html$')) v(allow, rule)),
x AS (SELECT *, '^' || array_to_string(list_transform(string_split(rtrim(rule, '$'), '*'), lambda p: regexp_escape(p)), '.*') || CASE WHEN rule LIKE '%$' THEN '$' ELSE '' END AS pattern FROM r),
b AS (SELECT id, arg_max(allow, (length(rule), allow)) AS allowed FROM u JOIN x ON u.host = x.host AND regexp_matches(CASE WHEN path = '' THEN '/' ELSE path END, pattern) GROUP BY id)
SELECT u.*, coalesce(allowed, true) AS allowed FROM u LEFT JOIN b USING (id)"""
