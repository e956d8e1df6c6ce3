"""Queries on report rows, sources and admissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import audit, entity, market, nested, provenance, report, report_rules, resolve, scoring, signals, spatial
from ..sources import pages as page_source
from ..sources import poi, reports
from ..streaming import admission
from . import market_queries as M
from .bindings import RECORDS_SQL, SCORED_SQL, records, scored_records, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _geojson(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    j = F.concat(F.lit('\x1e{"id":"'), F.when(F.col("k") % 4 == 0, "a").otherwise("n"), (F.col("k") % 1200).cast("string"), F.lit('","properties":{"name":"'), F.col("name"), F.lit('","shop":'), F.when(F.col("k") % 9 == 0, "7").otherwise(F.concat(F.lit('"'), F.col("tag_value"), F.lit('"'))), F.lit(',"source_ref":"x"},"geometry":{"coordinates":['), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]}}"))
    return r.select(F.col("k").alias("line_no"), j.alias("value"))


@query(f"WITH {RECORDS_SQL}, g AS (SELECT k, k % 1200 AS i, CASE WHEN k % 4 <> 0 THEN 'node' WHEN k % 1200 % 2 = 0 THEN 'way' ELSE 'relation' END AS osm_type, round(lat, 5) AS lat, round(lon, 5) AS lon, tag_value FROM rec0 WHERE k % 9 <> 0), n AS (SELECT *, CASE WHEN osm_type = 'node' THEN i ELSE i // 2 END AS osm_id FROM g) SELECT osm_type, osm_id, lat, lon, tag_value AS shop FROM n WHERE lat BETWEEN 37 AND 38 AND lon BETWEEN -123 AND -122 QUALIFY row_number() OVER (PARTITION BY osm_type, osm_id ORDER BY k) = 1")
def ingest_pois(spark, sf):
    good, _ = poi.ingest_pois(_geojson(spark, sf), (37.0, -123.0, 38.0, -122.0))
    return good.select("osm_type", "osm_id", "lat", "lon", F.try_element_at("tags", F.lit("shop")).alias("shop"))


@query(f"WITH {RECORDS_SQL} SELECT count_if(k % 9 = 0 OR NOT (round(lat, 5) BETWEEN 37 AND 38 AND round(lon, 5) BETWEEN -123 AND -122))::BIGINT AS rejected FROM rec0")
def rejected_pois(spark, sf):
    return poi.ingest_pois(_geojson(spark, sf), (37.0, -123.0, 38.0, -122.0))[1].agg(F.count("*").alias("rejected"))


@query(f"WITH {RECORDS_SQL} SELECT concat('node-', k) AS id, CASE WHEN k % 3 <> 0 THEN concat('https://s', k, '.example') END AS website, CASE WHEN k % 2 = 0 THEN 'p' END AS phone, concat(k % 90, ' Main') AS address, (CASE WHEN k % 3 <> 0 THEN 30e0 ELSE 0 END) + (CASE WHEN contains(tag_value, 'build') THEN 20e0 ELSE 0 END) + (CASE WHEN k % 2 = 0 THEN 20e0 ELSE 0 END) + 15 + least(5e0, (4 + (CASE WHEN k % 3 <> 1 THEN 1 ELSE 0 END) + (CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END) + (CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)) / 2e0) AS priority_score FROM rec0")
def poi_candidates(spark, sf):
    r = records(spark, sf)
    n = F.col("k").cast("string")
    pairs = [("name", F.col("name")), ("shop", F.col("tag_value")), ("addr:housenumber", (F.col("k") % 90).cast("string")), ("addr:street", F.lit("Main")), ("website", F.when(F.col("k") % 3 == 0, F.lit("bad url")).when(F.col("k") % 3 == 2, F.concat(F.lit("https://s"), n, F.lit(".example")))), ("contact:website", F.when(F.col("k") % 3 == 1, F.concat(F.lit("s"), n, F.lit(".example")))), ("phone", F.when(F.col("k") % 2 == 0, F.lit("p")))]
    tags = F.map_filter(F.map_from_arrays(F.array(*[F.lit(a) for a, _ in pairs]), F.array(*[b for _, b in pairs])), lambda a, b: b.isNotNull())
    p = r.select(F.lit("node").alias("osm_type"), F.col("k").alias("osm_id"), "lat", "lon", tags.alias("tags"))
    return entity.poi_candidates(p, F.lit("build")).select("id", "website", "phone", "address", "priority_score")


@query(f"WITH {RECORDS_SQL} SELECT id, CASE WHEN k % 7 = 0 THEN NULL WHEN tag_value NOT IN ('building', 'machinery') THEN 0e0 WHEN contains(tag_value, 'build') THEN 1e0 ELSE 0.5e0 END AS category_match FROM rec0")
def category_match(spark, sf):
    pairs = F.array(*[F.struct(F.lit("shop").alias("key"), F.lit(v).alias("value")) for v in ("building", "machinery")])
    tags = F.when(F.col("k") % 7 != 0, F.create_map(F.lit("shop"), F.concat(F.lit("x; "), F.col("tag_value"))))
    return records(spark, sf).select("id", scoring.category_match(tags, pairs, F.lit("build co")).alias("category_match"))


@query("SELECT n_nationkey AS market_id, 37e0 + n_nationkey / 50e0 - (n_nationkey * 1000e0 / 111320) >= 37 AND 37e0 + n_nationkey / 50e0 + (n_nationkey * 1000e0 / 111320) <= 37.4e0 AND -122e0 - (n_nationkey * 1000e0 / 111320) / cos(radians(37e0 + n_nationkey / 50e0)) >= -122.3e0 AND -122e0 + (n_nationkey * 1000e0 / 111320) / cos(radians(37e0 + n_nationkey / 50e0)) <= -121.8e0 AS covered FROM nation")
def box_covers(spark, sf):
    m = table(spark, sf, "nation").selectExpr("n_nationkey AS market_id", "37D + n_nationkey / 50D AS lat", "-122D AS lon", "cast(n_nationkey as double) AS radius_km", "37D AS r_south", "37.4D AS r_north", "-122.3D AS r_west", "-121.8D AS r_east")
    return spatial.box_covers(m).select("market_id", "covered")


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.explode(F.array(*[F.lit(c) for c in ("change", "offer", "risk")])).alias("category")
    s = records(spark, sf).select("market_id", "id", "k", kinds)
    return s.where("k % length(category) < 2").withColumn("label", F.concat("category", F.lit("!")))


_SIGS = "sg AS (SELECT market_id, id, arg_min(c || '!', o) AS signal FROM rk, (VALUES ('change', 5), ('offer', 2), ('risk', 4)) v(c, o) WHERE k % length(c) < 2 GROUP BY ALL)"


@query(f"WITH {SCORED_SQL}, {_SIGS}, t AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY final_score DESC, id) AS place FROM rk WHERE scored AND NOT is_user) SELECT market_id, place::INTEGER AS place, id, signal FROM t LEFT JOIN sg USING (market_id, id) WHERE place <= 5")
def highlights(spark, sf):
    return report.highlights(M._ranked(spark, sf), _signals(spark, sf))


@query(f"WITH {SCORED_SQL}, {_SIGS}, ti AS (SELECT *, rnk IS NOT NULL AND count(CASE WHEN scored THEN 1 END) OVER (PARTITION BY market_id, CASE WHEN scored THEN final_score END) > 1 AS tied, row_number() OVER (PARTITION BY market_id ORDER BY rnk NULLS LAST, is_user DESC, ord) AS place FROM rk) SELECT market_id, place::INTEGER AS place, id, CASE WHEN rnk IS NULL THEN 'unranked' ELSE (CASE WHEN tied THEN 'tied #' ELSE '#' END) || rnk END AS rank, coalesce(cast(final_score AS VARCHAR), 'N/A') AS score, coalesce(signal, '-') AS signal FROM ti LEFT JOIN sg USING (market_id, id) WHERE place <= 10")
def report_tables(spark, sf):
    return report.snapshot_rows(M._ranked(spark, sf), _signals(spark, sf))


@query(f"WITH {SCORED_SQL}, s AS (SELECT market_id, CASE WHEN NOT available THEN 'unavailable' WHEN k % 6 = 0 THEN 'partial' ELSE 'complete' END AS st, * EXCLUDE (market_id) FROM rec), g AS (SELECT market_id, count_if(st = 'unavailable')::BIGINT AS failed, count_if(st = 'partial')::BIGINT AS partial, count(*)::BIGINT AS n, concat_ws(',', CASE WHEN count(*) > count(p_website) THEN 'website' END, CASE WHEN count(*) > count(p_listing) THEN 'listing' END, CASE WHEN count(*) > count(p_contact) THEN 'contact' END) AS fields FROM s GROUP BY market_id) SELECT *, CASE WHEN failed = 0 THEN 'full' WHEN failed < n THEN 'limited' ELSE 'none' END AS coverage FROM g")
def data_quality(spark, sf):
    r = scored_records(spark, sf).withColumn("audit_status", F.when(~F.col("available"), "unavailable").when(F.col("k") % 6 == 0, "partial").otherwise("complete"))
    q = report.data_quality(r.select("market_id", "audit_status", "p_website", "p_listing", "p_contact"))
    return q.select("market_id", "failed", "partial", "n", F.array_join("unavailable_fields", ",").alias("fields"), "coverage")


@query(f"WITH {M._SUMMARY} SELECT market_id, (CASE WHEN your_rank IS NULL THEN 'No rank: too few scored businesses.' ELSE 'Place ' || your_rank || ' among ' || (audited + 1) || CASE WHEN audited + 1 = 1 THEN ' scored business.' ELSE ' scored businesses.' END END) || (CASE WHEN market_gap IS NULL THEN '' ELSE ' Difference to the average: ' || CASE WHEN market_gap > 0 THEN '+' ELSE '' END || market_gap || ' points.' END) AS text FROM summ")
def report_text(spark, sf):
    return report.position_text(market.market_summary(M._ranked(spark, sf)))


@query("WITH n AS (SELECT c_nationkey AS market_id, array_agg(c_name ORDER BY c_name) AS ns FROM customer GROUP BY 1) SELECT market_id, CASE WHEN len(ns) = 1 THEN ns[1] WHEN len(ns) <= 3 THEN array_to_string(ns[1:len(ns) - 1], ', ') || ' and ' || ns[-1] ELSE array_to_string(ns[1:3], ', ') || ' and ' || (len(ns) - 3) || ' more' END AS names FROM n")
def format_metrics(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("market_id"), F.col("c_name").alias("name"))
    return report.market_names(c).select("market_id", "names")


@query("WITH c AS (SELECT o_custkey AS report_id, count(*) AS n FROM orders GROUP BY 1) SELECT report_id, n >= 10 AND n % 7 >= 2 AND n % 11 >= 3 AND n % 5 >= 1 AS deep FROM c")
def report_depth(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("report_id")).agg(F.count("*").alias("n_sources")).selectExpr("*", "n_sources % 7 AS n_ranked", "n_sources % 11 AS n_competitors", "n_sources % 5 AS n_recommendations")
    return report.report_depth(c).select("report_id", "deep")


@query("WITH c AS (SELECT o_custkey AS report_id, count(*) AS n FROM orders GROUP BY 1) SELECT report_id, concat_ws(',', CASE WHEN n % 3 > 0 THEN 'invariants' END, CASE WHEN n % 2 = 0 THEN 'user_audit' END, CASE WHEN n % 6 < 4 THEN 'competitors' END, CASE WHEN n % 5 < 2 THEN 'complete_audits' END) AS violations FROM c")
def snapshot_gate(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("report_id")).agg(F.count("*").alias("n")).selectExpr("report_id", "n % 3 AS n_rule_violations", "CASE WHEN n % 2 = 0 THEN 'partial' ELSE 'complete' END AS user_status", "n % 6 AS n_competitors", "n % 5 AS n_complete")
    return provenance.snapshot_gate(c).select("report_id", F.array_join("violations", ",").alias("violations"))


@query("SELECT s_suppkey AS id, ord::INTEGER AS ord, CASE WHEN ord > 0 THEN 'linked_page' WHEN s_suppkey % 4 = 0 THEN 'failed_audit' ELSE 'homepage' END AS kind, CASE WHEN ord > 0 THEN CASE WHEN (s_suppkey + ord) % 3 = 0 THEN 'low' ELSE 'medium' END WHEN s_suppkey % 4 = 0 THEN 'low' ELSE 'high' END AS confidence FROM supplier, (VALUES (0), (1), (2)) v(ord) WHERE (ord = 0 AND s_suppkey % 10 <> 0) OR (ord > 0 AND s_suppkey % 4 <> 0)")
def evidence(spark, sf):
    s = table(spark, sf, "supplier")
    a = s.selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 10 <> 0 THEN s_name END AS url", "CASE WHEN s_suppkey % 4 = 0 THEN 'unavailable' ELSE 'complete' END AS status")
    f = s.where("s_suppkey % 4 <> 0").selectExpr("s_suppkey AS id", "explode(array(1, 2)) AS ord", "s_name AS url").selectExpr("*", "(id + ord) % 3 = 0 AS failed")
    return report.evidence(a, f).select("id", "ord", "kind", "confidence")


@query("SELECT page_id, 'unavailable' AS audit_status, 27 AS n_null, (page_id % 3 > 0)::INTEGER AS n_evidence, CASE WHEN page_id % 3 > 0 THEN concat('No audit of the website: ', CASE WHEN page_id % 5 = 0 THEN 'unknown' ELSE 'status ' || 400 + page_id % 7 END, '.') END AS claim, CASE WHEN page_id % 3 > 0 THEN url END AS source_url, CASE WHEN page_id % 3 > 0 THEN 'low' END AS confidence FROM pages")
def failed_audits(spark, sf):
    """Every page as an audit that failed: without a source list, with an empty one, or with sources."""
    f = table(spark, sf, "pages").selectExpr("page_id", "url", "CASE WHEN page_id % 5 <> 0 THEN concat('status ', cast(400 + page_id % 7 as string)) END AS reason", "'http_error' AS reason_code", "CASE WHEN page_id % 3 > 0 THEN array(page_id, page_id + 1) WHEN page_id % 2 = 0 THEN array() END AS source_ids")
    out, item = report.failed_audits(f), F.get("evidence", F.lit(0))
    nulls = sum((F.col(m).isNull().cast("int") for m in report.METRICS), F.lit(0)).alias("n_null")
    return out.select("page_id", "audit_status", nulls, F.size("evidence").alias("n_evidence"), *[item[c].alias(c) for c in ("claim", "source_url", "confidence")])


@query("WITH e AS (SELECT s_suppkey AS id, ord, CASE WHEN ord > 0 THEN 'linked_page' ELSE 'homepage' END AS kind, CASE WHEN (s_suppkey + ord) % 3 = 0 THEN 'low' ELSE 'high' END AS conf, s_suppkey % 50 + ord AS sid FROM supplier, (VALUES (0), (1), (2)) v(ord)) SELECT id, coalesce(max(CASE WHEN kind = 'homepage' AND conf <> 'low' THEN sid END), min(CASE WHEN ord = 0 THEN sid END))::VARCHAR AS ids FROM e GROUP BY id")
def observation_ids(spark, sf):
    e = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "explode(array(0, 1, 2)) AS ord").selectExpr("id", "ord", "CASE WHEN ord > 0 THEN 'linked_page' ELSE 'homepage' END AS kind", "CASE WHEN (id + ord) % 3 = 0 THEN 'low' ELSE 'high' END AS confidence", "array(id % 50 + ord) AS source_ids")
    return provenance.observation_ids(e).select("id", F.array_join(F.transform("source_ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(r"SELECT event_id AS report_id, unnest(list_distinct(regexp_extract_all(props, '\"[a-z]\"'))) AS found FROM events")
def forbidden_values(spark, sf):
    r = table(spark, sf, "events").select(F.col("event_id").alias("report_id"), F.col("props").alias("payload"))
    return provenance.forbidden_values(r, '"[a-z]"')


_FIELDS = "to_json(struct(event_id AS id, struct(event_type AS policy, array(struct(CASE event_id % 3 WHEN 0 THEN 'Demo maps' WHEN 1 THEN 'maps' ELSE 'mock' END AS provider, event_type AS note)) AS sources, CASE WHEN event_id % 7 = 0 THEN map('upliftBy', value, 'usedMockData', value) END AS extra) AS report, from_json(props, 'map<string,string>') AS props))"


@query("""WITH r AS (SELECT event_id, to_json({'id': event_id, 'report': {'policy': event_type, 'sources': [{'provider': CASE event_id % 3 WHEN 0 THEN 'Demo maps' WHEN 1 THEN 'maps' ELSE 'mock' END}], 'extra': CASE WHEN event_id % 7 = 0 THEN {'upliftBy': value, 'usedMockData': value} END}}) AS j FROM events),
t AS (SELECT event_id, t.key, t.fullkey, t.type, t.atom FROM r, json_tree(r.j) t)
SELECT event_id AS report_id, replace(fullkey, '$', 'response') AS path, CASE WHEN key IN ('demoMode', 'usedMockData') OR regexp_matches(key, '(?i)uplift') THEN 'forbidden_field' ELSE 'synthetic_source' END AS rule FROM t
WHERE key IN ('demoMode', 'usedMockData') OR regexp_matches(key, '(?i)uplift') OR (key IN ('source', 'sourceType', 'provider', 'policy') AND type = 'VARCHAR' AND regexp_matches(atom::VARCHAR, '(?i)mock|demo|synthetic'))""")
def forbidden_fields(spark, sf):
    """Events as nested reports; their props are a part of each."""
    r = table(spark, sf, "events").select(F.col("event_id").alias("report_id"), F.expr(_FIELDS).alias("payload"))
    return nested.synthetic_fields(r)


_STORED = """to_json(named_struct('schemaVersion', CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 2 END, 'id', cast(o_orderkey AS string), 'createdAt', cast(o_orderdate AS string), 'report', named_struct(
    'schemaVersion', 2, 'provenance', named_struct('policy', CASE WHEN o_orderpriority = '1-URGENT' THEN 'mixed' ELSE 'real-only' END, 'containsSyntheticData', o_orderkey % 13 = 0,
        'sources', array(named_struct('id', 'S1', 'kind', 'openstreetmap', 'provider', o_orderpriority, 'title', 'orders', 'accessedAt', cast(o_orderdate AS string), 'status', 'used'))),
    'market', named_struct('lat', o_totalprice / 5000, 'lon', 0.5D, 'sourceIds', array(CASE WHEN o_orderkey % 7 = 0 THEN 'S2' ELSE 'S1' END)),
    'summary', named_struct('scoringVersion', 2, 'competitorCount', CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END), 'competitors', array())))"""


@query("SELECT o_orderkey AS report_id, CASE WHEN o_orderkey % 11 = 0 OR len(r) > 0 THEN 'invalid' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE array_to_string(list_sort(r), ',') END AS rules FROM (SELECT *, list_filter([CASE WHEN o_orderpriority = '1-URGENT' THEN 'policy' END, CASE WHEN o_orderkey % 13 = 0 THEN 'synthetic' END, CASE WHEN o_totalprice / 5000 > 90 THEN 'coordinates' END, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' END, CASE WHEN o_orderstatus = 'P' THEN 'competitor_count' END], lambda x: x IS NOT NULL) AS r FROM orders)")
def checked_report_status(spark, sf):
    """Orders as stored reports; the rules that they break follow from their own columns."""
    dealt = table(spark, sf, "orders").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")  # few small files make many large payloads
    stored = dealt.select(F.col("o_orderkey").cast("string").alias("report_id"), F.expr(_STORED).alias("payload"))
    got = report_rules.checked_status(stored)
    return got.select(F.col("report_id").cast("bigint").alias("report_id"), "status", F.array_join("rules", ",").alias("rules"))


@query("WITH m AS (SELECT o_custkey AS catalog_id, max(o_orderkey) AS sample_id FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1), s AS (SELECT c_custkey AS catalog_id, c_custkey AS sample_id FROM customer) SELECT * FROM m UNION ALL SELECT * FROM s WHERE catalog_id NOT IN (SELECT catalog_id FROM m)")
def snapshot_meta(spark, sf):
    m = table(spark, sf, "orders").where("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("catalog_id")).agg(F.max("o_orderkey").alias("sample_id"))
    s = table(spark, sf, "customer").selectExpr("c_custkey AS catalog_id", "c_custkey AS sample_id")
    return reports.snapshot_meta(m, s)


@query("WITH e AS (SELECT s_suppkey, CASE WHEN s_suppkey % 20 = 0 THEN 'Bad Id' ELSE 's-' || s_suppkey % 40 END AS id, 'i' || s_suppkey AS industry, CASE WHEN s_suppkey % 30 = 0 THEN ' ' ELSE s_name END AS name, CASE WHEN s_suppkey % 25 = 0 THEN 'http://x' ELSE 'https://x' END AS url FROM supplier) SELECT 'blank' AS rule, id AS value FROM e WHERE trim(name) = '' UNION ALL SELECT 'slug', id FROM e WHERE id = 'Bad Id' UNION ALL SELECT 'https', id FROM e WHERE url = 'http://x' UNION ALL SELECT 'id_twice', id FROM e GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'industry_missing', 'none' UNION ALL SELECT 'count', count(*)::VARCHAR FROM e HAVING count(*) <> 25")
def catalog_violations(spark, sf):
    e = table(spark, sf, "supplier").selectExpr("CASE WHEN s_suppkey % 20 = 0 THEN 'Bad Id' ELSE concat('s-', cast(s_suppkey % 40 as string)) END AS id", "concat('i', cast(s_suppkey as string)) AS industry", "CASE WHEN s_suppkey % 30 = 0 THEN ' ' ELSE s_name END AS name", "CASE WHEN s_suppkey % 25 = 0 THEN 'http://x' ELSE 'https://x' END AS url")
    return reports.catalog_violations(e, ["i1", "none"], 25)


@query("SELECT conv_id * 1000 + turn AS ord, lower(trim(role || '@' || CASE WHEN conv_id % 5 = 0 THEN 'x' ELSE 'x.org' END)) AS email, concat_ws(',', CASE WHEN conv_id % 5 = 0 THEN 'email' END, CASE WHEN length(text) > 1000 THEN 'message' END) AS violations FROM conversations")
def validate_signups(spark, sf):
    s = table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS ord", "concat(upper(role), '@', CASE WHEN conv_id % 5 = 0 THEN 'x' ELSE 'x.org' END) AS email", "role AS source", "'r' AS report_id", "text AS message")
    return resolve.validate_signups(s).select("ord", "email", F.array_join("violations", ",").alias("violations"))


@query("WITH l AS (SELECT event_id % 50 AS page, event_id AS ord, 'https://' || ['www.facebook.com/joe', 'x.com/', 'm.youtube.com/c/' || event_id, 'instagram.com/share/x', 'example.com/y'][1 + event_id % 5] AS href FROM events) SELECT page, CASE WHEN contains(href, 'facebook') THEN 'facebook' ELSE 'youtube' END AS platform, arg_min(href, ord) AS href FROM l WHERE contains(href, 'facebook') OR contains(href, 'youtube') GROUP BY ALL")
def social_links(spark, sf):
    kinds = F.array(F.lit("www.facebook.com/joe"), F.lit("x.com/"), F.concat(F.lit("m.youtube.com/c/"), F.col("event_id").cast("string")), F.lit("instagram.com/share/x"), F.lit("example.com/y"))
    links = table(spark, sf, "events").select((F.col("event_id") % 50).alias("page"), F.col("event_id").alias("ord"), F.concat(F.lit("https://"), F.get(kinds, (F.col("event_id") % 5).cast("int"))).alias("href"))
    return signals.first_social_links(links, "page")


@query("WITH RECURSIVE f AS (SELECT user_id AS key, event_id AS ord, ts, floor(epoch(ts) / 86400)::BIGINT AS w FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, w ORDER BY ts, event_id) = 1), l AS (SELECT row_number() OVER (ORDER BY w) AS i, list({'k': key, 'o': ord} ORDER BY ts, ord) AS l FROM f GROUP BY w), s(i, known, new) AS (SELECT 0::BIGINT, []::BIGINT[], []::STRUCT(k BIGINT, o BIGINT)[] UNION ALL SELECT l.i, list_concat(known, list_transform(list_filter(l, lambda x: NOT list_contains(known, x.k))[1:10], lambda x: x.k)), list_filter(l, lambda x: NOT list_contains(known, x.k))[1:10] FROM s JOIN l ON l.i = s.i + 1), a AS (SELECT unnest(new, recursive := true) FROM s) SELECT key, o AS admitted_ord FROM (SELECT DISTINCT key FROM f) LEFT JOIN a ON key = k")
def admit_signups(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("ord"), "ts", F.col("user_id").alias("key"))
    return admission.admit_signups(e, 86400, 10).select("key", "admitted_ord")


@query("SELECT page_id, html_bytes, failure, n FROM (SELECT page_id, strlen(html)::INTEGER AS html_bytes, CASE WHEN page_id % 5 = 0 THEN 'not_html' END AS failure, CASE WHEN page_id % 5 <> 0 THEN length(html) END::INTEGER AS n FROM pages)")
def page_scan(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", F.col("html").cast("binary").alias("content"), F.when(F.col("page_id") % 5 == 0, "image/png").otherwise("text/html; charset=utf-8").alias("content_type"), F.lit(None).cast("int").alias("declared_length"))
    return page_source.read_pages(p).select("page_id", "html_bytes", "failure", F.length("html").alias("n"))


@query(r"SELECT page_id, 'https://map.example/?q=' || replace(url_encode(url), '+', '%20') AS cited FROM pages")
def citation_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.template_url("https://map.example/?q={}", F.col("url")).alias("cited"))


@query("WITH h AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages) SELECT host, allow, rule FROM h, (VALUES (false, '/es/'), (true, '/es/a')) v(allow, rule)")
def robots_rules(spark, sf):
    hosts = table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("host")).distinct()
    return audit.robots_rules(hosts.withColumn("body", F.lit("User-agent: *\nDisallow: /fr/\nUser-agent: bench\n\nDisallow: /es/\nAllow: /es/a\n")), "bench")


@query(f"WITH {RECORDS_SQL} SELECT market_id, id, CASE WHEN k % 4 = 0 THEN 'complete' ELSE 'unavailable' END AS audit_status, CASE WHEN k % 4 = 0 THEN NULL WHEN website IS NULL THEN 'no_website' WHEN is_chain THEN 'chain' ELSE 'not_selected' END AS audit_reason FROM rec0")
def join_audits(spark, sf):
    c = records(spark, sf)
    a = c.where("k % 4 = 0").select("market_id", "id", F.lit("complete").alias("audit_status"))
    return report.join_audits(c, a).select("market_id", "id", "audit_status", "audit_reason")
