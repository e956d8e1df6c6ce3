"""Queries on directory, index, news and gazetteer answers made of the given tables, and on what is read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import presence, report, spatial
from ..sources import news, poi, reports
from ..streaming import quota
from .bindings import RECORDS_SQL, records, table
from .market_queries import _CENTRES, _DIST, _centres

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_TAG = "CASE WHEN k % 4 = 0 THEN concat('books; ', upper(tag_value)) ELSE tag_value END"


@query(f"WITH {RECORDS_SQL} SELECT id, CASE WHEN is_user AND k % 2 = 1 THEN true ELSE website IS NOT NULL OR is_user END AS p_website, CASE WHEN is_user AND k % 2 = 1 THEN CASE WHEN k % 5 <> 0 THEN k % 3 = 0 END ELSE k % 6 = 0 OR (k % 5 <> 0 AND k % 3 = 0) END AS p_contact, CASE WHEN NOT (is_user AND k % 2 = 1) THEN true END AS p_listing, CASE WHEN NOT (is_user AND k % 2 = 1) AND k % 10 <> 0 THEN CASE WHEN tag_value <> 'building' AND k % 7 <> 0 THEN 0e0 WHEN tag_value <> 'building' THEN CASE WHEN tag_value = 'furniture' THEN 0.5e0 ELSE 0e0 END ELSE 1e0 END END AS p_match, CASE WHEN NOT (is_user AND k % 2 = 1) THEN (CASE WHEN website IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END + 1) / 4e0 END AS p_complete FROM rec0")
def presence_inputs(spark, sf):
    """Customers as directory rows; the type asks for buildings, and one in seven also for furniture."""
    asked = "CASE WHEN k % 7 = 0 THEN array(named_struct('key', 'shop', 'value', 'Building'), named_struct('key', 'shop', 'value', 'furniture')) ELSE array(named_struct('key', 'shop', 'value', 'Building')) END AS resolved"
    r = records(spark, sf).selectExpr("id", "is_user", "website", "CASE WHEN k % 6 = 0 THEN 'p' END AS phone", "CASE WHEN k % 8 = 0 THEN 'a' END AS address", "lat", "lon", f"CASE WHEN k % 10 <> 0 THEN map('shop', {_TAG}) END AS tags", asked, "'Building trade' AS business_type", "CASE WHEN k % 5 <> 0 THEN k % 3 = 0 END AS audit_contact", "k % 2 = 0 AS has_listing")
    return presence.presence_inputs(r).select("id", "p_website", "p_contact", "p_listing", "p_match", "p_complete")


@query(f"WITH {RECORDS_SQL}, {_CENTRES} SELECT m AS market_id, id, {_DIST} AS distance_km FROM rec0, ctr WHERE {_DIST} <= radius_km AND k % 9 <> 0 AND (tag_value = CASE m % 2 WHEN 0 THEN 'building' ELSE 'machinery' END OR (m % 3 = 0 AND tag_value = 'household'))")
def tagged_in_radius(spark, sf):
    points = records(spark, sf).selectExpr("id", "lat", "lon", "map('name', CASE WHEN k % 9 <> 0 THEN name ELSE '' END, 'shop', tag_value) AS tags")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("market_id"))
    pairs = n.selectExpr("market_id", "'shop' AS key", "CASE market_id % 2 WHEN 0 THEN 'building' ELSE 'machinery' END AS value").union(n.where("market_id % 3 = 0").selectExpr("market_id", "'shop'", "'household'"))
    return spatial.tagged_in_radius(_centres(spark, sf), points, pairs, pad_cells=1).select("market_id", "id", F.round("distance_km", 6).alias("distance_km"))


@query(f"WITH {RECORDS_SQL}, {_CENTRES}, d AS (SELECT market_id, min(CASE WHEN k % 5 <> 0 THEN {_DIST} END) AS a, max(CASE WHEN k % 5 <> 0 THEN {_DIST} END) AS b FROM rec0 JOIN ctr ON market_id = m GROUP BY 1), t AS (SELECT market_id, CASE WHEN a < 10 THEN printf('%.1f', floor(a * 10 + 0.5e0) / 10) ELSE cast(floor(a + 0.5e0)::BIGINT AS VARCHAR) END AS x, CASE WHEN b < 10 THEN printf('%.1f', floor(b * 10 + 0.5e0) / 10) ELSE cast(floor(b + 0.5e0)::BIGINT AS VARCHAR) END AS y FROM d) SELECT market_id, CASE WHEN x = y THEN x || ' km' ELSE x || '–' || y || ' km' END AS distances FROM t")
def distance_range(spark, sf):
    from ..functions.scalars import haversine_km

    c = _centres(spark, sf).selectExpr("market_id", "lat AS m_lat", "lon AS m_lon")
    km = F.round(haversine_km(F.col("m_lat"), F.col("m_lon"), F.col("lat"), F.col("lon")), 6)
    r = records(spark, sf).join(c, "market_id").select("market_id", F.when(F.col("k") % 5 != 0, km).otherwise(F.when(F.col("k") % 10 == 0, float("nan"))).alias("distance_km"))
    return report.distance_range(r)


_BUCKET = "CASE event_id % 6 WHEN 0 THEN 'analyze' WHEN 1 THEN 'sample' WHEN 2 THEN 'waitlist' WHEN 3 THEN 'reports' WHEN 4 THEN 'refresh-auth' ELSE 'other' END"


@query(f"WITH e AS (SELECT event_id AS ord, {_BUCKET} AS bucket, row_number() OVER (PARTITION BY {_BUCKET}, user_id % 5, floor(epoch(ts) / 86400) ORDER BY ts, event_id) - 1 AS used FROM events) SELECT ord, bucket, used::BIGINT AS used_before, coalesce(used < CASE bucket WHEN 'analyze' THEN 10 WHEN 'sample' THEN 30 WHEN 'waitlist' THEN 5 WHEN 'reports' THEN 60 WHEN 'refresh-auth' THEN 10 END, false) AS admitted FROM e")
def guard_limits(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id AS ord", "cast(ts AS timestamp) AS ts", "user_id % 5 AS key", f"{_BUCKET} AS bucket")
    return quota.guard(e, seconds=86400).select("ord", "bucket", "used_before", "admitted")


@query("SELECT concat('{', CASE WHEN c_custkey % 3 <> 0 THEN concat('\"name\":\"', c_name, '\",') ELSE '' END, '\"id\":', c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat(',\"segment\":\"', c_mktsegment, '\"') END, '}') AS json FROM customer")
def json_rows(spark, sf):
    c = table(spark, sf, "customer").selectExpr("CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name", "c_custkey AS id", "CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS segment", "1 AS unused")
    return reports.json_rows(c, ("name", "id", "segment"))


@query("SELECT count(*)::BIGINT AS n_pois, count(*) >= 100 AS publish FROM customer")
def publish_gate(spark, sf):
    return poi.publish_gate(table(spark, sf, "customer"), 100)


_ELEMENT = "concat('[\"', element_at(array('n', 'w', 'r'), cast(c_custkey % 3 as int) + 1), '\",', c_custkey, ',', 37 + c_custkey % 50 / 100, ',', -122 - c_custkey % 30 / 100, ',{\"name\":\"', c_name, '\",\"shop\":\"', lower(c_mktsegment), '\"}]')"


@query("SELECT c_nationkey AS doc, CASE c_custkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS osm_type, c_custkey AS osm_id, 37 + c_custkey % 50 / 100e0 AS lat, -122 - c_custkey % 30 / 100e0 AS lon, c_name AS name, lower(c_mktsegment) AS shop FROM customer WHERE c_nationkey % 6 NOT IN (1, 2, 3, 4, 5) OR c_nationkey % 6 = 5 AND c_nationkey > 20")
def poi_index(spark, sf):
    """An index document a nation; most are malformed in one way each."""
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(F.collect_list(F.expr(_ELEMENT)), ",").alias("es"))
    head = "CASE WHEN d % 6 = 1 THEN '\"version\":2' ELSE '\"version\":1' END, CASE WHEN d % 6 = 2 THEN ',\"osmTimestamp\":\"soon\"' ELSE ',\"osmTimestamp\":\"2026-01-01T00:00:00Z\"' END, CASE WHEN d % 6 = 3 THEN ',\"source\":{}' ELSE ',\"source\":{\"url\":\"https://x.org\"}' END, CASE WHEN d % 6 = 4 THEN ',\"bbox\":[1,2]' ELSE ',\"bbox\":[1,2,3,4]' END"
    docs = c.selectExpr("c_nationkey AS d", "es").selectExpr("d AS doc", f"concat('{{', {head}, CASE WHEN d % 6 = 5 AND d <= 20 THEN '' ELSE concat(',\"elements\":[', es, ']') END, '}}') AS payload")
    return poi.read_poi_index(docs)[0].selectExpr("doc", "osm_type", "osm_id", "lat", "lon", "tags['name'] AS name", "tags['shop'] AS shop")


@query("SELECT event_id AS response_id, CASE event_id % 7 WHEN 0 THEN 'http' WHEN 1 THEN 'not_json' WHEN 2 THEN 'malformed' WHEN 3 THEN 'runtime_error' ELSE 'ok' END AS outcome, coalesce(event_id % 7 >= 4 AND event_id % 5 = 0, false) AS truncated, CASE WHEN event_id % 7 >= 4 THEN CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END ELSE 0 END::BIGINT AS n_pois FROM events")
def poi_responses(spark, sf):
    element = "concat('{\"type\":\"node\",\"id\":', event_id, ',\"lat\":1.5,\"lon\":2.5,\"tags\":{\"name\":\"', event_type, '\"}}')"
    rest = "CASE WHEN event_id % 5 = 0 THEN ',{\"type\":\"way\",\"id\":2,\"center\":{\"lat\":1,\"lon\":2},\"tags\":{\"name\":\"w\"}},{\"type\":\"way\",\"id\":3,\"tags\":{\"name\":\"nowhere\"}},{\"type\":\"node\",\"id\":4,\"lat\":1,\"lon\":1,\"tags\":{\"name\":\" \"}}' ELSE '' END"
    payload = f"CASE event_id % 7 WHEN 1 THEN '<html>' WHEN 2 THEN '{{\"remark\":\"\"}}' WHEN 3 THEN '{{\"elements\":[],\"remark\":\"runtime error: Query timed out\"}}' ELSE concat('{{\"elements\":[', {element}, {rest}, ']}}') END AS payload"
    r = table(spark, sf, "events").selectExpr("event_id AS response_id", "CASE WHEN event_id % 7 = 0 THEN 504 ELSE 200 END AS status", payload)
    pois, outcomes = poi.read_poi_responses(r, 4)
    n = pois.groupBy("response_id").agg(F.count("*").alias("n_pois"))
    return outcomes.join(n, "response_id", "left").select("response_id", "outcome", "truncated", F.coalesce("n_pois", F.lit(0)).alias("n_pois"))


@query("SELECT event_id AS answer_id, event_type AS title, concat('https://n.org/', event_id) AS url FROM events WHERE event_id % 4 = 0")
def news_articles(spark, sf):
    good = "concat('{\"articles\":[{\"title\":\" ', event_type, ' \",\"url\":\"https://n.org/', event_id, '\"},{\"title\":\" \",\"url\":\"https://n.org/x\"},{\"title\":\"t\",\"url\":\"ftp://n.org\"}]}')"
    a = table(spark, sf, "events").selectExpr("event_id AS answer_id", f"CASE event_id % 4 WHEN 0 THEN {good} WHEN 1 THEN 'Your query was too short' WHEN 2 THEN '{{}}' ELSE '' END AS payload")
    return news.read_articles(a)[0].select("answer_id", "title", "url")


@query("SELECT n_nationkey AS market_id, 1 AS input_rank, n_name AS display_name, 10.5e0 + n_nationkey AS lat, CASE WHEN n_nationkey % 3 = 0 THEN 1e0 END AS south, n_nationkey % 4 < 2 AS in_region FROM nation WHERE n_nationkey % 5 <> 0")
def gazetteer(spark, sf):
    """Two places a nation: one without a position, one with its state as code, name, alias or something else."""
    box = "CASE n_nationkey % 3 WHEN 0 THEN '[\"1\",\"2\",\"3\",\"4\"]' WHEN 1 THEN '[\"1\",\"2\"]' ELSE '[\"1\",\"x\",\"3\",\"4\"]' END"
    place = "CASE n_nationkey % 4 WHEN 0 THEN '\"ISO3166-2-lvl4\":\"US-CA\"' WHEN 1 THEN '\"country_code\":\"us\"' WHEN 2 THEN '\"state\":\"Nevada\"' ELSE '\"city\":\"ca\"' END"
    payload = f"concat('[{{\"display_name\":\"no place\",\"lat\":\"\",\"lon\":\"2\"}},{{\"display_name\":\"', CASE WHEN n_nationkey % 5 <> 0 THEN n_name ELSE '' END, '\",\"lat\":\"', 10.5 + n_nationkey, '\",\"lon\":\"-1\",\"boundingbox\":', {box}, ',\"address\":{{', {place}, '}}}}]') AS payload"
    g = news.read_gazetteer(table(spark, sf, "nation").selectExpr("n_nationkey AS market_id", payload))
    market = F.when(F.col("market_id") % 4 == 1, "Springfield, U.S.A.").otherwise("Springfield, CA")
    region = F.when(F.col("market_id") % 4 == 1, F.lit("usa")).otherwise(news.region_of(market))
    return g.select("market_id", "input_rank", "display_name", "lat", "south", news.matches_region(F.col("address"), region).alias("in_region"))
