"""Queries on businesses of markets: scores, ranks, summaries, discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import half_up, haversine_km
from ..operators import entity, market, scoring, spatial
from .bindings import RECORDS_SQL, SCORED_SQL, records, scored_records, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return market.competition_rank(scored_records(spark, sf))


@query(f"WITH {SCORED_SQL} SELECT market_id, id, local_presence FROM rec")
def local_presence(spark, sf):
    return scored_records(spark, sf).select("market_id", "id", "local_presence")


@query(f"WITH {SCORED_SQL} SELECT id, momentum FROM rec")
def momentum_score(spark, sf):
    return scored_records(spark, sf).select("id", "momentum")


@query(f"WITH {SCORED_SQL} SELECT id, risk::INTEGER AS risk, CASE WHEN available THEN least(100, 25 * s_risk) END::INTEGER AS change FROM rec")
def risk_change_scores(spark, sf):
    r = scored_records(spark, sf)
    return r.select("id", F.col("risk").cast("int"), scoring.change_score(F.col("s_risk"), F.col("available")).cast("int").alias("change"))


@query(f"WITH {SCORED_SQL} SELECT id, website_score::INTEGER AS website_score, final_score FROM rec")
def final_score(spark, sf):
    return scored_records(spark, sf).select("id", F.col("website_score").cast("int"), "final_score")


@query(f"WITH {SCORED_SQL} SELECT id, (s_momentum = 1) OR p_website AS either, website_score >= 60 AS at_least, website_score < 40 AS below FROM rec")
def three_valued_logic(spark, sf):
    return scored_records(spark, sf).select("id", ((F.col("s_momentum") == 1) | F.col("p_website")).alias("either"), (F.col("website_score") >= 60).alias("at_least"), (F.col("website_score") < 40).alias("below"))


@query(f"WITH {SCORED_SQL} SELECT market_id, id, scored, rnk::INTEGER AS rank, rnk IS NOT NULL AND count(CASE WHEN scored THEN 1 END) OVER (PARTITION BY market_id, CASE WHEN scored THEN final_score END) > 1 AS tied FROM rk")
def competition_rank(spark, sf):
    return _ranked(spark, sf).select("market_id", "id", "scored", "rank", "tied")


@query(f"WITH {SCORED_SQL} SELECT market_id, id, row_number() OVER (PARTITION BY market_id ORDER BY scored DESC, CASE WHEN scored THEN final_score END DESC NULLS LAST, (scored AND is_user) DESC, CASE WHEN scored THEN id END, ord)::INTEGER AS place FROM rk")
def display_order(spark, sf):
    return market.display_order(_ranked(spark, sf)).select("market_id", "id", "place")


@query(f"WITH {SCORED_SQL} SELECT market_id, id, CASE WHEN is_chain THEN 'chain' WHEN scored THEN 'scored' WHEN website IS NULL THEN 'no_website' WHEN k % 5 = 0 THEN 'not_attempted' ELSE 'failed:timeout' END AS outcome FROM sc")
def audit_outcome(spark, sf):
    return _outcomes(spark, sf).select("market_id", "id", "outcome")


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    r = _ranked(spark, sf)
    return r.withColumn("outcome", scoring.audit_outcome(F.col("is_chain"), F.col("scored"), F.col("website"), F.col("k") % 5 != 0, F.lit("timeout")))


@query(f"WITH {SCORED_SQL}, o AS (SELECT market_id, CASE WHEN is_chain THEN 'chain' WHEN scored THEN 'scored' WHEN website IS NULL THEN 'no_website' WHEN k % 5 = 0 THEN 'not_attempted' ELSE 'failed' END AS o FROM sc) SELECT market_id, count_if(o = 'chain')::BIGINT AS chains, count_if(o = 'scored')::BIGINT AS scored, count_if(o = 'no_website')::BIGINT AS no_website, count_if(o = 'not_attempted')::BIGINT AS not_attempted, count_if(o = 'failed')::BIGINT AS failed FROM o GROUP BY market_id")
def outcome_counts(spark, sf):
    return market.outcome_counts(_outcomes(spark, sf))


_CATS = " UNION ALL ".join(f"SELECT market_id, is_user, scored, {k} AS category_ord, '{c}' AS category, {m} AS max_score, CAST({c} AS DOUBLE) AS score FROM rk" for k, (c, m) in enumerate(scoring.CATEGORIES))
_COMPARISON = f"""{SCORED_SQL}, cats AS ({_CATS}),
us AS (SELECT market_id, category, max(CASE WHEN is_user THEN score END) AS user_score FROM cats GROUP BY ALL),
cc AS (SELECT market_id, category, category_ord, max_score, user_score, avg(score) AS raw, count_if(score > user_score) AS ahead, count(*) AS n
    FROM cats JOIN us USING (market_id, category) WHERE user_score IS NOT NULL AND NOT is_user AND scored AND score IS NOT NULL GROUP BY ALL),
cmp AS (SELECT market_id, category, category_ord::INTEGER AS category_ord, max_score::INTEGER AS max_score, user_score, floor(raw * 10 + 0.5e0) / 10 AS average,
    floor((raw - user_score) * 10 + 0.5e0) / 10 AS gap, ahead::BIGINT AS ahead, n::BIGINT AS n FROM cc)"""


@query(f"WITH {_COMPARISON} SELECT * FROM cmp")
def category_comparison(spark, sf):
    return market.category_comparison(_ranked(spark, sf))


_SUMMARY = f"""{SCORED_SQL},
g AS (SELECT market_id, count_if(NOT is_user) AS competitors, count_if(NOT is_user AND scored) AS audited, avg(CASE WHEN NOT is_user AND scored THEN website_score END) AS w,
    avg(CASE WHEN NOT is_user AND scored THEN final_score END) AS f, max(CASE WHEN is_user THEN rnk END) AS your_rank, max(CASE WHEN is_user AND scored THEN final_score END) AS u,
    (array_agg(name ORDER BY final_score DESC, id) FILTER (WHERE NOT is_user AND scored))[1] AS strongest FROM rk GROUP BY market_id),
summ AS (SELECT market_id, competitors::BIGINT AS competitors, audited::BIGINT AS audited, floor(w + 0.5e0)::BIGINT AS average_website, floor(f + 0.5e0)::BIGINT AS average_final, your_rank::INTEGER AS your_rank,
    floor(u - f + 0.5e0)::BIGINT AS market_gap, CASE WHEN your_rank IS NULL OR u - f IS NULL THEN NULL WHEN your_rank = 1 THEN 'leading' WHEN u - f >= 0 THEN 'competitive' WHEN u - f >= -15 THEN 'recoverable' ELSE 'low_visibility' END AS status, strongest FROM g)"""


@query(f"WITH {_SUMMARY} SELECT * FROM summ")
def market_summary(spark, sf):
    return market.market_summary(_ranked(spark, sf))


@query(f"WITH {_SUMMARY} SELECT market_id, status, CASE WHEN average_final >= 80 THEN 'leading' WHEN average_final >= 65 THEN 'competitive' WHEN average_final >= 45 THEN 'recoverable' WHEN average_final IS NOT NULL THEN 'low_visibility' END AS band FROM summ")
def position_status(spark, sf):
    s = market.market_summary(_ranked(spark, sf))
    return s.select("market_id", "status", scoring.score_band(F.col("average_final")).alias("band"))


@query(f"WITH {SCORED_SQL} SELECT market_id, id, (SELECT c FROM (VALUES ('seo', seo / 25e0, -25, 0), ('conversion', conversion / 25e0, -25, 1), ('trust', trust / 20e0, -20, 2), ('content', content / 20e0, -20, 3), ('technical', technical / 10e0, -10, 4)) v(c, s, m, o) WHERE s < 1 ORDER BY s, m, o LIMIT 1) AS weakest FROM rec")
def weakest_category(spark, sf):
    return market.weakest_category(scored_records(spark, sf))


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    r = _ranked(spark, sf)
    flags = {e[0]: F.when(F.col("available") & (F.col("k") * (2 * n + 3) % 7 != 0), F.col("k") * (n + 2) % (3 + n % 3) != 0) for n, e in enumerate(scoring.ELEMENTS)}
    return scoring.element_matrix(r.select("market_id", "id", "is_user", "scored", *[c.alias(n) for n, c in flags.items()]), ("market_id", "id", "is_user", "scored"))


_ELEMENTS_SQL = " UNION ALL ".join(f"SELECT market_id, id, is_user, scored, {n} AS ord, '{e[0]}' AS key, '{e[1]}' AS category, {e[2]} AS points, {repr(e[3]) if e[3] else 'NULL::VARCHAR'} AS covered_by, CASE WHEN available AND k * {2 * n + 3} % 7 <> 0 THEN k * {n + 2} % {3 + n % 3} <> 0 END AS observed FROM rk" for n, e in enumerate(scoring.ELEMENTS))
_GAPS_SQL = f"""{SCORED_SQL}, m AS ({_ELEMENTS_SQL}), miss AS (SELECT market_id, ord, key, category, points, covered_by FROM m WHERE is_user AND observed = false),
seen AS (SELECT market_id, key, count_if(observed) AS adopters, count(observed) AS observed_by FROM m WHERE NOT is_user AND scored GROUP BY ALL),
gaps AS (SELECT miss.*, coalesce(adopters, 0)::BIGINT AS adopters, coalesce(observed_by, 0)::BIGINT AS observed_by, CASE WHEN observed_by > 0 THEN adopters / observed_by::DOUBLE ELSE 0 END AS share FROM miss LEFT JOIN seen USING (market_id, key))"""


@query(f"WITH {SCORED_SQL}, m AS ({_ELEMENTS_SQL}) SELECT market_id, id, ord::INTEGER AS ord, key, category, points::INTEGER AS points, observed FROM m")
def element_matrix(spark, sf):
    return _elements(spark, sf).select("market_id", "id", "ord", "key", "category", "points", "observed")


@query(f"WITH {_GAPS_SQL} SELECT market_id, key, points::INTEGER AS points, adopters, observed_by, round(share, 6) AS share FROM gaps")
def element_gaps(spark, sf):
    return market.element_gaps(_elements(spark, sf)).select("market_id", "key", "points", "adopters", "observed_by", F.round("share", 6).alias("share"))


@query(f"WITH {_GAPS_SQL}, f AS (SELECT * FROM gaps g WHERE covered_by IS NULL OR NOT EXISTS (SELECT 1 FROM gaps h WHERE h.market_id = g.market_id AND h.key = g.covered_by)), p AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY share DESC, points DESC, ord) AS place FROM f) SELECT market_id, place::INTEGER AS place, key, category, points::INTEGER AS points, adopters, observed_by, CASE WHEN share >= 0.5 AND points >= 5 THEN 'high' WHEN share > 0 THEN 'medium' ELSE 'low' END AS priority FROM p WHERE place <= 5")
def recommendations(spark, sf):
    return market.recommendations(market.element_gaps(_elements(spark, sf)))


@query(f"WITH {_COMPARISON}, {_SUMMARY[len(SCORED_SQL) + 2 :]}, fs AS (SELECT market_id, 0 AS kind, 0e0 AS gap, -1 AS o, 'position' AS finding FROM summ WHERE your_rank IS NOT NULL AND average_final IS NOT NULL UNION ALL SELECT market_id, 1, gap, category_ord, category FROM cmp WHERE gap > 0.5), p AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY kind, gap DESC, o) AS place FROM fs) SELECT market_id, place::INTEGER AS place, finding, gap, CASE WHEN audited >= 5 THEN 'high' WHEN audited >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM p JOIN summ USING (market_id) WHERE place <= 3")
def top_findings(spark, sf):
    r = _ranked(spark, sf)
    return market.top_findings(market.market_summary(r), market.category_comparison(r))


@query(f"WITH {RECORDS_SQL}, s AS (SELECT market_id, CASE WHEN is_user THEN 0 ELSE k END AS record_ord, kind_ord, id, CASE kind_ord WHEN 0 THEN 'risk' ELSE 'change' END AS label, concat('e', cast(k % 3 AS VARCHAR)) AS evidence FROM rec0, (VALUES (0), (1)) v(kind_ord) WHERE k % (2 + kind_ord) = 0), f AS (SELECT market_id, id, label, evidence, min(record_ord) AS r, min(kind_ord) AS o FROM s GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY r, o, id, label, evidence) AS place FROM f) SELECT market_id, place::INTEGER AS place, id, label, evidence FROM p WHERE place <= 3")
def top_risks(spark, sf):
    r = records(spark, sf).withColumn("record_ord", F.when(F.col("is_user"), F.lit(0)).otherwise(F.col("k")))
    s = r.withColumn("kind_ord", F.explode(F.array(F.lit(0), F.lit(1)))).where("k % (2 + kind_ord) = 0")
    s = s.select("market_id", "record_ord", "kind_ord", "id", F.when(F.col("kind_ord") == 0, "risk").otherwise("change").alias("label"), F.concat(F.lit("e"), (F.col("k") % 3).cast("string")).alias("evidence"))
    return market.top_risks(s)


_DIST = "round(2 * 6371.0088e0 * asin(least(1e0, sqrt(pow(sin(radians(lat - m_lat) / 2), 2) + cos(radians(m_lat)) * cos(radians(lat)) * pow(sin(radians(lon - m_lon) / 2), 2)))), 6)"
_CENTRES = "ctr AS (SELECT n_nationkey AS m, 37.0e0 + (n_nationkey * 7919 % 5000) / 10000.0e0 AS m_lat, -122.5e0 + (n_nationkey * 104729 % 5000) / 10000.0e0 AS m_lon, 2.0e0 + n_nationkey % 9 AS radius_km FROM nation)"


def _centres(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").selectExpr("n_nationkey AS market_id", "37.0D + (n_nationkey * 7919 % 5000) / 10000.0D AS lat", "-122.5D + (n_nationkey * 104729 % 5000) / 10000.0D AS lon", "2.0D + n_nationkey % 9 AS radius_km")


@query(f"WITH {RECORDS_SQL}, {_CENTRES} SELECT market_id, id, {_DIST} AS distance_km FROM rec0 JOIN ctr ON market_id = m")
def haversine(spark, sf):
    c = _centres(spark, sf).selectExpr("market_id", "lat AS m_lat", "lon AS m_lon")
    return records(spark, sf).join(c, "market_id").select("market_id", "id", F.round(haversine_km(F.col("m_lat"), F.col("m_lon"), F.col("lat"), F.col("lon")), 6).alias("distance_km"))


@query(f"WITH {RECORDS_SQL}, {_CENTRES} SELECT m AS market_id, id, {_DIST} AS distance_km FROM rec0, ctr WHERE {_DIST} <= radius_km")
def radius_join(spark, sf):
    found = spatial.radius_join(_centres(spark, sf), records(spark, sf).select("id", "lat", "lon"), pad_cells=1)
    return found.select("market_id", "id", F.round("distance_km", 6).alias("distance_km"))


@query(f"WITH {RECORDS_SQL}, b AS (SELECT market_id, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM rec0 GROUP BY market_id), r AS (SELECT market_id, greatest(2 * 6371.0088e0 * asin(least(1e0, abs(sin(radians(n - s) / 2)))), 2 * 6371.0088e0 * asin(least(1e0, cos(radians((s + n) / 2)) * abs(sin(radians(e - w) / 2))))) / 2 AS r FROM b) SELECT market_id, floor(greatest(2e0, least(12e0, r)) * 10 + 0.5e0) / 10 AS radius_km FROM r")
def market_radius(spark, sf):
    b = records(spark, sf).groupBy("market_id").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    return spatial.market_radius(b).select("market_id", "radius_km")


@query(f"WITH {RECORDS_SQL}, {_CENTRES}, f AS (SELECT m AS market_id, radius_km AS r, {_DIST} AS d FROM rec0, ctr WHERE {_DIST} <= radius_km), h AS (SELECT *, greatest(2e0, floor(r / 2 * 10 + 0.5e0) / 10) AS h FROM f), q AS (SELECT *, greatest(2e0, floor(h / 2 * 10 + 0.5e0) / 10) AS q FROM h), g AS (SELECT market_id, r, h, q, count(*) AS n0, count_if(d <= h) AS n1, count_if(d <= q) AS n2 FROM q GROUP BY ALL) SELECT market_id, CASE WHEN n0 < 20 THEN r WHEN n1 < 20 THEN h ELSE q END AS used_km, n0 >= 20 AND n1 >= 20 AND n2 >= 20 AS limited FROM g")
def narrowed_radius(spark, sf):
    found = spatial.radius_join(_centres(spark, sf), records(spark, sf).select("id", "lat", "lon"), pad_cells=1)
    return spatial.narrowed_radius(found.join(_centres(spark, sf).select("market_id", "radius_km"), "market_id"), 20)


def _name():
    return F.when(F.col("k") % 4 == 0, F.concat(F.lit("n"), (F.col("k") % 40).cast("string"))).otherwise(F.col("name_key"))


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    site = F.when(F.col("k") % 17 != 0, F.concat(F.lit("site"), (F.col("k") % 911).cast("string")))
    phone = F.when(F.col("k") % 6 == 0, F.concat(F.lit("p"), (F.col("k") % 97).cast("string")))
    score = entity.priority_score(site, phone, F.lit(None).cast("string"), F.col("lat"), F.lit(False), F.lit(False), F.col("k") % 5)
    return r.select("market_id", "id", "name", _name().alias("name_key"), F.when(F.col("k") % 8 == 0, F.concat(F.lit("a"), (F.col("k") % 80).cast("string"))).alias("address_key"), site.alias("site_key"), phone.alias("phone_key"), "lat", "lon", score.alias("priority_score"), "k")


_KEYED = f"{RECORDS_SQL}, kd AS (SELECT market_id, id, name, CASE WHEN k % 4 = 0 THEN concat('n', k % 40) ELSE name_key END AS name_key, CASE WHEN k % 8 = 0 THEN concat('a', k % 80) END AS address_key, CASE WHEN k % 17 <> 0 THEN concat('site', cast(k % 911 AS VARCHAR)) END AS site_key, CASE WHEN k % 6 = 0 THEN concat('p', cast(k % 97 AS VARCHAR)) END AS phone_key, lat, lon, (CASE WHEN k % 17 <> 0 THEN 30e0 ELSE 0 END) + (CASE WHEN k % 6 = 0 THEN 20e0 ELSE 0 END) + 15 + least(5e0, (k % 5) / 2e0) AS priority_score, k FROM rec0)"
_M = "1000 * 2 * 6371.0088e0 * asin(least(1e0, sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))))"
_PAIRS = f"{_KEYED}, pr AS (SELECT DISTINCT x.market_id, x.id AS a, y.id AS b FROM kd x JOIN kd y ON x.market_id = y.market_id AND x.id < y.id WHERE (x.name_key = y.name_key AND (coalesce(x.address_key = y.address_key, false) OR {_M} <= 150)) OR ((x.site_key = y.site_key OR x.phone_key = y.phone_key) AND {_M} <= 250))"


@query(f"WITH {_PAIRS} SELECT * FROM pr")
def same_business_pairs(spark, sf):
    return entity.same_business_pairs(_keyed(spark, sf))


@query(f"WITH RECURSIVE {_PAIRS}, bo AS (SELECT market_id, a, b FROM pr UNION ALL SELECT market_id, b, a FROM pr), re AS (SELECT market_id, a AS id, a AS l FROM bo UNION SELECT re.market_id, bo.b, re.l FROM re JOIN bo ON bo.market_id = re.market_id AND bo.a = re.id), lab AS (SELECT market_id, id, min(l) AS l FROM re GROUP BY ALL), f AS (SELECT kd.*, coalesce(l, kd.id) AS g FROM kd LEFT JOIN lab USING (market_id, id)) SELECT market_id, id, priority_score FROM f QUALIFY row_number() OVER (PARTITION BY market_id, g ORDER BY priority_score DESC, id) = 1")
def dedupe_businesses(spark, sf):
    c = entity.written(_keyed(spark, sf).drop("name", "k"))
    return entity.dedupe_businesses(c, entity.business_links(c)).select("market_id", "id", "priority_score")


@query(f"WITH {RECORDS_SQL}, c AS (SELECT market_id, id, name, CASE WHEN k % 10 <> 0 THEN concat('root', cast(k % 211 AS VARCHAR)) END AS domain_root, CASE WHEN k % 31 = 0 THEN 'Brand' END AS brand FROM rec0), f AS (SELECT *, coalesce(brand IS NOT NULL OR (domain_root IS NOT NULL AND count(domain_root) OVER (PARTITION BY market_id, domain_root) >= 2), false) AS is_chain FROM c) SELECT market_id, id, is_chain, CASE WHEN is_chain THEN coalesce(brand, name) END AS brand FROM f")
def flag_chains(spark, sf):
    c = records(spark, sf).select("market_id", "id", "name", F.when(F.col("k") % 10 != 0, F.concat(F.lit("root"), (F.col("k") % 211).cast("string"))).alias("domain_root"), F.when(F.col("k") % 31 == 0, "Brand").alias("brand"))
    return entity.flag_chains(c).select("market_id", "id", "is_chain", "brand")


@query(f"WITH {_KEYED}, {_CENTRES}, u AS (SELECT market_id, name_key AS un, concat('site', cast(k % 911 AS VARCHAR)) AS us FROM kd JOIN users ON market_id = um AND k = uk), j AS (SELECT kd.market_id, id, CASE WHEN coalesce(site_key = us, false) THEN 'site' WHEN coalesce(name_key = un, false) THEN 'name' END AS match FROM kd JOIN u USING (market_id)) SELECT market_id, id FROM j WHERE match IS NULL")
def exclude_self(spark, sf):
    c = _keyed(spark, sf).withColumn("name_segment", F.col("name_key")).withColumn("distance_km", F.lit(0.0))
    r = records(spark, sf).where("is_user")
    u = r.select("market_id", _name().alias("user_name_key"), F.concat(F.lit("site"), (F.col("k") % 911).cast("string")).alias("user_site"))
    return entity.exclude_self(c, u)[0].select("market_id", "id")


_CAND = f"{RECORDS_SQL}, cd AS (SELECT market_id, id, website, is_chain, floor((k * 31 % 997) / 10e0) / 10 AS distance_km, k % 3 <> 0 AS success FROM rec0 WHERE NOT is_user)"


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).where("NOT is_user").selectExpr("market_id", "id", "website", "is_chain", "floor((k * 31 % 997) / 10D) / 10D AS distance_km", "k % 3 <> 0 AS success")


_SEL = f"{_CAND}, t AS (SELECT *, row_number() OVER w AS attempt, coalesce(sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY market_id ORDER BY distance_km, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cd WHERE website IS NOT NULL AND NOT is_chain WINDOW w AS (PARTITION BY market_id ORDER BY distance_km, id)), sel AS (SELECT * FROM t WHERE attempt <= 10 AND before < 7)"


@query(f"WITH {_SEL} SELECT market_id, id, attempt::INTEGER AS attempt, success FROM sel")
def select_audits(spark, sf):
    return market.select_audits(_candidates(spark, sf)).select("market_id", "id", "attempt", "success")


@query(f"WITH {_SEL}, l AS (SELECT cd.market_id, cd.id, cd.distance_km, sel.id IS NOT NULL AS audited FROM cd LEFT JOIN sel USING (market_id, id)), m AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY audited DESC, distance_km, id) AS n FROM l) SELECT market_id, id, audited, row_number() OVER (PARTITION BY market_id ORDER BY distance_km, id)::INTEGER AS place FROM m WHERE n <= 10")
def listed_competitors(spark, sf):
    c = _candidates(spark, sf)
    return market.listed_competitors(c, market.select_audits(c)).select("market_id", "id", "audited", "place")


_BROKEN = "bk AS (SELECT *, final_score + CASE WHEN k % 41 = 0 THEN 1 ELSE 0 END AS bad FROM rk), bn AS (SELECT *, count(CASE WHEN scored THEN 1 END) OVER (PARTITION BY market_id) AS n, CASE WHEN scored THEN rank() OVER (PARTITION BY market_id ORDER BY CASE WHEN scored THEN bad END DESC NULLS LAST) END AS want FROM bk)"


@query(f"WITH {SCORED_SQL}, {_BROKEN}, v AS (SELECT market_id, id, unnest([CASE WHEN NOT available AND coalesce(seo, conversion, trust, content, technical, website_score, momentum) IS NOT NULL THEN 'unavailable_has_score' END, CASE WHEN bad <> final_score THEN 'final_arithmetic' END, CASE WHEN n >= 2 AND scored AND rnk IS DISTINCT FROM want THEN 'rank' END, CASE WHEN (NOT scored OR n < 2) AND rnk IS NOT NULL THEN 'rank_of_unscored' END]) AS rule FROM bn) SELECT market_id, id, rule FROM v WHERE rule IS NOT NULL")
def report_violations(spark, sf):
    """Ranked records of which one in 41 has a wrong final score, which also puts ranks out of order."""
    from ..operators import provenance

    r = _ranked(spark, sf)
    broken = r.withColumn("final_score", F.col("final_score") + F.when(F.col("k") % 41 == 0, 1).otherwise(0))
    return provenance.record_violations(broken)
