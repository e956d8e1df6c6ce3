"""Points of interest from GeoJSON sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that make a feature a business; prefixes of tags that are dropped (a parameter).
CATEGORY_KEYS = ("amenity", "craft", "healthcare", "leisure", "office", "shop", "sport", "tourism")
DROPPED_PREFIXES = (
    "name:", "alt_name", "old_name", "official_name:", "short_name:", "source", "note", "fixme", "FIXME", "description", "image",
    "mapillary", "check_date", "survey", "created_by", "tiger:", "gnis:", "wikimedia_commons", "payment:", "diet:", "fuel:", "currency:",
    "opening_hours:", "building", "roof:", "height", "level", "ref:", "not:", "was:", "disused:",
)


def element_id(raw: Column) -> tuple[Column, Column]:
    """(type, id) of n, w, r and a number; aN is way N/2 if even, else relation (N-1)/2."""
    kind, n = F.regexp_extract(raw, r"^([nwra])(\d+)$", 1), F.regexp_extract(raw, r"^([nwra])(\d+)$", 2).try_cast("bigint")
    area = kind == "a"
    t = F.when(kind == "n", "node").when((kind == "w") | (area & (n % 2 == 0)), "way").when((kind == "r") | area, "relation")
    return t, F.when(area, F.floor(n / 2).cast("bigint")).otherwise(n)


def ingest_pois(lines: DataFrame, bbox: tuple[float, float, float, float], dropped: Sequence[str] = DROPPED_PREFIXES) -> tuple[DataFrame, DataFrame]:
    """(pois, rejected lines) from (line_no, value); bbox is south, west, north, east, inclusive; the first of an id stays.

    A poi needs an id, a string name, a string under a category key, and a centre (the middle of all its positions).
    """
    s, w, n, e = bbox
    clean = lines.withColumn("value", F.trim(F.regexp_replace("value", "^\u001e", ""))).where("value <> ''")
    v = F.try_parse_json("value")
    raw = F.coalesce(F.try_variant_get(v, "$.id", "string"), F.try_variant_get(v, "$.properties['@id']", "string"))
    props = F.try_variant_get(v, "$.properties", "map<string,variant>")
    texts = F.map_filter(F.coalesce(props, F.expr("map()").cast("map<string,variant>")), lambda k, x: (F.schema_of_variant(x) == "STRING") & ~k.startswith("@"))
    tags = F.transform_values(texts, lambda k, x: x.cast("string"))
    pairs = F.regexp_extract_all(F.coalesce(F.get_json_object("value", "$.geometry.coordinates"), F.lit("")), F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)"), F.lit(0))
    number = lambda g: F.transform(pairs, lambda p: F.regexp_extract(p, r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)", g).try_cast("double"))
    mid = lambda a: F.round((F.array_min(a) + F.array_max(a)) / 2, 5)
    t, i = element_id(raw)
    p = clean.select("line_no", "value", t.alias("osm_type"), i.alias("osm_id"), tags.alias("all"), mid(number(2)).alias("lat"), mid(number(1)).alias("lon"))
    has = F.exists(F.array(*[F.try_element_at("all", F.lit(k)) for k in CATEGORY_KEYS]), lambda x: x.isNotNull())
    ok = F.col("osm_type").isNotNull() & F.col("osm_id").isNotNull() & (F.trim(F.try_element_at("all", F.lit("name"))) != "") & has & F.col("lat").between(s, n) & F.col("lon").between(w, e)
    p = p.withColumn("ok", F.coalesce(ok, F.lit(False)))
    from pyspark.sql import Window

    kept = F.map_filter("all", lambda k, x: ~k.rlike("^(" + "|".join(dropped) + ")"))
    first = F.row_number().over(Window.partitionBy("osm_type", "osm_id").orderBy("line_no"))
    good = p.where("ok").withColumn("_n", first).where("_n = 1").select("osm_type", "osm_id", "lat", "lon", kept.alias("tags"))
    return good, p.where("NOT ok").select("line_no", "value")


def publish_gate(pois: DataFrame, least: int) -> DataFrame:
    """One row (n_pois, publish): an index of fewer than ``least`` pois isn't published."""
    return pois.agg(F.count("*").alias("n_pois")).withColumn("publish", F.col("n_pois") >= least)


def read_poi_index(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pois, malformed) of index documents (doc, payload): version 1, a readable time, a source url, a box of four and elements.

    Elements are [n | w | r, id, lat, lon, tags]; the pois of a malformed document aren't read.
    """
    v = F.try_parse_json("payload")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    d = documents.select("doc", "payload", get("$.version", "int").alias("version"), F.try_to_timestamp(get("$.osmTimestamp", "string")).alias("as_of"), get("$.source.url", "string").alias("source_url"), get("$.bbox", "array<double>").alias("bbox"), get("$.elements", "array<variant>").alias("elements"))
    ok = F.coalesce((F.col("version") == 1) & F.col("as_of").isNotNull() & (F.col("source_url") != "") & (F.size("bbox") == 4) & F.col("elements").isNotNull(), F.lit(False))
    rows = d.where(ok).select("doc", "as_of", "source_url", F.explode("elements").alias("e"))
    part = lambda k, kind: F.try_variant_get("e", f"$[{k}]", kind)
    names = F.create_map(*[F.lit(x) for x in ("n", "node", "w", "way", "r", "relation")])
    pois = rows.select("doc", "as_of", "source_url", names[part(0, "string")].alias("osm_type"), part(1, "bigint").alias("osm_id"), part(2, "double").alias("lat"), part(3, "double").alias("lon"), part(4, "map<string,string>").alias("tags"))
    return pois, d.where(~ok).select("doc", "payload")


#: Fixed value: a remark of the service that makes its answer worthless.
RUNTIME_ERROR = r"(?i)runtime (error|remark)|timed out|out of memory"


def read_poi_responses(responses: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(pois, outcomes) of query answers (response_id, status, payload).

    outcome: ok, http, not_json, malformed (no elements) or runtime_error; truncated: as many elements as were asked for.
    Pois are the named ones with a place of their own or a centre, with all their tags; they never change truncated.
    """
    v = F.try_parse_json("payload")
    r = responses.select("response_id", "status", v.alias("v"), F.try_variant_get(v, "$.elements", "array<variant>").alias("elements"), F.try_variant_get(v, "$.remark", "string").alias("remark"))
    outcome = F.when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), "http").when(F.col("v").isNull(), "not_json").when(F.col("elements").isNull(), "malformed").when(F.col("remark").rlike(RUNTIME_ERROR), "runtime_error").otherwise("ok")
    r = r.withColumn("outcome", outcome)
    e = r.where("outcome = 'ok'").select("response_id", F.explode("elements").alias("e"))
    get = lambda path, kind: F.try_variant_get("e", path, kind)
    pois = e.select("response_id", get("$.type", "string").alias("osm_type"), get("$.id", "bigint").alias("osm_id"), F.coalesce(get("$.lat", "double"), get("$.center.lat", "double")).alias("lat"), F.coalesce(get("$.lon", "double"), get("$.center.lon", "double")).alias("lon"), get("$.tags", "map<string,string>").alias("tags"))
    pois = pois.where((F.trim(F.try_element_at("tags", F.lit("name"))) != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return pois, r.select("response_id", "outcome", F.when(F.col("outcome") == "ok", F.size("elements")).alias("n_elements"), ((F.col("outcome") == "ok") & (F.size("elements") >= most)).alias("truncated"))
