"""Requests, industries and markets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sanitize
from .joins import salted_join

#: Keys that a probe tries in order, gazetteer types that are settlements, and the rival's share of importance.
PROBE_KEYS = ("shop", "amenity", "office", "craft", "leisure", "tourism")
SETTLEMENTS = ("city", "town", "village", "hamlet", "municipality", "borough", "suburb", "city_district", "district", "quarter", "neighbourhood", "locality", "postcode")
RIVAL_SHARE = 0.85
#: Rows of a category map that is sent to every executor; a larger one is shuffled.
MOST_SENT = 50_000
#: Fixed values: (field, name in a request's JSON, longest raw length).
LIMITS = (("business_name", "businessName", 80), ("business_url", "businessUrl", 300), ("business_type", "businessType", 80), ("market", "market", 120))
_URL = r"^(?is)https?://([^\s/?#@]*@)?(\[[0-9a-f:.]+\]|[^\s/?#@:<>^|%\[\]]+)(:\d{0,5})?([/?#].*)?$"


def read_requests(bodies: DataFrame) -> DataFrame:
    """``bodies`` (with body, a JSON text) with the fields of LIMITS and form_errors.

    form_errors: ``body:not_object`` (also for null, broken JSON and a key that occurs twice), ``unknown:<key>`` of each key that a
    request doesn't have, in order, and ``<field>:not_text`` for a field that is absent or no string; such a field is null.
    """
    v = bodies.withColumn("_v", F.try_parse_json("body"))
    item = lambda name: F.try_variant_get(F.col("_v"), f"$.{name}", "variant")
    is_text = lambda name: F.coalesce(F.schema_of_variant(item(name)) == "STRING", F.lit(False))
    fields = {field: F.when(is_text(name), F.try_variant_get(F.col("_v"), f"$.{name}", "string")) for field, name, _ in LIMITS}
    keys = F.when(F.col("_v").isNotNull(), F.json_object_keys("body"))
    others = F.array_sort(F.filter(keys, lambda k: ~k.isin(*[name for _, name, _ in LIMITS])))
    absent = F.array_compact(F.array(*[F.when(~is_text(name), f"{field}:not_text") for field, name, _ in LIMITS]))
    errors = F.when(keys.isNull(), F.array(F.lit("body:not_object"))).otherwise(F.concat(F.transform(others, lambda k: F.concat(F.lit("unknown:"), k)), absent))
    return v.withColumns({**fields, "form_errors": errors}).drop("_v")


def validate_requests(requests: DataFrame) -> DataFrame:
    """Cleaned fields, violations (array of field:rule) and message.

    Lengths are tested first as they came, where a failure ends a field, then after cleaning; an address is only trimmed and
    needs http or https. Null counts as empty; what ``form_errors`` names as no text or no object has no further violation. message is the first violation
    that tells its own rule (the address, then the market), else ``invalid``; null if there is none.
    """
    formed = F.col("form_errors") if "form_errors" in requests.columns else F.array().cast("array<string>")
    lengths: list[Column] = []
    raw = {field: F.coalesce(F.col(field), F.lit("")) for field, _, _ in LIMITS}
    silent = lambda field: F.arrays_overlap(formed, F.array(F.lit("body:not_object"), F.lit(f"{field}:not_text")))
    ends = {field: (F.length(raw[field]) > most) | silent(field) for field, _, most in LIMITS}
    for field, _, most in LIMITS:
        lengths.append(F.when(F.length(raw[field]) > most, f"{field}:too_long"))
        if field != "business_url":
            lengths.append(F.when(~ends[field] & (F.length(sanitize(raw[field])) < 2), f"{field}:too_short"))
    parts = F.transform(F.split(sanitize(raw["market"]), ","), lambda x: F.length(F.trim(x)) >= 2)
    placed = F.get(parts, F.lit(0)) & F.exists(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x)
    rules = [
        F.when(~ends["business_url"] & ~F.trim(raw["business_url"]).rlike(_URL), "business_url:not_http"),
        F.when(~ends["market"] & (F.length(raw["market"]) >= 2) & ~placed, "market:no_region"),
    ]
    own = F.get(F.array_compact(F.array(*rules)), F.lit(0))
    out = requests.withColumn("violations", F.concat(formed, F.array_compact(F.array(*lengths, *rules))))
    out = out.withColumn("message", F.coalesce(own, F.when(F.size("violations") > 0, "invalid")))
    return out.withColumns({field: F.trim(field) if field == "business_url" else sanitize(F.col(field)) for field, _, _ in LIMITS})


def validate_signups(signups: DataFrame) -> DataFrame:
    """Lower-cased e-mail and violations."""
    email = F.lower(F.trim("email"))
    bad = [F.when(~F.coalesce(F.length(email).between(5, 254) & email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False)), "email"), *[F.when(F.length(c) > n, c) for c, n in (("source", 80), ("report_id", 64), ("message", 1000))]]
    return signups.withColumn("email", email).withColumn("violations", F.array_compact(F.array(*bad)))


def resolve_industry(requests: DataFrame, category_map: DataFrame, stop_words: Sequence[str] = ("and", "the", "of", "for", "in", "a"), most_tags: int = 24) -> DataFrame:
    """(request_id, stage, keyword, tags): map, probe or none.

    category_map: keyword, ord, key, value; a keyword whose only row has a null key is a known dead end, which ends the
    search with none. Phrases are tried whole, then by three and two words from the left, then by single words
    from the right. Without a hit the probe offers the joined phrase and each word under the probe keys. Requests,
    their phrases and hits are never broadcast: a table's small files can hold more rows than a driver.
    """
    words = F.filter(F.split(F.lower(F.regexp_replace("business_type", r"[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")
    r = requests.select("request_id", words.alias("w")).withColumn("n", F.size("w"))
    grams = F.flatten(F.transform(F.array(F.lit(3), F.lit(2)), lambda k: F.when(F.col("n") >= k, F.transform(F.sequence(F.lit(0), F.col("n") - k), lambda i: F.struct(F.lit(2).alias("stage"), (-k).alias("a"), i.alias("b"), F.array_join(F.slice("w", i + 1, k), " ").alias("phrase")))).otherwise(F.array())))
    content = F.filter("w", lambda x: ~x.isin(*stop_words))
    singles = F.transform(content, lambda x, i: F.struct(F.lit(3).alias("stage"), F.lit(0).alias("a"), (-i).alias("b"), x.alias("phrase")))
    whole = F.array(F.struct(F.lit(1).alias("stage"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.array_join("w", " ").alias("phrase")))
    tries = r.select("request_id", F.inline(F.concat(whole, grams, singles)))
    known = category_map.groupBy(F.col("keyword").alias("phrase")).agg(F.sort_array(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("ord", "key", "value")))).alias("tags"))
    if category_map.limit(MOST_SENT + 1).count() <= MOST_SENT:
        met = tries.join(F.broadcast(known), "phrase")
    else:
        met = salted_join(tries, known.hint("merge"), ["phrase"], ["request_id"])
    hit = met.withColumn("_n", F.row_number().over(Window.partitionBy("request_id").orderBy("stage", "a", "b"))).where("_n = 1")
    values = F.array_distinct(F.concat(F.when(F.size(content) >= 2, F.array(F.array_join(content, "_"))).otherwise(F.array()), content))
    probe = F.flatten(F.transform(values, lambda v: F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k in PROBE_KEYS])))
    out = r.join(hit.select("request_id", "phrase", "tags").hint("merge"), "request_id", "left").withColumn("probe", probe)
    tags = F.transform("tags", lambda t: F.struct(t["key"].alias("key"), t["value"].alias("value")))
    stage = F.when(F.col("tags").isNotNull(), F.when(F.size("tags") > 0, "map").otherwise("none")).when(F.size("probe") > 0, "probe").otherwise("none")
    out = out.withColumn("stage", stage)
    return out.select("request_id", "stage", F.col("phrase").alias("keyword"), F.slice(F.when(F.col("stage") == "map", tags).when(F.col("stage") == "probe", F.col("probe")).otherwise(F.array()), 1, most_tags).alias("tags"))


def resolve_market(requests: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(market_id, status, display_name, labels): ok, not_found or ambiguous.

    gazetteer: market_id, input_rank, display_name, addresstype, importance, country, state, regions (array of lower-case
    names a region may match). Settlements in the asked region are preferred; a rival in another area with 0.85 of the
    top importance makes the market ambiguous.
    """
    region = F.lower(F.trim(F.element_at(F.split("market", ","), -1)))
    asked = requests.select("market_id", F.when(F.col("market").contains(","), region).alias("region"))
    j = gazetteer.where(F.col("addresstype").isin(*SETTLEMENTS)).join(asked, "market_id")
    j = j.withColumn("fits", F.coalesce(F.array_contains("regions", F.col("region")), F.lit(False))).withColumn("imp", F.coalesce("importance", F.lit(0.0)))
    j = j.withColumn("area", F.lower(F.concat_ws("|", F.coalesce("country", F.lit("")), F.coalesce("state", F.lit("")))))
    w = Window.partitionBy("market_id")
    j = j.withColumn("any_fits", F.max("fits").over(w)).where("fits OR NOT any_fits")
    order = w.orderBy(F.desc("imp"), "input_rank")
    j = j.withColumn("n", F.row_number().over(order)).withColumn("top", F.first("imp").over(order)).withColumn("top_area", F.first("area").over(order))
    rival = (F.col("n") > 1) & (F.col("area") != F.col("top_area")) & (F.col("top") > 0) & (F.col("imp") >= F.col("top") * F.lit(RIVAL_SHARE))
    g = j.groupBy("market_id").agg(F.max(rival).alias("ambiguous"), F.min_by("display_name", "n").alias("display_name"), F.sort_array(F.collect_list(F.when(rival | (F.col("n") == 1), F.struct("n", "display_name")))).alias("l"))
    out = asked.select("market_id").join(g, "market_id", "left")
    status = F.when(F.col("ambiguous").isNull(), "not_found").when(F.col("ambiguous"), "ambiguous").otherwise("ok")
    return out.select("market_id", status.alias("status"), F.when(~F.col("ambiguous"), F.col("display_name")).alias("display_name"), F.when(F.col("ambiguous"), F.array_join(F.transform("l", lambda x: x["display_name"]), "; ")).alias("labels"))


def market_status(stages: DataFrame) -> DataFrame:
    """(market_id, code, retryable): the first failure in order.

    stages: market_id, geo_status, industry_stage, n_competitors, subject_failure (null: fine).
    """
    s = F.col("subject_failure")
    code = F.when(F.col("geo_status") != "ok", F.col("geo_status")).when(F.col("industry_stage") == "none", "type_unresolved").when(F.col("n_competitors") == 0, F.when(F.col("industry_stage") == "map", "no_competitors").otherwise("type_unresolved")).when(s.isNotNull(), "subject_unavailable").otherwise("ok")
    out = stages.withColumn("code", code)
    return out.select("market_id", "code", ((F.col("code") == "subject_unavailable") & s.isin("timeout", "connection", "blocked")).alias("retryable"))
