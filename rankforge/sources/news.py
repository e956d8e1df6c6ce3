"""Answers of a news search and of a gazetteer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of regions that mean a country code.
REGION_ALIASES = {"uk": "gb", "united kingdom": "gb", "england": "gb", "scotland": "gb", "wales": "gb", "usa": "us", "united states": "us", "united states of america": "us"}
#: Parts of an address that may name its region.
REGION_FIELDS = ("state", "province", "region", "state_district", "county", "country", "country_code")


def read_articles(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, outcomes) of search answers (answer_id, payload): usable articles have a title and an http url.

    Plain text is how the service tells of errors: outcome error, never an empty result; a JSON object without articles is ok.
    """
    v = F.try_parse_json("payload")
    a = answers.select("answer_id", v.alias("v"), F.try_variant_get(v, "$.articles", "array<variant>").alias("articles"), F.coalesce(F.startswith(F.trim("payload"), F.lit("{")), F.lit(False)).alias("object"))
    ok = F.col("v").isNotNull() & F.col("object")
    rows = a.where(ok).select("answer_id", F.posexplode("articles").alias("ord", "x"))
    get = lambda path: F.try_variant_get("x", path, "string")
    rows = rows.select("answer_id", "ord", F.trim(get("$.title")).alias("title"), F.trim(get("$.url")).alias("url"), get("$.seendate").alias("seendate"))
    return rows.where((F.col("title") != "") & F.col("url").rlike("^(?i)https?://")), a.select("answer_id", F.when(ok, "ok").otherwise("error").alias("outcome"))


def read_gazetteer(answers: DataFrame) -> DataFrame:
    """(market_id, input_rank, display_name, lat, lon, south, north, west, east, addresstype, importance, address) of answers
    (market_id, payload: a JSON array). Numbers come as texts; a box of other than four numbers is null, a place without a name or
    a finite position is left out."""
    rows = answers.select("market_id", F.posexplode(F.try_variant_get(F.try_parse_json("payload"), "$", "array<variant>")).alias("input_rank", "x"))
    get = lambda path, kind="string": F.try_variant_get("x", path, kind)
    number = lambda c: F.when(F.abs(c.try_cast("double")) < float("inf"), c.try_cast("double"))
    box = F.transform(get("$.boundingbox", "array<string>"), lambda b: number(b))
    whole = (F.size(box) == 4) & F.forall(box, lambda b: b.isNotNull())
    side = lambda k: F.when(whole, box[k])
    out = rows.select("market_id", "input_rank", get("$.display_name").alias("display_name"), number(get("$.lat")).alias("lat"), number(get("$.lon")).alias("lon"), side(0).alias("south"), side(1).alias("north"), side(2).alias("west"), side(3).alias("east"), get("$.addresstype").alias("addresstype"), get("$.importance", "double").alias("importance"), get("$.address", "map<string,string>").alias("address"))
    return out.where((F.col("display_name") != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def normal_region(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def region_of(market: Column) -> Column:
    """What follows the last comma of a market's name; null without one."""
    parts = F.filter(F.transform(F.split(market, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.nullif(normal_region(F.element_at(parts, -1)), F.lit("")))


def matches_region(address: Column, region: Column) -> Column:
    """Whether a part of the address (a map) is the region, or what it is an alias of; ISO codes count whole and by their last part."""
    aliases = F.create_map(*[F.lit(x) for pair in REGION_ALIASES.items() for x in pair])
    part = lambda k: F.try_element_at(address, F.lit(k))
    iso = F.coalesce(part("ISO3166-2-lvl4"), part("ISO3166-2-lvl6"))
    values = F.transform(F.array(*[part(k) for k in REGION_FIELDS], iso, F.get(F.split(iso, "-"), F.lit(1))), normal_region)
    wanted = F.coalesce(F.try_element_at(aliases, region), region)
    return F.coalesce(F.exists(values, lambda v: (v != "") & ((v == wanted) | (v == region))), F.lit(False))
