"""Candidates, duplicates, chains and the subject's own listing."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_KM, haversine_km
from .joins import SALTS

#: Metres within which equal names, and equal sites or phones, are one business.
NAME_METRES, KEY_METRES = 150.0, 250.0
#: Width of a grid's cells, as a multiple of the distance within which rows are near.
WIDE = 4
_own_dir: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only local mode, as in tests, may go without and gets one temporary folder."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return _own_dir[0]


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: what is read twice is made once, and a lost executor doesn't make it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rankforge/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no frame in use reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def priority_score(website: Column, phone: Column, address: Column, lat: Column, type_in_tags: Column, type_in_name: Column, n_tags: Column) -> Column:
    pts = lambda n, c: F.when(c, F.lit(float(n))).otherwise(0.0)
    return pts(30, website.isNotNull()) + pts(20, type_in_tags) + pts(20, phone.isNotNull()) + pts(15, address.isNotNull() | lat.isNotNull()) + pts(10, type_in_name) + F.least(F.lit(5.0), n_tags / F.lit(2.0))


def poi_candidates(pois: DataFrame, business_type: Column) -> DataFrame:
    """Named pois (tags map, osm_type, osm_id, lat, lon) as candidates; a bad first website or phone isn't replaced by the second."""
    t = lambda *k: F.coalesce(*[F.try_element_at("tags", F.lit(x)) for x in k])
    site = F.trim(t("website", "contact:website"))
    url = F.when(site.rlike(r"^(?i)https?://[^\s/]+"), site).when(site.rlike(r"^[^\s:/]+\.[^\s:/]+(/\S*)?$"), F.concat(F.lit("https://"), site))
    address = F.concat_ws(" ", *[F.nullif(F.try_element_at("tags", F.lit(f"addr:{x}")), F.lit("")) for x in ("housenumber", "street", "city", "state", "postcode")])
    out = pois.select("*", F.trim(t("name")).alias("name"), url.alias("website"), t("phone", "contact:phone").alias("phone"), F.nullif(address, F.lit("")).alias("address"), t("brand").alias("brand"), F.lower(business_type).alias("_t"))
    values = F.transform(F.map_values("tags"), F.lower)
    out = out.where("name <> ''").withColumn("id", F.concat_ws("-", "osm_type", "osm_id"))
    score = priority_score(F.col("website"), F.col("phone"), F.col("address"), F.col("lat"), F.exists(values, lambda v: v.contains(F.col("_t"))), F.lower("name").contains(F.col("_t")), F.size("tags"))
    return out.withColumn("priority_score", score).drop("_t")


def _reach(metres: float) -> float:
    return metres / (1000 * EARTH_KM) * 1.001


def _grid(lat: Column, lon: Column, metres: float, band: Column | None = None) -> tuple[Column, Column, Column]:
    """(band, cell, cells of the band): points within ``metres`` lie in the same or the next band and there in the same or the next cell.

    Bands are of equal height. A band's cells are as wide as ``metres`` can reach where it or a neighbour is nearest to a pole,
    and go round the earth; a band at a pole has one cell.
    """
    reach = _reach(metres)
    height = math.degrees(reach)
    band = F.floor(lat / height) if band is None else band
    outermost = F.least(F.lit(90.0), F.greatest(F.abs(band - 1), F.abs(band + 2)) * F.lit(height))
    share = F.lit(math.sin(reach / 2)) / F.greatest(F.lit(1e-12), F.cos(F.radians(outermost)))
    cells = F.when(share >= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(math.pi) / F.asin(F.least(F.lit(1.0), share)))))
    return band, F.pmod(F.floor((lon + 180) / 360 * cells), cells), cells


def near_pairs(c: DataFrame, key: str, metres: float) -> DataFrame:
    """(market_id, a, b), a < b, of a market's rows with an equal ``key`` that lie within ``metres``.

    One side goes to the cells of a grid that its surroundings touch, the other to its own, and they meet by market, key and cell: a
    name borne all over the map is as many small groups, and only rows that are close are compared. Cells are WIDE times ``metres``
    wide, so most rows go to one or two of them.
    """
    known = c.where(F.col(key).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    band, cell, _ = _grid(F.col("lat"), F.col("lon"), WIDE * metres)
    right = known.select("market_id", F.col(key).alias("key"), band.alias("band"), cell.alias("cell"), F.col("id").alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    margin = F.lit(1.0005 / WIDE)
    at = F.col("lat") / math.degrees(_reach(WIDE * metres))
    left = known.select("market_id", F.col(key).alias("key"), F.col("id").alias("a"), "lat", "lon", F.explode(F.sequence(F.floor(at - margin), F.floor(at + margin))).alias("band"))
    _, _, cells = _grid(F.col("lat"), F.col("lon"), WIDE * metres, F.col("band"))
    at = (F.col("lon") + 180) / 360 * cells
    around = F.array_distinct(F.transform(F.sequence(F.floor(at - margin), F.floor(at + margin)), lambda x: F.pmod(x, cells)))
    left = left.withColumn("cell", F.explode(around))
    close = haversine_km(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon")) * 1000 <= metres
    return left.join(right, ["market_id", "key", "band", "cell"]).where((F.col("a") < F.col("b")) & close).select("market_id", "a", "b")


def same_business_pairs(c: DataFrame) -> DataFrame:
    """(market_id, a, b), a < b, of equal businesses: equal names at one address or within 150 m, equal sites or phones within 250 m.

    c: market_id, id, name_key, address_key, site_key, phone_key, lat, lon. Null keys never match; rows without a place match by
    name and address only. Each branch is a join on equal keys.
    """
    at = c.where("name_key IS NOT NULL AND address_key IS NOT NULL").select("market_id", "name_key", "address_key", "id")
    same = at.withColumnRenamed("id", "a").join(at.withColumnRenamed("id", "b"), ["market_id", "name_key", "address_key"]).where("a < b").select("market_id", "a", "b")
    return same.union(near_pairs(c, "name_key", NAME_METRES)).union(near_pairs(c, "site_key", KEY_METRES)).union(near_pairs(c, "phone_key", KEY_METRES)).distinct()


def stars(rows: DataFrame, keys: Sequence[str], salts: int = SALTS) -> DataFrame:
    """(market_id, a, b) that hold together rows equal in ``keys``: each leads to the least id of its share, and that to the least of all.

    As many links as rows instead of all pairs; the rows of a hot key are dealt over ``salts`` shares.
    """
    dealt = rows.select(*keys, "id", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("_salt"))
    own = dealt.withColumn("a", F.min("id").over(Window.partitionBy(*keys, "_salt")))
    heads = dealt.groupBy(*keys, "_salt").agg(F.min("id").alias("id")).withColumn("a", F.min("id").over(Window.partitionBy(*keys)))
    return own.select("market_id", "a", F.col("id").alias("b")).unionByName(heads.select("market_id", "a", F.col("id").alias("b"))).where("a <> b")


def business_links(c: DataFrame) -> DataFrame:
    """(market_id, a, b): links that connect the same rows as ``same_business_pairs``, but not every pair of them.

    Rows of one name and address, and rows of one key at one place, are stars; of each place one row meets those of places near by.
    """
    out = stars(c.where("name_key IS NOT NULL AND address_key IS NOT NULL"), ["market_id", "name_key", "address_key"])
    for key, metres in (("name_key", NAME_METRES), ("site_key", KEY_METRES), ("phone_key", KEY_METRES)):
        itself = haversine_km(F.col("lat"), F.col("lon"), F.col("lat"), F.col("lon")) * 1000 <= metres  # not so of a place that is no number
        known = c.where(F.col(key).isNotNull() & itself).select("market_id", key, "lat", "lon", "id")
        places = known.groupBy("market_id", key, "lat", "lon").agg(F.min("id").alias("id"))
        out = out.unionByName(stars(known, ["market_id", key, "lat", "lon"])).unionByName(near_pairs(places, key, metres))
    return out


def dedupe_businesses(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidates that survive: of each group of linked ones that with the highest priority, then the smallest id.

    pairs: those of ``same_business_pairs``, or the fewer of ``business_links``.

    Labels spread along the pairs and jump to their label's label until none changes; each round is a table in the
    shared folder, so lineage stays short and a lost executor costs one round, and goes when the next is written; the last stays.
    """
    spark = candidates.sparkSession
    where = f"{shared_folder(spark)}/rankforge/{uuid.uuid4().hex}"

    def kept(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{where}/{k}")
        return spark.read.schema(df.schema).parquet(f"{where}/{k}")

    ways = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))
    both = kept(pairs.select("market_id", F.inline(ways)), 0)
    label = kept(both.select("market_id", "id").distinct().withColumn("label", F.col("id")), 1)
    k = 1
    while True:
        k += 1
        of_other = label.select("market_id", F.col("id").alias("other"), F.col("label").alias("l"))
        low = both.join(of_other, ["market_id", "other"]).groupBy("market_id", "id").agg(F.min("l").alias("l"))
        new = label.join(low, ["market_id", "id"]).select("market_id", "id", F.col("label").alias("was"), F.least("label", "l").alias("label"))
        jump = new.select("market_id", F.col("id").alias("label"), F.col("label").alias("next"))
        new = kept(new.join(jump, ["market_id", "label"]).select("market_id", "id", "was", F.least("label", "next").alias("label")), k)
        forget(spark, f"{where}/{k - 1}")
        label = new.drop("was")
        if new.where("was <> label").isEmpty():
            break
    forget(spark, f"{where}/0")
    full = candidates.join(label, ["market_id", "id"], "left").withColumn("label", F.coalesce("label", "id"))
    best = F.row_number().over(Window.partitionBy("market_id", "label").orderBy(F.desc("priority_score"), "id"))
    return full.withColumn("_n", best).where("_n = 1").drop("_n", "label")


def flag_chains(candidates: DataFrame) -> DataFrame:
    """Adds is_chain and brand: a brand tag, or a domain root that two or more candidates of the market list.

    domain_root is null for shared hosts, which never make a chain.
    """
    n = candidates.where("domain_root IS NOT NULL").groupBy("market_id", "domain_root").agg((F.count("*") >= 2).alias("_many"))
    candidates = candidates.join(n, ["market_id", "domain_root"], "left")
    chain = F.col("brand").isNotNull() | F.coalesce("_many", F.lit(False))
    return candidates.withColumn("is_chain", chain).withColumn("brand", F.when(F.col("is_chain"), F.coalesce("brand", "name"))).drop("_many")


def exclude_self(candidates: DataFrame, subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(competitors, best matches): candidates other than the subject, and each market's nearest listing of the subject.

    subjects: market_id, user_name_key, user_site. A candidate matches by site, else by its name or by the part of it before a
    separator. Site matches come first, then nearer ones.
    """
    j = candidates.join(subjects, "market_id", "left")
    by_site = F.coalesce(F.col("site_key") == F.col("user_site"), F.lit(False))
    by_name = F.coalesce((F.col("name_key") == F.col("user_name_key")) | (F.col("name_segment") == F.col("user_name_key")), F.lit(False))
    j = j.withColumn("match", F.when(by_site, "site").when(by_name, "name"))
    mine = j.where("match IS NOT NULL")
    best = F.row_number().over(Window.partitionBy("market_id").orderBy(F.when(F.col("match") == "site", 0).otherwise(1), "distance_km", "id"))
    drop = ("user_name_key", "user_site", "match")
    return j.where("match IS NULL").drop(*drop), mine.withColumn("_n", best).where("_n = 1").drop("_n", "user_name_key", "user_site")


def asof_snapshot(requests: DataFrame, saved: DataFrame, fresh_hours: int = 72, stale_hours: int = 336, slice_hours: int = 6) -> DataFrame:
    """Adds snapshot_at and state (fresh, stale, none): the newest saved row of the request's key that is not too old.

    requests: key, as_of, live_failed; saved: key, saved_at. A stale row serves only if the live source failed. A null key or time
    finds nothing; repeated requests are all kept.

    A merge, not a product of requests and saves: both are one table in order of time, and each request takes the last save before
    it. A key's time is cut into slices of ``slice_hours``, which are sorted apart; into each goes the newest save of the slices before,
    found from one row a slice. So a hot key is as many groups as it has slices, and a group is sorted, never held.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    slot = lambda c: F.floor(micros(c) / F.lit(slice_hours * 3.6e9))
    asked = requests.select("key", slot("as_of").alias("slice"), F.col("as_of").alias("at"), F.struct("*").alias("r"))
    kept = saved.where("key IS NOT NULL AND saved_at IS NOT NULL").select("key", slot("saved_at").alias("slice"), F.col("saved_at").alias("at")).distinct()
    newest = kept.groupBy("key", "slice").agg(F.max("at").alias("newest"))
    used = asked.where("key IS NOT NULL AND slice IS NOT NULL").select("key", "slice").distinct().withColumn("newest", F.lit(None).cast(newest.schema["newest"].dataType))
    slices = newest.union(used).groupBy("key", "slice").agg(F.max("newest").alias("newest"))
    before = F.max("newest").over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = slices.select("key", "slice", before.alias("at")).where("at IS NOT NULL")
    saves = kept.union(carried).withColumn("saved_at", F.col("at")).withColumn("r", F.lit(None).cast(asked.schema["r"].dataType))
    none = F.lit(None).cast(newest.schema["newest"].dataType)
    line = asked.select("key", "slice", "at", none.alias("saved_at"), "r").union(saves.select("key", "slice", "at", "saved_at", "r"))
    w = Window.partitionBy("key", "slice").orderBy("at", F.col("r").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = line.withColumn("saved_at", F.max("saved_at").over(w)).where("r IS NOT NULL").select("r.*", "saved_at")
    age = (micros("as_of") - micros("saved_at")) / F.lit(3.6e9)
    found = F.col("key").isNotNull() & F.col("as_of").isNotNull() & F.col("saved_at").isNotNull() & (age <= stale_hours)
    state = F.when(~found, "none").when(age <= fresh_hours, "fresh").when(F.col("live_failed"), "stale").otherwise("none")
    return g.withColumn("state", state).withColumn("snapshot_at", F.when(F.col("state") != "none", F.col("saved_at"))).drop("saved_at")
