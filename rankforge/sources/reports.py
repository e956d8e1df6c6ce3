"""Stored reports, snapshots, sign-up events and their sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import csv_safe, half_up

ACTIVE_HOURS, RETAINED_HOURS, POOL, LEAST_POOL = 72, 720, 12, 10


def report_status(reports: DataFrame) -> DataFrame:
    """Adds status: missing, legacy, invalid or ok. reports: report_id, payload (JSON envelope: version, id, createdAt)."""
    j = F.from_json("payload", "version int, id string, createdAt string")
    ok = (j["id"] == F.col("report_id")) & F.try_to_timestamp(j["createdAt"]).isNotNull()
    status = F.when(F.col("payload").isNull(), "missing").when(j.isNull() | j["version"].isNull(), "legacy").when((j["version"] == 2) & F.coalesce(ok, F.lit(False)), "ok").otherwise("invalid")
    return reports.withColumn("status", status)


def report_volume(stored: DataFrame) -> DataFrame:
    """(generation, n_reports, n_competitors, n_unreadable) by key prefix; an unreadable count is never zero. stored: key, payload."""
    gen = F.when(F.startswith("key", F.lit("report:v2:")), "v2").when(F.startswith("key", F.lit("report:")), "legacy")
    n = F.get_json_object("payload", "$.report.summary.competitorCount").try_cast("bigint")
    return stored.withColumn("generation", gen).where("generation IS NOT NULL").groupBy("generation").agg(F.count("*").alias("n_reports"), F.sum(n).alias("n_competitors"), F.count_if(n.isNull()).alias("n_unreadable"))


def aged(snapshots: DataFrame, as_of: str) -> DataFrame:
    return snapshots.withColumn("age_h", F.timestamp_diff("MICROSECOND", F.col("generated_at"), F.lit(as_of).cast("timestamp_ntz")) / F.lit(3.6e9))


def serving_pool(snapshots: DataFrame, as_of: str) -> DataFrame:
    """(id, generated_at, pool): the newest 12 of at most 72 hours if there are any, else all of 30 days; later ones than as_of never."""
    a = aged(snapshots, as_of).where((F.col("age_h") >= 0) & (F.col("age_h") <= RETAINED_HOURS))
    top = a.where(F.col("age_h") <= ACTIVE_HOURS).orderBy(F.desc("generated_at"), "id").limit(POOL).withColumn("pool", F.lit("active"))
    any_active = top.agg((F.count("*") > 0).alias("has"))  # one row
    rest = a.crossJoin(F.broadcast(any_active)).where("NOT has").drop("has").withColumn("pool", F.lit("retained"))
    return top.unionByName(rest).select("id", "generated_at", "pool")


def pool_health(snapshots: DataFrame, catalogue: DataFrame, as_of: str) -> DataFrame:
    """One row: active, retained, ages in hours, alert flags and how many catalogue ids lack a fresh snapshot."""
    a = aged(snapshots, as_of).where((F.col("age_h") >= 0) & (F.col("age_h") <= RETAINED_HOURS))
    fresh = F.col("age_h") <= ACTIVE_HOURS
    lacking = catalogue.select("id").distinct().join(a.where(fresh), "id", "left_anti").agg(F.count("*").alias("lacking"))
    g = a.agg(F.count_if(fresh).alias("active"), F.count("*").alias("retained"), half_up(F.min("age_h"), 2).alias("newest_h"), half_up(F.max("age_h"), 2).alias("oldest_h"))
    g = g.withColumn("low_active", F.col("active") < LEAST_POOL).withColumn("serving_retained", F.col("active") == 0)
    return g.crossJoin(F.broadcast(lacking))  # one row each


def snapshot_meta(meta: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Meta rows, and for ids without one a row from the snapshot."""
    return meta.unionByName(snapshots.join(meta, "catalog_id", "left_anti").select(*meta.columns))


def catalog_violations(entries: DataFrame, industries: Sequence[str], expected: int) -> DataFrame:
    """(rule, value) of a catalogue (id, industry, name, url)."""
    e = entries
    rule = lambda df, name, v: df.select(F.lit(name).alias("rule"), v.cast("string").alias("value"))
    twice = lambda c: rule(e.groupBy(c).count().where("count > 1"), f"{c}_twice", F.col(c))
    want = e.sparkSession.createDataFrame([(x,) for x in industries], "industry string")
    blank = rule(e.where("coalesce(trim(name), '') = '' OR coalesce(trim(industry), '') = ''"), "blank", F.col("id"))
    out = rule(e.agg(F.count("*").alias("n")).where(F.col("n") != expected), "count", F.col("n")).union(blank)
    out = out.union(rule(e.where(~F.coalesce(F.col("id").rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False))), "slug", F.col("id"))).union(rule(e.where("NOT coalesce(url LIKE 'https://%', false)"), "https", F.col("id")))
    return out.union(twice("id")).union(twice("industry")).union(rule(want.join(e, "industry", "left_anti"), "industry_missing", F.col("industry")))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with line_no-free schema, malformed lines) of a JSON-lines file."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    good = F.col("j._corrupt_record").isNull() & F.startswith(F.trim("value"), F.lit("{"))
    return parsed.where(good).select("j.*").drop("_corrupt_record"), parsed.where(~good).select("value")


def merge_signups(events: DataFrame) -> DataFrame:
    """One row an e-mail (lower, trimmed): the first event's fields, and all messages in order. events: event_ord, email, source, message."""
    e = events.withColumn("email", F.lower(F.trim("email")))
    said = F.when(F.trim("message") != "", F.struct("event_ord", F.concat(F.lit("["), F.col("event_ord").cast("string"), F.lit("] "), F.trim("message")).alias("m")))
    g = e.groupBy("email").agg(F.min("event_ord").alias("first_ord"), F.min_by("source", "event_ord").alias("source"), F.count("*").alias("n_events"), F.sort_array(F.collect_list(said)).alias("s"))
    return g.select("email", "first_ord", "source", "n_events", F.when(F.size("s") > 0, F.array_join(F.transform("s", lambda x: x["m"]), "\n")).alias("messages"))


def write_csv(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """One file with one header: the given columns, then the others by name; cells that a spreadsheet would run are quoted by an apostrophe.

    The export is read by people, so its rows stream through one task into one file (a header alone if there are none).
    """
    order = [*columns, *sorted(set(rows.columns) - set(columns))]
    safe: list[Column] = [csv_safe(F.col(c).cast("string")).alias(c) for c in order]
    rows.select(*safe).repartition(1).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(path)


def json_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(json) of each row: the given columns that it has a value for, in that order."""
    return rows.select(F.to_json(F.struct(*columns)).alias("json"))


def write_json(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    json_rows(rows, columns).write.mode("overwrite").text(path)


def write_reports(valid: DataFrame, path: str) -> None:
    """Reports by created date, so that retention drops whole folders."""
    valid.withColumn("created_date", F.to_date("created_at")).write.mode("append").partitionBy("created_date").json(path)


def latest_version(snapshots: DataFrame) -> DataFrame:
    """The last version of each catalogue id (a replacement is an appended version)."""
    n = F.row_number().over(Window.partitionBy("catalog_id").orderBy(F.desc("generated_at"), F.desc("version")))
    return snapshots.withColumn("_n", n).where("_n = 1").drop("_n")
