"""Admission of new sign-ups, at most so many a window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.entity import shared_folder


def admit_signups(tries: DataFrame, seconds: int = 60, most: int = 10, used: DataFrame | None = None) -> DataFrame:
    """(key, admitted_ord, admitted_window) of every key; nulls if none of its tries was admitted. tries: ord, ts, key.

    ``used`` (w, n): how many a window (its start in epoch seconds) has admitted before these tries.

    In each window the first ``most`` keys that aren't known yet are admitted; a denied key stays unknown and may try
    again. Every key proposes its first window; a window keeps its first keys and the others propose their next one,
    until none is left over. Each round is a table in the shared folder, and their number is that of a key's tries at most.
    """
    used = used.select("w", F.col("n").alias("n_used")) if used is not None else None
    spark, where = tries.sparkSession, f"{shared_folder(tries.sparkSession)}/rankforge/{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{where}/{name}")
        return spark.read.schema(df.schema).parquet(f"{where}/{name}")

    w = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds) * seconds
    first = tries.where("key IS NOT NULL").withColumn("w", w).groupBy("key", "w").agg(F.min(F.struct("ts", "ord")).alias("at"))
    first = kept(first.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("w"))), "tries")
    state = first.where("n = 1")
    step = 0
    while True:
        placed = state.withColumn("place", F.row_number().over(Window.partitionBy("w").orderBy("at")))
        if used is not None:
            placed = placed.join(used, "w", "left").withColumn("place", F.col("place") + F.coalesce("n_used", F.lit(0))).drop("n_used")
        placed = kept(placed, f"round-{step}")
        lost = placed.where(F.col("place") > most).select("key", (F.col("n") + 1).alias("n"))
        if lost.isEmpty():
            break
        state = placed.where(F.col("place") <= most).drop("place").unionByName(first.join(lost, ["key", "n"]).select("key", "w", "at", "n"))
        step += 1
    got = placed.select("key", F.col("at.ord").alias("admitted_ord"), F.timestamp_seconds("w").alias("admitted_window"))
    return first.select("key").distinct().join(got, "key", "left")


class AdmissionSink:
    """A stream's sign-ups, each admitted once: the function of ``foreachBatch``.

    A micro-batch reads what earlier ones admitted (known keys, and how much of each window's budget is used) and writes its own
    decisions to ``decided/batch=<id>`` under ``path``: a batch that is run again after a failure reads the same earlier batches and
    replaces its own folder, so nobody is admitted twice and no budget is spent twice. Every try gets a row: ``new`` (admitted), ``exists`` (its key
    was or is just admitted) or ``limited`` (it may try again). A null key is ``limited``. If batches come in the order of time,
    the admitted tries are those of ``admit_signups``; a late try finds what is left of its window.
    """

    def __init__(self, path: str, seconds: int = 60, most: int = 10):
        self.path, self.seconds, self.most = path, seconds, most

    def decided(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """(ord, ts, key, decision, batch) of the batches so far."""
        schema = "ord bigint, ts timestamp, key string, decision string, batch bigint"
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/decided")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(f"{self.path}/decided")
        return rows if before is None else rows.where(F.col("batch") < before)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tries = batch.select(F.col("ord").cast("bigint").alias("ord"), F.col("ts").cast("timestamp").alias("ts"), F.col("key").cast("string").alias("key"))
        before = self.decided(spark, batch_id).where("decision = 'new'")
        known = before.select("key")
        window = F.floor(F.unix_seconds("ts") / self.seconds) * self.seconds
        used = before.groupBy(window.alias("w")).agg(F.count("*").alias("n"))
        fresh = tries.join(known, "key", "left_anti")
        got = admit_signups(fresh, self.seconds, self.most, used).where("admitted_ord IS NOT NULL").select("key", "admitted_ord")
        at = fresh.join(got, ["key"]).where("ord = admitted_ord").select("key", F.struct("ts", "ord").alias("at"), "admitted_ord")
        rows = tries.join(known.withColumn("known", F.lit(True)), "key", "left").join(at, "key", "left")
        decision = F.when(F.col("known"), "exists").when(F.col("ord") == F.col("admitted_ord"), "new").when(F.struct("ts", "ord") > F.col("at"), "exists").otherwise("limited")
        rows.select("ord", "ts", "key", decision.alias("decision")).write.mode("overwrite").parquet(f"{self.path}/decided/batch={batch_id}")
