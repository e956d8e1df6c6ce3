"""Shared helpers: tables in the shared folder and distributed connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_own_dir: list[str] = []
#: Tables written so far; ``drop_tables`` takes from this list.
made: list[str] = []


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of a text with A-Z lower-cased (bytes split at just the characters that WORD excludes)."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often a lambda inside reads it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only local mode, as in tests, may go without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return _own_dir[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends and every reader sees the same rows.

    The table stays until ``drop_tables`` (its rows may be read long after this call).
    """
    path = f"{shared_dir(df.sparkSession)}/rankforge/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables that no frame in use reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    made[:] = [p for p in made if p not in set(paths)]


def salted_join(left: DataFrame, right: DataFrame, key: str, count: str, spread: str, total: int, counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined by ``key`` with ``right``, which has one row a key and in ``count`` the key's rows in ``left``.

    A key of more than ``total / 1000`` rows (1000 at least) is dealt over several tasks by a hash of ``spread``, and its
    row of ``right`` is repeated for each. There can be no more than 1000 such keys, so their list may be broadcast. It is
    taken from ``counts`` (key, count), if given, where ``right`` is dear to make twice.
    """
    limit = max(1000, total // 1000)
    parts = F.ceil(F.col(count) / limit).cast("int")
    hot = (right if counts is None else counts).where(F.col(count) > limit).select(key, parts.alias("_parts"))
    left = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    right = right.select("*", F.explode(F.when(F.col(count) > limit, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))).alias("_salt")).drop(count)
    return left.join(right, [key, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node that has an edge to another one; the component is its smallest node.

    Alternates large-star and small-star rounds (each links nodes to the smallest neighbour) until every node has
    one edge to a root, which takes about log(n) rounds. Minima are aggregated map-side and joined back by salted keys, so a
    hub with a third of all edges is dealt over many tasks and is never a collected group. Each round is written and
    the one before it deleted. Null ends and self-loops are no edges.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    now = materialize(now.distinct(), "edges")
    path = made[-1]
    while True:
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
        nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        n, knots = nodes.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
        if not knots:
            break
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = salted_join(both, low, "u", "n", "v", 2 * n).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = salted_join(large, low, "a", "n", "b", 2 * n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop_tables(spark, [path])
        path = made[-1]
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def bit_table(keys: DataFrame, bits: int) -> np.ndarray:
    """Bits of hashes, or-ed by Spark; at most bits / 64 rows come to the driver."""
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, CAST(key & 63 AS INT))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[got["word"].to_numpy()] = got["bit"].to_numpy().view(np.uint64)
    return table
