"""Minimum-cost-flow resharding: from old shard sizes to new capacities with the fewest bytes moved.

The driver sees one number a shard. Each old shard is a line of bytes, made of blocks of bounded size; the flow
says how many bytes of the line stay and how many go to each new shard, and a document goes where its first byte
lies, so whole blocks move together. A document that lies across a cut makes a shard larger than its capacity; such
differences are then settled by moving a few documents of fitting sizes, of which each shard offers a bounded number.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def min_cost_transfers(sizes: dict[int, int], capacities: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard: successive shortest paths with potentials; a byte that moves costs 1.

    ``capacities`` must hold all bytes. The graph has a node a shard.
    """
    old, new = sorted(sizes), sorted(capacities)
    nodes = ["s", *[("o", i) for i in old], *[("n", j) for j in new], "t"]
    at = {v: k for k, v in enumerate(nodes)}
    to, cap, cost, out = [], [], [], [[] for _ in nodes]

    def edge(u: int, v: int, c: int, w: int) -> None:
        for a, b, x, y in ((u, v, c, w), (v, u, 0, -w)):
            out[a].append(len(to))
            to.append(b)
            cap.append(x)
            cost.append(y)

    for i in old:
        edge(0, at["o", i], sizes[i], 0)
    direct = {}
    for i in old:
        for j in new:
            direct[i, j] = len(to)
            edge(at["o", i], at["n", j], sizes[i], int(i != j))
    for j in new:
        edge(at["n", j], at["t"], capacities[j], 0)
    potential, end = [0] * len(nodes), at["t"]
    while True:
        dist, via, heap = [None] * len(nodes), [-1] * len(nodes), [(0, 0)]
        dist[0] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in out[u]:
                if cap[e]:
                    x = d + cost[e] + potential[u] - potential[to[e]]
                    if dist[to[e]] is None or x < dist[to[e]]:
                        dist[to[e]], via[to[e]] = x, e
                        heapq.heappush(heap, (x, to[e]))
        if dist[end] is None:
            break
        potential = [p + (d or 0) for p, d in zip(potential, dist, strict=True)]
        push, v = None, end
        while v:
            push = cap[via[v]] if push is None else min(push, cap[via[v]])
            v = to[via[v] ^ 1]
        v = end
        while v:
            cap[via[v]] -= push
            cap[via[v] ^ 1] += push
            v = to[via[v] ^ 1]
    return {k: cap[e ^ 1] for k, e in direct.items() if cap[e ^ 1]}


#: Documents of each power of two of bytes that a shard offers for settling.
OFFERS = 16


def settle(sizes: dict[int, int], capacities: dict[int, int], offers: list[tuple[int, int, int, bool]]) -> dict[int, int]:
    """New shards of some offered rows (row, shard, size, has moved anyway), so that sizes come near the capacities.

    From the shard furthest above its capacity to the one furthest below it goes the offer whose size is nearest to
    half of their difference, as long as one lessens it; among equal sizes one that has left its old shard anyway.
    """
    over = {j: sizes.get(j, 0) - c for j, c in capacities.items()}
    own: dict[int, list[tuple[int, bool, int]]] = {j: [] for j in over}
    for row, shard, size, moved in offers:
        own[shard].append((size, not moved, row))
    out: dict[int, int] = {}
    while over:
        high, low = max(over, key=lambda j: (over[j], -j)), min(over, key=lambda j: (over[j], j))
        gap = over[high] - over[low]
        fit = [x for x in own[high] if x[0] < gap]
        if not fit:
            return out
        best = min(fit, key=lambda x: (abs(2 * x[0] - gap), x))
        own[high].remove(best)
        own[low].append((best[0], False, best[2]))
        out[best[2]] = low
        over[high] -= best[0]
        over[low] += best[0]
    return out


def equal_capacities(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def reshard(docs: DataFrame, old_shard: str, shards: int = 40, capacities: dict[int, int] | None = None, id_col: str = "doc_id", text: str = "text", block_bytes: int = 4_000_000) -> DataFrame:
    """(id, size, text_crc32, old_shard, shard, slot): every row in a new shard, by the law ``bytes``.

    old_shard: SQL expression of the present shard (an int; null counts as shard -1). size: UTF-8 bytes of the text
    (null: none) plus 16. Shards come as near to their capacities as the documents that they offer allow: if no
    document is larger than a shard, they end closer together than the size of a middling one. Slots count each shard's rows from 0.
    Repeated rows keep a slot each, a null id is kept, other columns are not read; an empty table has no rows. Blocks have
    ``block_bytes`` or a 100 000th of all bytes, whichever is more.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t).cast("long").alias("text_crc32"), F.coalesce(F.expr(old_shard).cast("int"), F.lit(-1)).alias("old_shard"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    sizes = {r["old_shard"]: r["b"] for r in rows.groupBy("old_shard").agg(F.sum("size").alias("b")).collect()}  # a row a shard
    capacities = capacities or equal_capacities(sum(sizes.values()), shards)
    moves = min_cost_transfers(sizes, capacities)
    block_bytes = max(block_bytes, sum(sizes.values()) // 100_000)
    line, parts = [], []
    for i in sorted(sizes):
        lo = 0
        parts.append((i, max(1, -(-sizes[i] // block_bytes))))
        for j in sorted((j for a, j in moves if a == i), key=lambda j: (j != i, j)):
            line.append((i, lo, lo + moves[i, j], j))
            lo += moves[i, j]
    spark = docs.sparkSession
    cuts = spark.createDataFrame(line, "old_shard int, lo long, hi long, shard int")  # at most old + new shards rows
    parts = spark.createDataFrame(parts, "old_shard int, blocks long")  # a row an old shard
    rows = rows.join(F.broadcast(parts), "old_shard").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("blocks")
    blocks = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("b"))
    blocks = blocks.select("old_shard", "block", (F.sum("b").over(Window.partitionBy("old_shard").orderBy("block")) - F.col("b")).alias("base"))
    in_block = Window.partitionBy("old_shard", "block").orderBy(id_col, "text_crc32", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("before", F.sum("size").over(in_block) - F.col("size")).join(blocks, ["old_shard", "block"])
    rows = rows.withColumn("at", F.col("base") + F.col("before")).drop("base", "before")
    rows = rows.join(F.broadcast(cuts.withColumnRenamed("old_shard", "o")), (F.col("old_shard") == F.col("o")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).drop("o", "lo", "hi")
    rows = materialize(rows, "placed")
    # a shard's offers: the first documents of each power of two, chosen within each block before they meet
    kind, moved = F.length(F.bin("size")), F.col("shard") != F.col("old_shard")
    few = F.row_number().over(Window.partitionBy("shard", "old_shard", "block", "kind").orderBy(F.desc("moved"), "size", id_col, "row"))
    offers = rows.select("row", "shard", "old_shard", "block", "size", id_col, kind.alias("kind"), moved.alias("moved")).withColumn("k", few).where(F.col("k") <= OFFERS)
    offers = offers.withColumn("k", F.row_number().over(Window.partitionBy("shard", "kind").orderBy(F.desc("moved"), F.xxhash64("size", id_col, "row")))).where(F.col("k") <= OFFERS)
    now = {r["shard"]: r["b"] for r in rows.groupBy("shard").agg(F.sum("size").alias("b")).collect()}  # a row a shard
    taken = settle(now, capacities, [tuple(r) for r in offers.select("row", "shard", "size", "moved").collect()])  # OFFERS a power of two and shard
    if taken:
        moved_again = spark.createDataFrame(sorted(taken.items()), "row long, to int")  # no more rows than offers
        rows = rows.join(F.broadcast(moved_again), "row", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")
    runs = rows.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"))
    runs = runs.select("shard", "old_shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("old_shard", "block")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("shard", "old_shard", "block").orderBy("at"))
    rows = rows.withColumn("within", within).join(runs, ["shard", "old_shard", "block"])
    return rows.select(id_col, "size", "text_crc32", "old_shard", "shard", (F.col("base") + F.col("within") - 1).cast("long").alias("slot"))


def rewrite_affected(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", old_shard: str | None = None) -> DataFrame:
    """Writes the shards that gain or lose rows under ``path`` (a folder a shard, rows by slot) and returns their numbers.

    Shards whose rows all stay keep their files, and the folder of a shard that has lost all rows is deleted. Rows are
    found again by id, size and checksum of the text and a number among those that are equal in all three, so null and
    repeated ids keep all their rows; ``old_shard`` (the expression given to ``reshard``) also tells apart equal texts of
    one id whose other columns differ. ``docs`` may be read from ``path``.
    """
    spark = docs.sparkSession
    moved = placed.where("old_shard <> shard")
    touched = materialize(moved.select(F.col("shard")).union(moved.select(F.col("old_shard"))).distinct(), "touched")
    t = F.coalesce(F.col(text), F.lit(""))
    key = {"_id": F.col(id_col).cast("long"), "_size": (F.octet_length(t) + 16).cast("long"), "_crc": F.crc32(t).cast("long"), "_old": F.coalesce(F.expr(old_shard).cast("int"), F.lit(-1)) if old_shard else F.lit(0)}
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    whole = docs.withColumns(key).drop("shard", "slot")
    whole = whole.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(*columns))))
    rows = placed.select(F.col(id_col).alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), (F.col("old_shard") if old_shard else F.lit(0)).alias("_old"), "shard", "slot")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("shard", "slot"))).join(touched, "shard", "left_semi")
    same = [whole[c].eqNullSafe(rows[c]) for c in (*key, "_n")]
    full = materialize(whole.join(rows, same).select(*[whole[c] for c in columns], rows["shard"], rows["slot"]), "rewritten")
    ordered = full.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    left = touched.join(placed.select("shard").distinct(), "shard", "left_anti").collect()  # at most a row an old shard
    for r in left:
        for name in (str(r["shard"]), *(["__HIVE_DEFAULT_PARTITION__"] if r["shard"] == -1 else [])):
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={name}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
