"""Nearest neighbours by randomly rotated one-bit codes.

Every row is coded once: it is rotated by a seeded random orthogonal matrix and kept as its signs (one bit a dimension),
its norm, and the product of the rotated unit vector with its code. From these a query's inner product is estimated
with an error bound. Rows lie in partition lists around centroids that are fitted on a bounded sample. A query first meets
the lists whose centroids suit it best, which gives its k-th best product so far; then only the lists whose radius lets
them hold a better one. In a list only the rows whose upper bound reaches that product are computed exactly. Lists are
pruned by true bounds, so only the code's error bound can lose a neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SEED = 7
#: Width of the error bound in standard deviations of the estimate.
EPSILON = 3.0
#: Rows that centroids are fitted on, at most; the greatest number of lists; rows for which there is a list; lists met first.
SAMPLE_ROWS, MOST_LISTS, LIST_ROWS, FIRST_LISTS = 16_384, 1024, 4096, 2


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norms, and products of unit vectors with their codes."""
    norm = np.linalg.norm(x, axis=1)
    turned = (x / norm[:, None]) @ rotation(x.shape[1])
    return np.packbits(turned >= 0, axis=1), norm, np.abs(turned).sum(1) / np.sqrt(x.shape[1])


def upper_bounds(q: np.ndarray, bits: np.ndarray, norm: np.ndarray, fit: np.ndarray, epsilon: float = EPSILON) -> np.ndarray:
    """Of each query (row) and coded vector (column): the estimated inner product and its error bound, added up."""
    d = q.shape[1]
    code = np.unpackbits(bits, axis=1, count=d).astype(np.float32)
    turned = (q @ rotation(d)).astype(np.float32)
    signed = 2 * (turned @ code.T) - turned.sum(1, keepdims=True)
    slack = epsilon * np.sqrt(np.maximum(1 - fit**2, 0) / fit**2 / max(d - 1, 1)) + 1e-4
    length = np.linalg.norm(q, axis=1).astype(np.float32)[:, None]
    return signed * (norm / fit / np.sqrt(d)).astype(np.float32) + length * (slack * norm).astype(np.float32)


def search_block(qid: np.ndarray, q: np.ndarray, least: np.ndarray, vid: np.ndarray, v: np.ndarray, codes: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, epsilon: float = EPSILON) -> list[tuple[int, int, float]]:
    """(query, row, product) of each query's nearest k of the block that reach ``least`` (minus infinity: not known yet)."""
    upper = upper_bounds(q, *codes, epsilon)
    upper[qid[:, None] == vid[None, :]] = -np.inf
    out = []
    for i in range(len(qid)):
        floor, first = least[i], np.zeros(0, np.int64)
        if floor == -np.inf and len(vid) > k:
            first = np.argpartition(-upper[i], k - 1)[:k]
            first = first[np.isfinite(upper[i][first])]
            if len(first) == k:
                floor = np.einsum("ij,j->i", v[first], q[i]).min()
        near = np.flatnonzero((upper[i] >= floor) & (upper[i] > -np.inf))
        score = np.einsum("ij,j->i", v[near], q[i])
        best = np.lexsort((vid[near], -score))[:k]
        out += [(int(qid[i]), int(vid[near[j]]), float(score[j])) for j in best if score[j] >= floor]
    return out


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids of the sample by Lloyd's rounds; an empty one stays where it was."""
    rng = np.random.default_rng(SEED)
    c = sample[np.sort(rng.choice(len(sample), lists, replace=False))].copy()
    for _ in range(rounds if lists > 1 else 1):
        near = assign(sample, c)
        n = np.bincount(near, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def assign(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)


def _stack(col: pd.Series, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(b"".join(col), kind).reshape(len(col), -1)


def nearest(vectors: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", query_block: int = 1024, row_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product in double precision, ties to the smaller id.

    is_query: SQL predicate that states the query set; a query's candidates are the other ids' vectors of its length.
    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do null ids. Repeated rows of
    one id are candidates each, and a repeated query is one. Other columns are not read; an empty table gives no rows.
    Lists and queries are dealt in blocks of bounded size; a length of vectors costs a pass of its own.
    """
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(F.expr(is_query), F.lit(False)).alias("is_query"))
    lengths = sorted(rows.groupBy(F.size("v").alias("d")).count().collect())  # a row a length
    found = None
    for d, n in lengths:
        part = _nearest_of_length(rows.where(F.size("v") == d) if len(lengths) > 1 else rows, n, k, query_block, row_block)
        found = part if found is None else found.union(part)
    return found if found is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest_of_length(rows: DataFrame, n: int, k: int, query_block: int, row_block: int) -> DataFrame:
    lists = max(1, min(MOST_LISTS, n // LIST_ROWS))
    share = min(1.0, 2 * SAMPLE_ROWS / n)
    sample = rows.select("id", "v") if share == 1 else rows.select("id", "v").where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = np.array([r["v"] for r in sample.limit(SAMPLE_ROWS).collect()]) if lists > 1 else np.zeros((1, 1))  # SAMPLE_ROWS at most
    centroids = fit_centroids(sample, lists) if lists > 1 else None

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                bits, norm, fit = encode(x)
                near = np.zeros(len(x), np.int64) if centroids is None else assign(x, centroids)
                far = np.zeros(len(x)) if centroids is None else np.linalg.norm(x - centroids[near], axis=1)
                raw = [pa.array([y.tobytes() for y in z], pa.binary()) for z in (x.astype("<f8"), bits)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(near.astype(np.int32)), pa.array(far), *raw, pa.array(norm), pa.array(fit)], ["id", "is_query", "list", "far", "v", "bits", "norm", "fit"])

    coded = materialize(rows.mapInArrow(code, "id long, is_query boolean, list int, far double, v binary, bits binary, norm double, fit double"), "codes")
    sizes = {r["list"]: (r["n"], r["far"]) for r in coded.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row a list
    used = np.array(sorted(sizes))
    radius = np.array([sizes[i][1] for i in used.tolist()])
    blocks = {i: max(1, -(-sizes[i][0] // row_block)) for i in used.tolist()}
    asked = coded.where("is_query").dropDuplicates(["id"]).select("id", "v")
    asked = materialize(asked, "asked")

    def visits(first: bool):
        """Of each query the (list, block) numbers to meet: the best lists, or the others that may reach ``least``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                q = np.frombuffer(b"".join(b.column(1).to_pylist()), "<f8").reshape(b.num_rows, -1)
                likely = np.zeros((len(q), 1)) if centroids is None else q @ centroids[used].T
                order = np.argsort(-likely, axis=1, kind="stable")
                meet = np.zeros(likely.shape, bool)
                np.put_along_axis(meet, order[:, :FIRST_LISTS], True, axis=1)
                if not first:
                    least = b.column(2).to_numpy(zero_copy_only=False)
                    meet = ~meet & (likely + np.linalg.norm(q, axis=1)[:, None] * radius >= least[:, None])
                i, j = np.nonzero(meet)
                spread = [(x, int(used[y]), z) for x, y in zip(i.tolist(), j.tolist(), strict=True) for z in range(blocks[int(used[y])])]
                take = pa.array([s[0] for s in spread], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array([s[1] for s in spread], pa.int32()), pa.array([s[2] for s in spread], pa.int32())], ["id", "v", "least", "list", "vb"])

        return run

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            codes = _stack(right["bits"], "u1"), right["norm"].to_numpy(), right["fit"].to_numpy()
            found = search_block(left["id"].to_numpy(), _stack(left["v"]), left["least"].to_numpy(), right["id"].to_numpy(), _stack(right["v"]), codes, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    def of_list(number: dict[int, int]):
        return F.create_map(*[F.lit(x) for i in used.tolist() for x in (i, number.get(i, 0))])[F.col("list")]

    dealt = coded.select("id", "list", F.pmod(F.xxhash64("id", "v"), of_list(blocks)).cast("int").alias("vb"), "v", "bits", "norm", "fit")
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def search(queries: DataFrame, first: bool) -> DataFrame:
        sent = queries.select("id", "v", "least").mapInArrow(visits(first), "id long, v binary, least double, list int, vb int")
        asks = {r["list"]: r["count"] for r in sent.where("vb = 0").groupBy("list").count().collect()}  # a row a list
        parts = {i: -(-asks.get(i, 0) // query_block) for i in used.tolist()}  # a list's rows are sent once for each part of its queries
        sent = sent.withColumn("qb", F.pmod(F.xxhash64("id"), of_list(parts)).cast("int"))
        rows = dealt.withColumn("qb", F.explode(F.when(of_list(parts) > 0, F.sequence(F.lit(0), of_list(parts) - 1))))
        keys = ["qb", "list", "vb"]
        got = sent.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
        return got.withColumn("rank", top).where(F.col("rank") <= k)

    if not len(used):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    near = materialize(search(asked.withColumn("least", F.lit(float("-inf")).cast("double")), True), "first")
    if lists <= FIRST_LISTS:
        return near.select("query_id", "rank", "vec_id", "score")
    known = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    left = asked.join(known, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")).cast("double")))
    both = near.select("query_id", "vec_id", "score").union(search(left, False).select("query_id", "vec_id", "score"))
    return both.withColumn("rank", top).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
