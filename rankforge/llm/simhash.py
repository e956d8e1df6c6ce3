"""SimHash near-duplicates: fingerprints, bit tables for candidates, pivot distance tables, verification, components.

Candidates come from tables of bit positions. For a small ``max_distance`` the tables are those of the pigeonhole
principle (some blocks of the fingerprint must be equal), so no link is lost. For larger ones they are seeded random
positions, with the recall that ``table_recall`` gives. Distances to the pivots are computed once for each distinct
fingerprint and travel with it. Pairs in a bucket lie in order of the first coordinate, so only those in a window of it meet; by
the triangle inequality a pair of which any coordinate differs by more than ``max_distance`` is discarded, which
leaves next to no unlike pair of 64 bits, and the survivors are verified by their full distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, salted_join, words_of

SEED = 42
#: Reference fingerprints. Two unlike 64-bit fingerprints are within 4 of each other in one coordinate with a chance of 0.57,
#: in all 32 with one of 1e-8.
PIVOTS = 32
#: Buckets above this many fingerprints are dealt out as pairs of sub-blocks of half the size.
HOT_BUCKET = 4096
#: Sampled tables that share some bits, and unlike fingerprints that have those equal: such a group is sent once for all its tables.
TABLES, GROUP = 16, 4096


def _mix(h: np.ndarray, j: int) -> np.ndarray:
    """Further hash words from the first (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * j) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hash of each run of ``shingle`` words; of all words if there are fewer, none without words."""
    found = words_of(text)
    if not found:
        return np.zeros(0, np.uint64)
    flat = b" ".join(found)
    if len(found) < shingle:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingle hashes, sorted and distinct; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def fingerprint(text: str | None, shingle: int, words: int = 1) -> bytes:
    """Big-endian SimHash of 64 * words bits; a bit is 1 if set in over half the shingle hashes."""
    h = shingle_hashes(text, shingle)
    if not len(h):
        return bytes(8 * words)
    out = []
    for j in range(words):
        w = h if not j else _mix(h, j)
        ones = np.zeros(64, np.int64)
        for k in range(0, len(w), 1 << 15):
            ones += np.unpackbits(w[k : k + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(w)).tobytes())
    return b"".join(out)


def add_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """(id, fp binary) of whole texts; null and empty texts have the zero fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, fp binary")


def _add_digests(rows: DataFrame, shingle: int, words: int) -> DataFrame:
    """(id, fp, sig) of (id, t): with the fingerprint a 128-bit digest of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            fps = [fingerprint(t, shingle, words) for t in texts]
            sigs = [xxhash.xxh3_128_digest(b" ".join(words_of(t)), SEED) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], ["id", "fp", "sig"])

    return rows.mapInArrow(run, "id long, fp binary, sig binary")


def bit_tables(bits: int, max_distance: int, sampled: int = 0, width: int = 16) -> list[tuple[int, ...]]:
    """Bit positions of each table: pigeonhole blocks, or ``sampled`` seeded random sets of ``width`` positions."""
    if sampled:
        rng = np.random.default_rng(SEED)
        return [tuple(sorted(rng.choice(bits, width, replace=False).tolist())) for _ in range(sampled)]
    blocks = np.array_split(np.arange(bits), max_distance + 2)
    return [tuple(int(x) for b in pair for x in b) for pair in combinations(blocks, 2)]


def plan_tables(n: int, bits: int, distance: int, recall: float, rows: int = 16, least: int = 14) -> tuple[int, int]:
    """(tables, width) for ``n`` fingerprints: buckets of about ``rows`` unlike ones, and as many tables as give
    a pair at ``distance`` that chance of a shared bucket. Width grows with log n, tables as a small power of n."""
    width = max(least, int(np.ceil(np.log2(max(1, n / rows)))))
    hit = float(np.prod([(bits - distance - i) / (bits - i) for i in range(width)]))
    return max(1, int(np.ceil(np.log1p(-recall) / np.log1p(-hit)))), width


def plan_groups(n: int, bits: int, distance: int, recall: float) -> tuple[int, int, int]:
    """(groups of tables, bits that the TABLES of a group share, width) for ``n`` fingerprints, with the width of ``plan_tables``
    and as many groups as give a pair at ``distance`` that chance of a shared bucket."""
    width = plan_tables(n, bits, distance, recall)[1]
    shared = min(width - 1, max(1, int(np.ceil(np.log2(max(1, n / GROUP))))))
    same = [(bits - distance - i) / (bits - i) for i in range(width)]
    hit = float(np.prod(same[:shared]) * (1 - (1 - np.prod(same[shared:])) ** TABLES))
    return max(1, int(np.ceil(np.log1p(-recall) / np.log1p(-hit)))), shared, width


def table_recall(bits: int, distance: int, tables: int, width: int) -> float:
    """Chance that a pair at ``distance`` shares a bucket in at least one sampled table."""
    hit = np.prod([(bits - distance - i) / (bits - i) for i in range(width)])
    return float(1 - (1 - hit) ** tables)


def pivots(words: int, n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    return np.random.default_rng(SEED + 1).integers(0, 2**64, (n, words), dtype=np.uint64, endpoint=False)


def _words_of(col: pa.Array) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 1), np.uint64)
    return np.frombuffer(b"".join(col.to_pylist()), ">u8").astype(np.uint64).reshape(len(col), -1)


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Joins the trees of each a and b; numbers of the pairs that joined two."""
    out = []
    for k, (rx, ry) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while root[rx] != rx:
            rx = root[rx]
        while root[ry] != ry:
            ry = root[ry]
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            out.append(k)
    while True:
        jumped = root[root]
        if (jumped == root).all():
            return out
        root[:] = jumped


def _linked(key: np.ndarray, ids: np.ndarray, fp: np.ndarray, pv: np.ndarray, most: int, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the pairs that share a key and differ in at most ``most`` bits.

    ``root`` has the trees of what other tables have linked and gets those of this one. A bucket that is one tree but for a few rows
    compares those with all others and is done.
    """
    order = np.lexsort((pv[:, 0], key))
    key, ids, fp, pv = key[order], ids[order], fp[order], pv[order].astype(np.int16)
    n = len(ids)
    tree = np.arange(n)
    if root is not None:
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        tree = back[root[order]]  # no cycle, though a root need not be its tree's least row here
    out_a, out_b = [], []

    def meet(a: np.ndarray, b: np.ndarray) -> None:
        ok = (np.abs(pv[a] - pv[b]).max(1) <= most) & (tree[a] != tree[b])
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64) <= most
        if ok.any():
            a, b = a[ok], b[ok]
            new = _join(tree, a, b)
            out_a.append(ids[a[new]])
            out_b.append(ids[b[new]])

    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if n else np.arange(0)
    size = np.diff(np.append(start, n))
    live = np.arange(max(0, n - 1))
    step = 1
    while len(live):
        live = live[live + step < n]
        other = live + step
        near = (key[live] == key[other]) & (pv[other, 0] - pv[live, 0] <= most)
        live, other = live[near], other[near]
        if not len(live):
            break
        meet(live, other)
        step += 1
        if step >= 64 and step & (step - 1) == 0:
            done = np.zeros(n, bool)
            for s, m in zip(start[size > step].tolist(), size[size > step].tolist(), strict=True):
                trees, count = np.unique(tree[s : s + m], return_counts=True)
                few = s + np.flatnonzero(tree[s : s + m] != trees[count.argmax()])
                if len(few) * 16 <= m:
                    for x in few.tolist():
                        meet(np.full(m - 1, x), np.delete(np.arange(s, s + m), x - s))
                    done[s : s + m] = True
            live = live[~done[live]]
    if root is not None:
        root[order] = order[tree]
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(empty + out_a), np.concatenate(empty + out_b)


def link_fingerprints(fps: DataFrame, n: int, max_distance: int, words: int = 1, reach: tuple[int, float] | None = None, n_pivots: int = PIVOTS) -> DataFrame:
    """Edges (src, dst) between the ids of distinct fingerprints, enough to span every group of linked ones.

    fps: (id, fp), one row a fingerprint; n: their number, which sets the partitions. A bucket of over HOT_BUCKET
    fingerprints (4 * GROUP for a group of sampled tables) goes to pairs of sub-blocks in several groups, so no group is unbounded
    and no pair is dropped. A fingerprint is sent once for all tables of a group, and what one of them has linked the others don't link again.
    """
    inner: list[list[np.ndarray]] = []
    if reach:
        n_groups, shared, width = plan_groups(n, 64 * words, *reach)
        rng = np.random.default_rng(SEED)
        spots = [tuple(sorted(rng.choice(64 * words, shared, replace=False).tolist())) for _ in range(n_groups)]
        inner = [[rng.choice(np.setdiff1d(np.arange(64 * words), s), width - shared, replace=False) for _ in range(TABLES)] for s in spots]
    else:
        spots = bit_tables(64 * words, max_distance)
    limit = 4 * GROUP if reach else HOT_BUCKET
    ref = pivots(words, n_pivots)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                fp = _words_of(part.column(1))
                bits = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(len(fp), -1), axis=1)
                pv = np.bitwise_count(fp[:, None, :] ^ ref[None, :, :]).sum(2, dtype=np.int64).clip(0, 255).astype(np.uint8)
                far = [x.tobytes() for x in pv]
                for k, s in enumerate(spots):
                    value = bits[:, s].astype(np.int64) @ (1 << np.arange(len(s), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(value + (k << 40)), part.column(0), part.column(1), pa.array(far, pa.binary())], ["key", "id", "fp", "pv"])

    rows = fps.mapInArrow(keys, "key long, id long, fp binary, pv binary")
    hot = rows.groupBy("key").count().where(F.col("count") > limit).select("key", F.ceil(F.col("count") / (limit // 2)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = rows.join(hot, "key", "left").withColumn("own", own)
    blocks = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: F.least("own", t) * F.col("parts") + F.greatest("own", t)))
    rows = rows.select("key", F.explode(blocks).alias("block"), "id", "fp", "pv")
    parts = max(8, -(-n * len(spots) * max(1, len(inner[0]) if inner else 1) // 400_000))

    def linked(which: np.ndarray, number: np.ndarray, ids: np.ndarray, fp: np.ndarray, pv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of the rows of one number, in all tables of their group ``which``."""
        if not inner:
            return _linked(number, ids, fp, pv, max_distance)
        bits = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(len(fp), -1), axis=1)
        root, out = np.arange(len(ids)), []
        for t in range(TABLES):
            sub = np.zeros(len(ids), np.int64)
            for g in np.unique(which).tolist():
                own = np.flatnonzero(which == g)
                sub[own] = bits[own][:, inner[g][t]].astype(np.int64) @ (1 << np.arange(len(inner[g][t]), dtype=np.int64))
            out.append(_linked((number << 40) + sub, ids, fp, pv, max_distance, root))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []

        def work(held: list[tuple[np.ndarray, ...]], last: bool) -> tuple[pa.RecordBatch, list[tuple[np.ndarray, ...]]]:
            group, block, ids, fp, pv = (np.concatenate(x) for x in zip(*held, strict=True))
            new = np.flatnonzero((group[1:] != group[:-1]) | (block[1:] != block[:-1])) + 1
            cut = len(ids) if last or not len(new) else new[-1]
            if not last and not len(new):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["src", "dst"]), [(group, block, ids, fp, pv)]
            number = np.zeros(len(ids), np.int64)
            number[new] = 1
            a, b = linked(group[:cut] >> 40, np.cumsum(number)[:cut], ids[:cut], fp[:cut], pv[:cut])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"]), [(group[cut:], block[cut:], ids[cut:], fp[cut:], pv[cut:])]

        size = 0
        for b in batches:
            if b.num_rows:
                pv = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                kept.append((b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _words_of(b.column(3)), pv))
                size += b.num_rows
            if size >= 200_000:
                out, kept = work(kept, False)
                size = len(kept[0][2])
                yield out
        if kept and sum(len(x[2]) for x in kept):
            yield work(kept, True)[0]

    return rows.repartition(parts, "key", "block").sortWithinPartitions("key", "block").mapInArrow(link, "src long, dst long")


def similar_groups(nodes: DataFrame, texts: DataFrame, min_similarity: float, shingle: int, max_distance: int, words: int = 1, reach: tuple[int, float] | None = None, n_pivots: int = PIVOTS) -> DataFrame:
    """(node, component) of nodes (id, fp) linked to others: their texts (id, t) have that Jaccard similarity of their shingles or more.

    The spanning edges of the fingerprints are candidates, so copies never make all pairs. Each is verified on the
    whole texts. Nodes that a failed candidate led to are tried again, by the smallest node of what is linked so far,
    until a round links nothing new. A round starts from the components of the one before, not from all links.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            ok = [similarity(*(np.unique(shingle_hashes(t, shingle)) for t in pair)) >= min_similarity for pair in pairs]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["src", "dst", "ok"])

    groups, now = None, nodes
    while True:
        n = now.count()
        pairs = link_fingerprints(now, n, max_distance, words, reach, n_pivots).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        pairs = materialize(pairs, "candidates")
        # each side meets the pairs by itself, so few pairs go to the texts and only texts of pairs are sent
        full = pairs.join(texts.toDF("src", "a"), "src").join(pairs.join(texts.toDF("dst", "b"), "dst"), ["src", "dst"]).select("src", "dst", "a", "b")
        judged = materialize(full.mapInArrow(judge, "src long, dst long, ok boolean"), "judged")
        good, failed = judged.where("ok").select("src", "dst"), judged.where("NOT ok")
        n_good, n_failed = judged.agg(F.count_if("ok"), F.count_if(~F.col("ok"))).first()
        if groups is None or n_good:
            links = good if groups is None else good.union(groups.where("node <> component").select("component", "node"))
            groups = connected_components(links)
        if not n_good or not n_failed:
            return groups
        ends = failed.select("src").union(failed.select("dst")).distinct()
        again = ends.join(groups, ends["src"] == groups["node"], "left").select(F.coalesce("component", "src").alias("id")).distinct()
        now = materialize(nodes.join(again, "id", "left_semi"), "nodes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, max_distance: int = 4, words: int = 1, reach: tuple[int, float] | None = None, n_pivots: int = PIVOTS, min_similarity: float | None = None) -> DataFrame:
    """(id, fingerprint hex, component_id): the smallest id reachable by links of at most ``max_distance`` bits.

    Texts without words have fingerprint zero and link like any other. A null id gets its fingerprint and a null
    component and links nothing. Repeated rows stay repeated. Equal fingerprints are one node, so copies never
    make pairs; an empty table gives no rows. With ``min_similarity`` (ids must then be unique) only texts of that Jaccard
    similarity of their shingles are linked, and equal fingerprints of unlike texts are not. ``reach`` (distance, chance): sampled
    tables that hold a pair at that distance with that chance; without it the tables hold every pair within
    ``max_distance``. Other columns are not read; a very long text is hashed whole.
    """
    if min_similarity is not None:
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
        marked = materialize(_add_digests(rows, shingle, words), "fingerprints")
        nodes = materialize(marked.where("id IS NOT NULL").groupBy("fp", "sig").agg(F.min("id").alias("id")), "nodes")
        groups = similar_groups(nodes.select("id", "fp"), rows, min_similarity, shingle, max_distance, words, reach, n_pivots)
        of = nodes.join(groups, nodes["id"] == groups["node"], "left").select("fp", "sig", F.coalesce("component", "id").alias("component_id"))
        out = marked.join(of, ["fp", "sig"], "left")
        return out.select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    marked = materialize(add_fingerprints(docs, id_col, text, shingle, words), "fingerprints")
    known = marked.where("id IS NOT NULL")
    nodes = materialize(known.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "nodes")
    n, total = nodes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    edges = link_fingerprints(nodes.select("id", "fp"), n, max_distance, words, reach, n_pivots)
    groups = connected_components(edges)
    of = nodes.join(groups, nodes["id"] == groups["node"], "left").select("fp", F.coalesce("component", nodes["id"]).alias("component_id"), "copies")
    # copies of one fingerprint may be a third of all rows
    out = salted_join(known, of, "fp", "copies", "id", total, nodes).unionByName(marked.where("id IS NULL").withColumn("component_id", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
