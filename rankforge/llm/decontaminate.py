"""Benchmark passages in training texts: every suffix of the benchmark is searched in suffix arrays of the training texts.

A task takes its documents in chunks of bounded size (a shard), turns them to words and builds a suffix array. All suffixes of
the benchmark are searched in it by bisection, together, which gives each one its longest verbatim match, its places, and the
documents that hold a window. Nothing is shuffled, and a passage that many documents share costs its places and no pairs.

The benchmark comes in blocks of bounded size, each broadcast by itself; up to ``BLOCKS_A_PASS`` of them are searched in one pass.
Words that a block lacks match nothing, so only runs of its words that could hold a match are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: UTF-8 bytes of training text in a shard; one document may have more.
SHARD_BYTES = 4_000_000
#: UTF-8 bytes of benchmark text in a block, about, and blocks that one pass over the documents searches.
BLOCK_BYTES = 4_000_000
BLOCKS_A_PASS = 16
#: Words of an item that are cut off as one piece; pieces overlap, so no window is lost.
PIECE_WORDS = 20_000

#: A-Z to lower case, anything else of ASCII that isn't a letter or digit to a blank.
_TABLE = bytes(c if c > 0x7F else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Block:
    """The words of some pieces of benchmark items, numbered from 1, and the suffixes at which a window begins.

    pieces: (item id, number of its first word, words of the whole item, words).
    """

    def __init__(self, pieces: list[tuple[str, int, int, list[bytes]]], window: int):
        pieces = [p for p in pieces if p[3]]
        codes, seen = pd.factorize(np.array([w for p in pieces for w in p[3]], object)) if pieces else (np.zeros(0, np.int64), [])
        self.number = {w: k + 1 for k, w in enumerate(seen)}
        sizes = np.array([len(p[3]) for p in pieces], np.int64)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        place = np.arange(len(codes)) - (np.cumsum(sizes) - sizes)[piece]
        wide = np.minimum(np.array([p[2] for p in pieces], np.int64), window)[piece]
        left = sizes[piece] - place
        self.codes = np.zeros(len(codes) + len(pieces) + 1, np.int32)  # a zero behind each piece
        spot = np.arange(len(codes)) + piece
        self.codes[spot] = codes + 1
        ok = left >= wide
        self.at, self.wide, self.piece = spot[ok], wide[ok], piece[ok]
        self.first = place[ok] == 0
        self.word = place[ok] + np.array([p[1] for p in pieces], np.int64)[piece[ok]]
        self.items = [p[0] for p in pieces]
        self.least = int(wide.min(initial=1 << 30))


def suffix_array(codes: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` sorted by the ``depth`` words that begin there (a power of two; a zero ends a text), by doubling the sorted length."""
    rank, length = codes.astype(np.int64), 1
    while length < depth:
        ahead = np.zeros_like(rank)
        ahead[: len(rank) - length] = rank[length:]
        # what begins with a zero stays zero, as nothing is searched there
        pair = np.where(rank > 0, rank * (int(rank.max()) + 1) + ahead, 0)
        rank = np.unique(pair, return_inverse=True)[1]
        length *= 2
    return at[np.argsort(rank[at], kind="stable")]


def _bound(codes: np.ndarray, order: np.ndarray, block: Block, right: bool) -> np.ndarray:
    """For each of the block's suffixes the first place in the order (or, right, that behind the last) whose text begins with its window.

    All suffixes are bisected together.
    """
    low, high = np.zeros(len(block.at), np.int64), np.full(len(block.at), len(order), np.int64)
    going = np.arange(len(low))
    while len(going):
        mid = (low[going] + high[going]) // 2
        there, ours, wide = order[mid], block.at[going], block.wide[going]
        less, same = np.zeros(len(going), bool), np.arange(len(going))
        for d in range(int(wide.max())):
            same = same[wide[same] > d] if d else same
            have, want = codes[there[same] + d], block.codes[ours[same] + d]
            less[same[have < want]] = True
            done = same[(have == want) & (wide[same] == d + 1)]
            less[done] = right
            same = same[have == want]
            if not len(same):
                break
        low[going[less]] = mid[less] + 1
        high[going[~less]] = mid[~less]
        going = going[low[going] < high[going]]
    return low


def search(codes: np.ndarray, block: Block, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, suffix of the block, length) of the longest matches of a shard: they hold a window and can't be continued at either end.

    codes: numbers of the block's words, a zero behind each text and for other words.
    """
    none = np.zeros(0, np.int64)
    # runs of the block's words that could hold a window, a zero behind each
    cut = np.concatenate([[-1], np.flatnonzero(codes == 0)])
    long = np.repeat(np.diff(cut) - 1 >= block.least, np.diff(cut))
    spot = np.flatnonzero(long)
    if not len(spot) or not len(block.at):
        return none, none, none
    run = np.concatenate([codes[spot], np.zeros(depth + 1, np.int32)])
    order = suffix_array(run, np.flatnonzero(run), depth)
    low, high = _bound(run, order, block, False), _bound(run, order, block, True)
    times = high - low
    suffix = np.repeat(np.arange(len(low)), times)
    place = order[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(len(suffix))]
    # a match that its piece has a word earlier, too, is the rest of a longer one
    rest = ~block.first[suffix] & (place > 0) & (run[place - 1] == block.codes[block.at[suffix] - 1])
    suffix, place = suffix[~rest], place[~rest]
    length = block.wide[suffix].copy()
    grows = np.arange(len(suffix))
    while len(grows):
        ours, theirs = block.codes[block.at[suffix[grows]] + length[grows]], run[place[grows] + length[grows]]
        grows = grows[(ours == theirs) & (ours > 0)]
        length[grows] += 1
    return spot[place], suffix, length


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Bounded runs of a task's rows (row, text)."""
    held, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            end = min(b.num_rows, int(np.searchsorted(ends, before + SHARD_BYTES - size)) + 1)
            held.append(b.slice(start, end - start))
            size += int(ends[end - 1] - before)
            start = end
            if size >= SHARD_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


MATCHES = "array<struct<item_id:string,item_word:bigint,word:bigint,length:bigint>>"


def _scan(rows: DataFrame, blocks: list[list[tuple]], window: int) -> DataFrame:
    """(row, n_words, matches) of rows (row, text), searched in each of the blocks."""
    depth = 1 << max(3, (window - 1).bit_length())
    sent = [rows.sparkSession.sparkContext.broadcast(b) for b in blocks]

    def run(batches):
        ready = [Block([(i, f, n, w.split(b" ")) for i, f, n, w in b.value], window) for b in sent]
        for shard in _shards(batches):
            words = [words_of(t.as_py()) for t in shard.column(1)]
            sizes = np.array([len(w) for w in words], np.int64)
            starts = np.cumsum(sizes + 1) - sizes - 1
            found = []
            for block in ready:
                get = block.number.get
                codes = np.fromiter((c for w in words for c in (*(get(x, 0) for x in w), 0)), np.int32, int(sizes.sum()) + len(words))
                place, suffix, length = search(codes, block, depth)
                text = np.searchsorted(starts, place, "right") - 1
                found += zip(text.tolist(), [block.items[p] for p in block.piece[suffix].tolist()], block.word[suffix].tolist(), (place - starts[text]).tolist(), length.tolist(), strict=True)
            matches = [[] for _ in words]
            for t, item, item_word, word, n in found:
                matches[t].append({"item_id": item, "item_word": item_word, "word": word, "length": n})
            kind = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("length", pa.int64())]))
            out = pa.table({"row": shard.column(0), "n_words": pa.array(sizes), "matches": pa.array(matches, kind)})
            yield from out.combine_chunks().to_batches()

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, n_words bigint, matches {MATCHES}")


def _pieces(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item_id, first, n, words): items cut to pieces that overlap by a window less a word."""

    def run(batches):
        for b in batches:
            for item, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = words_of(t.as_py())
                step = max(PIECE_WORDS, 2 * window)
                starts = range(0, max(1, len(w) - window + 1), step)
                rows = [(item, f, len(w), b" ".join(w[f : f + step + window - 1])) for f in starts if w]
                if rows:
                    yield pa.record_batch(list(map(pa.array, zip(*rows, strict=True))), ["item_id", "first", "n", "words"])

    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "item_id string, first bigint, n bigint, words binary")


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, blocks_a_pass: int = BLOCKS_A_PASS) -> DataFrame:
    """(row, n_words, matches) of every row of ``docs``, ``row`` a struct of the columns ``keep``.

    Words are runs of letters and digits (anything beyond ASCII is a letter), A-Z lower-cased. matches: the verbatim matches with
    benchmark items that hold a window (``window`` words, or all of a shorter item) and can't be continued at either end; item_word and word count
    from 0. An item of over PIECE_WORDS words is searched in overlapping pieces, and a match ends where its piece does. A null or wordless text has no words and no
    matches, a null item id is the empty one, items with one id count as one; repeated rows come each; an empty benchmark matches nothing.
    A long text is a shard of its own. The columns of either table may have any names.
    """
    pieces = materialize(_pieces(benchmark, item_id, item_text, window), "benchmark")
    total = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n_blocks = -(-total // block_bytes) or 1
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "first"), F.lit(n_blocks)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text).cast("binary").alias("text"))
    passes = -(-n_blocks // blocks_a_pass)
    if passes > 1:  # each pass sees the same rows by their numbers
        rows = materialize(rows.select(F.struct(F.monotonically_increasing_id().alias("number"), "row").alias("row"), "text"), "numbered")
    out = None
    for first in range(0, n_blocks, blocks_a_pass):
        blocks = [[tuple(r) for r in pieces.where(F.col("block") == k).drop("block").collect()] for k in range(first, min(n_blocks, first + blocks_a_pass))]
        part = _scan(rows, [[(i, f, n, bytes(w)) for i, f, n, w in b] for b in blocks], window)
        out = part if out is None else out.unionByName(part)
    if passes > 1:
        few = materialize(out.select("row.number", "row.row", "n_words", "matches"), "matches")
        out = few.groupBy("number").agg(F.first("row").alias("row"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches")).drop("number")
    return out


def with_digest(found: DataFrame) -> DataFrame:
    """``benchmark_matches`` with n_hit (words inside a match), items (distinct ids, sorted) and contaminated."""
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["word"].alias("a"), (m["word"] + m["length"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    hit = F.aggregate(spans, zero, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).cast("bigint").alias("n"), F.greatest(s["end"], x["b"]).alias("end")), lambda s: s["n"])
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.withColumns({"n_hit": hit, "items": items}).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that share a window with the benchmark. Options are those of ``benchmark_matches``."""
    return benchmark_matches(docs, benchmark, docs.columns, **options).where(F.size("matches") == 0).select("row.*")
