"""Shortest-pack-first packing over the length histogram.

Documents are tokenised and cut into pieces of at most ``size`` tokens. Only the histogram of piece lengths (at most
``size`` numbers) reaches the driver, which places lengths longest first into the shortest open pack that holds them
and keeps counts of packing patterns. The patterns are joined back to the pieces by rank within their length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

END_ID = 0
#: Encoded stretches of text that a worker keeps.
CACHE = 300_000
#: Fixed value: how byte-level vocabularies of this kind split a text before merging.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_UNCLEAN = re.compile(r" \s|\s |^ | $")
_CLEAN_CUT = re.compile(r"(?<=\S)(?= \S)")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class StretchTokenizer:
    """Ids of whole texts, as little-endian 32-bit bytes, through a cache of space-separated stretches.

    The vocabulary's pattern never lets a pre-token cross a single space between two other characters, so a
    text's ids are those of its stretches in a row. An unseen stretch is encoded by rank merges over the
    vocabulary file, whose ids are in merge order; a stretch that holds a special token's text goes to the
    library that the file is for. Both give the same ids; the merges take a quarter of the time.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.library, self.seen = Tokenizer.from_file(path), {}
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, sorted(special)))) if special else None
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in special}
        self.merge = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, stretch: str) -> list[int]:
        if self.special and self.special.search(stretch):
            return self.library.encode(stretch, add_special_tokens=False).ids
        return self.merge(stretch)

    def stretches(self, text: str) -> list[str]:
        if _UNCLEAN.search(text):
            return _CLEAN_CUT.split(text)
        return text.replace(" ", "\0 ").split("\0") if "\0" not in text else _CLEAN_CUT.split(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.stretches(t) if t else [] for t in texts]
        seen = self.seen
        new = list({s for c in cut for s in c if s not in seen})
        if len(seen) + len(new) > CACHE:
            seen = self.seen = {}
            new = list({s for c in cut for s in c})
        for s in new:
            seen[s] = array("I", self.ids(s)).tobytes()
        return [b"".join([seen[s] for s in c]) for c in cut]


def tokenize_pieces(docs: DataFrame, path: str, size: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, salt) of each piece; a null text is empty and still ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok, salt, end = StretchTokenizer(path), (TaskContext.get().partitionId() * 7919) % (1 << 20), END_ID.to_bytes(4, "little")
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                cols: list[list[int | None]] = [[] for _ in names]
                for doc, ids in zip(b.column(0).to_pylist(), tok.encode(b.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, size):
                        piece = ids[4 * start : 4 * (start + size)]
                        salt = (salt + 1) % (1 << 20)
                        for c, v in zip(cols, (doc, start, len(piece) // 4, zlib.crc32(piece), n, salt), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of each packing pattern; every pack's lengths sum to at most ``size``."""
    open_by_total: dict[int, list[tuple[int, list[int]]]] = {}
    done: list[tuple[int, list[int]]] = []

    def put(count: int, pattern: list[int], total: int) -> None:
        (done.append((count, pattern)) if total == size else open_by_total.setdefault(total, []).append((count, pattern)))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            total = min(open_by_total, default=size)
            if total + length > size:
                take, pattern, total = left, [], 0
            else:
                have, pattern = open_by_total[total].pop()
                if not open_by_total[total]:
                    del open_by_total[total]
                take = min(have, left)
                if have > take:
                    put(have - take, pattern, total)
            if not pattern and 2 * length <= size and take > 1:
                fit = size // length  # equal lengths fill packs of their own before another is opened
                packs, rest = divmod(take, fit)
                if packs:
                    put(packs, [length] * fit, length * fit)
                if rest:
                    put(1, [length] * rest, length * rest)
            else:
                put(take, [*pattern, length], total + length)
            left -= take
    return done + [x for total in sorted(open_by_total) for x in open_by_total[total]]


def placement(patterns: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Of each length, rows (first rank, first sequence, offset) in order of rank; ranks of a row's run map one to one to its sequences."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    base = 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            first = rank.get(length, 0)
            rows.setdefault(length, []).append((first, base, offset))
            rank[length] = first + count
            offset += length
        base += count
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 1024, id_col: str = "doc_id", text: str = "text", bucket_rows: int = 100_000) -> DataFrame:
    """Pieces with (sequence_id, offset): offsets of a sequence leave no gap and end at ``size`` at most.

    Repeated rows are packed as often as they come, a null id stays null, an empty table gives no rows. Ranks are
    counted in salted buckets of a length, so that the many pieces of ``size`` tokens don't meet in one task.
    """
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, size, id_col, text), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = placement(shortest_pack_first(counts, size))
    buckets = max(1, -(-sum(counts.values()) // bucket_rows))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("salt"), F.lit(buckets)))
    sums = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    sums = sums.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "salt"))
    ranked = pieces.withColumn("within", within).join(sums, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("within") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at, rows = np.flatnonzero(length == k), table[int(k)]
                hit = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                seq[at], off[at] = hit[:, 1] + rank[at] - hit[:, 0], hit[:, 2]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(5)], pa.array(seq), pa.array(off)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
