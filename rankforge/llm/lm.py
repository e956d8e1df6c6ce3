"""Language-model scores by a weighted backoff automaton.

Every n-gram of the training texts shorter than ``order`` is a state, the empty one is the root. A state h that was seen
n times has for each token w seen after it an arc to the longest state that ends (h, w), of weight
(c + mu p) / (n + mu): c counts of (h, w), p the weight of w from the state without h's oldest token. A failure arc
leads to that shorter state and has weight mu / (n + mu). The root has an arc for every token, of add-one weight. A text is
read once from left to right: the state carries the longest known history, a token without an arc takes failure arcs
until one has it, and log-probabilities add up.

Counts of all orders come from the whole corpus through keyed chunks. Each chunk of documents gets the counts of its own
n-grams, builds the part of the automaton that its texts can reach, and walks it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .keyed import bucket_bits, bucket_slices, chunks, mix, token_hashes

#: No word, since words hold no space.
END, START = b" end", np.uint64(0x5374617274)
#: Weight of the lower order, in counts, of states of one, two and three tokens. The likelihood of held-out texts is flat
#: in the last from 0.25 to 1; the smaller, the more a text that occurs twice differs from one that occurs once.
MUS = (300.0, 100.0, 0.3)
#: UTF-8 bytes of text in a chunk; bits of a key below those of its bucket.
CHUNK_BYTES, KEY_BITS = 8_000_000, 40


@dataclass
class Grams:
    """The n-grams that end at each token, n = 1..order: keys[n - 1], and whether the text is long enough (live[n - 1])."""

    keys: list[np.ndarray]
    live: list[np.ndarray]
    lens: np.ndarray
    first: np.ndarray


def grams_of(texts: list[str], order: int, bits: int) -> Grams:
    """Keys of ``bits + KEY_BITS`` leading bits; a text's first token has a start sign before it and nothing before that."""
    tok, lens = token_hashes(texts, END)
    first = np.cumsum(lens) - lens
    at = np.arange(len(tok)) - np.repeat(first, lens)
    keys, live = [tok], [np.ones(len(tok), bool)]
    for n in range(2, order + 1):
        before = np.empty(len(tok), np.uint64)
        before[1:] = keys[-1][:-1]
        before[first] = START
        keys.append(mix(before, tok))
        live.append(at >= n - 2)
    keep = np.uint64((2**64 - 1) ^ ((1 << max(0, 64 - bits - KEY_BITS)) - 1))
    return Grams([k & keep for k in keys], live, lens, first)


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes as the largest needs."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if int(a.max(initial=0)) < 256 ** int(k[2]))
    return zlib.compress(a.astype(kind).tobytes(), 1) + kind[2].encode()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b[:-1]), f"<u{b[-1:].decode()}").astype(np.int64)


def _sent(keys: np.ndarray, bits: int) -> bytes:
    """Sorted keys of one bucket as steps; mostly four bytes a key."""
    part = (keys << np.uint64(bits)) >> np.uint64(64 - KEY_BITS)
    step = np.diff(part, prepend=np.uint64(0))
    wide = int(step.max(initial=0)) >= 1 << 32
    return step.astype("<u8" if wide else "<u4").tobytes() + (b"8" if wide else b"4")


def _received(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b[:-1], f"<u{b[-1:].decode()}").astype(np.uint64))


def held_out_flags(ids: list[int | None], modulus: int, rest: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % modulus == rest for i in ids], bool)


def united(walked: np.ndarray, base: np.ndarray, share: float) -> np.ndarray:
    """log10 of the probability of either part, ``share`` being that of the root alone."""
    if not share:
        return walked
    return np.logaddexp((walked + np.log10(1 - share)) * np.log(10), (base + np.log10(share)) * np.log(10)) / np.log(10)


class Automaton:
    """The states and arcs that a chunk's texts can reach.

    ``number[n][i]`` is the row of the n-gram that ends at token i in the tables of order n (the start sign is row -1 of order 1):
    ``arc[n]`` log-weights of the arcs that spell it (nan: no such arc), ``failure[n]`` log-weights of the failure arcs
    of the states they name (nan: no such state). The failure arc of row number[n][i] leads to row number[n - 1][i].
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], numbers: list[np.ndarray], starts: int, tokens: int, types: int, mus: Sequence[float]) -> None:
        self.grams, self.number, self.order = grams, [None, *numbers], len(counts)
        root = (counts[0] + 1) / (tokens + types + 1)
        weight, self.arc, self.failure = [None, root], [None, np.log10(root)], [None]
        size = len(grams.keys[0])
        before, self.opens = np.arange(size) - 1, np.zeros(size, bool)
        self.opens[grams.first] = True
        for n in range(1, self.order):
            c = np.append(counts[n - 1], starts) if n == 1 else counts[n - 1]
            with np.errstate(divide="ignore"):
                self.failure.append(np.where(c > 0, np.log10(mus[n - 1] / (c + mus[n - 1])), np.nan))
            # one token of each n-gram of order n + 1 tells the rows of its history and of its lower order
            at, live = np.zeros(len(counts[n]), np.int64), grams.live[n]
            at[numbers[n][live]] = np.flatnonzero(live)
            history = np.where(grams.live[n - 1][before[at]] | (n == 1), numbers[n - 1][before[at]], 0)
            if n == 1:
                history = np.where(self.opens[at], -1, history)
            p = (counts[n] + mus[n - 1] * weight[n][numbers[n - 1][at]]) / (c[history] + mus[n - 1])
            weight.append(p)
            self.arc.append(np.where(counts[n] > 0, np.log10(p), np.nan))
        self.known = counts[0] > 0
        self.starts = starts

    def walk(self) -> np.ndarray:
        """Log-probability of each token, from left to right.

        The state before a token is named by its length: the longest n-gram shorter than ``order`` that ends at the token before
        and is a state. Since every part of a state is a state, that is the state in which the arcs so far end. Shortened keys may
        give an unseen n-gram the count of another; where its history or its shorter part was not seen it is neither arc nor state.
        """
        g = self.grams
        size = len(g.keys[0])
        arcs = [None, self.arc[1][self.number[1]]]  # the root has an arc for each token
        held, reach = np.where(self.known[self.number[1]], 1, 0), np.ones(size, np.int64)
        state = np.empty(size, np.int64)
        for n in range(2, self.order + 1):
            live = g.live[n - 1]
            arcs.append(np.full(size, np.nan))
            arcs[n][live] = self.arc[n][self.number[n][live]]
            state[1:] = held[:-1]
            state[g.first] = int(self.starts > 0)
            has = ~np.isnan(arcs[n]) & (held == n - 1) & (state >= n - 1)
            reach[has] = n
            if n < self.order:
                held[has] = n
        state[1:] = held[:-1]
        state[g.first] = int(self.starts > 0)
        out = np.choose(reach - 1, arcs[1:])
        for n in range(1, self.order):  # failure arcs from the state's length down to where the token has an arc
            falls = np.flatnonzero((state >= n) & (reach <= n))
            row = self.number[n][falls - 1]
            if n == 1:
                row = np.where(self.opens[falls], -1, row)
            out[falls] += self.failure[n][row]
        return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mus: Sequence[float] = MUS, modulus: int = 7, held_out: int = 2, root_share: float = 0.0) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of whole texts, in log10.

    The model has order ``len(mus) + 1`` and learns from rows whose crc32(id as text) mod ``modulus`` is not
    ``held_out``; a null id is in training and keeps its neighbours' ids whole. Null and empty texts are their end token,
    a very long text is a chunk of its own. Repeated rows count and return as often as they come; other columns are not read.
    An empty table gives no rows. With ``root_share`` the model is a union: that share of its weight starts in a root without
    states, which reads the text by add-one weights alone, so no text scores below base_score by more than its logarithm. The rows of ``docs`` must come in the same order when read again (a table, not a shuffle):
    each chunk carries a digest of its rows, and one that differs raises.

    A key that every chunk holds costs its bucket about five bytes a chunk.
    """
    order = len(mus) + 1
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    bits = min(64 - KEY_BITS, bucket_bits(rows, "t"))

    def digest(ids: list[int | None], texts: list[str]) -> int:
        h = xxhash.xxh3_64(repr(ids).encode())
        for t in texts:
            h.update(t.encode("utf-8", "replace"))
            h.update(b"\xff")
        return h.intdigest() >> 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["bucket", "chunk", "n", "keys", "counts"], (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        for number, ids, texts in chunks(batches, CHUNK_BYTES):
            grams = grams_of(texts, order, bits)
            learn = np.repeat(~held_out_flags(ids, modulus, held_out), grams.lens)
            got = [(number % (1 << bits), number, -1, b"", digest(ids, texts).to_bytes(8, "little"))]
            for n, (key, live) in enumerate(zip(grams.keys, grams.live, strict=True)):
                seen, back = np.unique(key[live], return_inverse=True)
                count = np.bincount(back, learn[live], len(seen)).astype(np.int64)
                got += [(b, number, n, _sent(seen[s], bits), _packed(count[s])) for b, s in bucket_slices(seen, bits)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names)

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        out = [(c, -1, b, d, 0, 0) for c, b, d in part.loc[part["n"] < 0, ["chunk", "bucket", "counts"]].itertuples(index=False)]
        for n, own in part[part["n"] >= 0].groupby("n"):
            keys = [_received(k) for k in own["keys"]]
            counts = [_unpacked(c) for c in own["counts"]]
            seen, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(back, np.concatenate(counts), len(seen)).astype(np.int64)
            if n == 0:
                out.append((-1, 0, 0, b"", int(total.sum()), int((total > 0).sum())))
            for chunk, bucket, piece in zip(own["chunk"], own["bucket"], np.split(back, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
                out.append((chunk, n, bucket, _packed(total[piece]), 0, 0))
        return pd.DataFrame(out, columns=["chunk", "n", "bucket", "totals", "tokens", "types"])

    asked = rows.mapInArrow(ask, "bucket int, chunk long, n int, keys binary, counts binary")
    told = materialize(asked.groupBy("bucket").applyInPandas(answer, "chunk long, n int, bucket int, totals binary, tokens long, types long"), "counts")
    sums = told.where("chunk = -1").agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = int(sums[0] or 0), int(sums[1] or 0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts in chunks(batches, CHUNK_BYTES):
            whole = [t.encode("utf-8", "replace") for t in texts]
            some = np.array([i is not None for i in ids], bool)
            got = [number, np.array([i or 0 for i in ids], "<i8").tobytes(), some.tobytes(), np.array([len(t) for t in whole], "<i8").tobytes(), zlib.compress(b"".join(whole), 1)]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(got, (pa.int64(), *[pa.binary()] * 4), strict=True)], ["chunk", "ids", "some", "sizes", "texts"])

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        some, sizes, whole = np.frombuffer(row["some"], bool), np.frombuffer(row["sizes"], "<i8"), zlib.decompress(row["texts"])
        ids = [int(i) if s else None for i, s in zip(np.frombuffer(row["ids"], "<i8"), some, strict=True)]
        ends = np.cumsum(sizes).tolist()
        texts = [whole[e - n : e].decode() for e, n in zip(ends, sizes.tolist(), strict=True)]
        right = right.sort_values(["n", "bucket"])
        if digest(ids, texts) != int.from_bytes(right.iloc[0]["totals"], "little"):
            raise RuntimeError("the documents came in another order when they were read again; write them to a table first")
        grams = grams_of(texts, order, bits)
        counts, numbers = [], []
        for n, (key, live) in enumerate(zip(grams.keys, grams.live, strict=True)):
            seen, back = np.unique(key[live], return_inverse=True)
            number = np.zeros(len(key), np.int64)
            number[live] = back
            counts.append(np.concatenate([np.zeros(0, np.int64), *[_unpacked(x) for x in right.loc[right["n"] == n, "totals"]]]))
            numbers.append(number)
        last = grams.first + grams.lens - 1
        made = Automaton(grams, counts, numbers, int(counts[0][numbers[0][last[0]]]), tokens, types, mus)  # as many starts as ends
        add = lambda x: np.add.reduceat(x, grams.first)
        base = made.arc[1][numbers[0]]
        return pd.DataFrame({"id": pd.array(ids, "Int64"), "held_out": held_out_flags(ids, modulus, held_out), "n_tokens": grams.lens, "n_known": add(made.known[numbers[0]].astype(np.int64)), "train_tokens": tokens, "base_score": add(base), "score": united(add(made.walk()), add(base), root_share)})

    dealt = rows.mapInArrow(deal, "chunk long, ids binary, some binary, sizes binary, texts binary")
    out = dealt.groupBy("chunk").cogroup(told.where("chunk >= 0").groupBy("chunk")).applyInPandas(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
