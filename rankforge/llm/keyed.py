"""Chunks of documents that look up 64-bit keys of the whole corpus.

A chunk is a bounded run of documents in one task. It sends each distinct key once, packed by bucket (a range of
keys); a bucket combines what the chunks sent and answers each of them in the order of its keys. So a key that a
third of all rows hold comes once from a chunk, and no task ever gets all rows of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: UTF-8 bytes of text in a chunk; one document may have more.
CHUNK_BYTES = 4_000_000
#: UTF-8 bytes of text for each bucket of keys.
BUCKET_BYTES = 8_000_000


def bucket_bits(docs: DataFrame, text: str) -> int:
    """log2 of the number of buckets, in proportion to the input."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(5, int(np.ceil(np.log2(max(1, total / BUCKET_BYTES)))))


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[int | None], list[str]]]:
    """(chunk, ids, texts) of a task's rows (id, text) in their order; numbers are unique over all tasks."""
    number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            t = t or ""
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= limit:
                yield number, ids, texts
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield number, ids, texts


def token_hashes(texts: list[str], end: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the lower-cased words of all texts in a row (after each text that of ``end``), and words a text."""
    flat: list[bytes] = []
    lens = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        w = words_of(t)
        if end is not None:
            w.append(end)
        lens[k] = len(w)
        flat += w
    if not flat:
        return np.zeros(0, np.uint64), lens
    codes, seen = pd.factorize(np.array(flat, object))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in seen), np.uint64, len(seen))[codes], lens


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key of two."""
    with np.errstate(over="ignore"):
        z = a * np.uint64(0x9E3779B97F4A7C15) + b
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return z ^ (z >> np.uint64(32))


def bucket_slices(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The non-empty buckets of sorted keys."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    edges = [0, *cuts.tolist(), len(keys)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield int(bucket[a]), slice(a, b)
