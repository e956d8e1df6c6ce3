"""Phrases that stick together, mined from a sample and its negative border (Toivonen), closed by exact passes.

A phrase can be frequent only if the phrases without its first and without its last word are. So a sample proposes
phrases, and a pass over all texts counts exactly the proposed ones and their negative border: phrases that occur, aren't
proposed, and have both of these parts proposed. A border phrase that turns out to be frequent is a failure of the sample: it is
proposed too, and a further pass counts what the border gained. When a pass has no failure, every frequent phrase has been
counted, whatever the sample held: the sample decides how many passes there are, never the result. A further pass follows
what a failure brings to every length at once, so nothing is left to be counted after it.

Proposals are only tested for membership, by hash in a bit table of a bounded size, so a false member costs a count that
nobody needed and loses nothing. Counts are grouped by the phrases themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_table, drop_tables, made, materialize, salted_join
from .keyed import mix

#: UTF-8 bytes of text that are counted together in a task.
CHUNK_BYTES = 4_000_000
#: Words of a sampled window.
WINDOW = 64
#: Bits of the largest membership table (16 MB, whatever the input).
MAX_BITS = 1 << 27
_MARK = b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\x0a\x0b\x0c\x0d" + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")


@dataclass(frozen=True)
class Members:
    """Hashes by one bit each; a set of more of them is never smaller than its parts."""

    words: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & np.uint64(len(self.words) * 64 - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, pieces ended by a mark. A long text comes in several slices, each cut at the end of a piece."""
    flat, start = text.translate(_TABLE), 0
    while start < len(flat):
        end = flat.find(b"\n", start + CHUNK_BYTES) if len(flat) - start > CHUNK_BYTES else -1
        part = flat[start : end if end >= 0 else len(flat)]
        yield [*part.replace(b"\n", b" " + _MARK + b" ").split(), _MARK]
        start = end + 1 if end >= 0 else len(flat)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words and marks) of a bounded run of a task's texts."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for words in _slices(text.as_py() or b""):
                held.setdefault(lang, []).extend(words)
                size += 6 * len(words)
                if size >= CHUNK_BYTES:
                    yield from held.items()
                    held, size = {}, 0
    yield from held.items()


def _levels(lang: str, words: list[bytes], longest: int, keep: Members | None, old: Members | None):
    """For lengths 1, 2, ... (length, phrases, hashes, counts, proposed?) of a run of words.

    Counted are phrases whose two parts ``keep`` holds. With ``old``, what was proposed in the pass before, those that it counted are
    left out, and parts that are new in this pass will do as well: so what a failure brings is followed to any length at once.
    """
    codes, seen = pd.factorize(np.array(words, object))
    mark = int(np.flatnonzero(seen == _MARK)[0])
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), np.uint64, len(seen))
    text = pa.array(seen, pa.binary())
    n = len(codes)
    at = np.flatnonzero(codes != mark)
    uniq, first, ids, counts = np.unique(codes[at], return_index=True, return_inverse=True, return_counts=True)
    keys = mix(np.full(len(uniq), xxhash.xxh64_intdigest(lang.encode("utf-8", "replace")), np.uint64), hashes[uniq])
    phrases = text.take(pa.array(uniq))
    new = np.full(len(uniq), old is None)
    for length in range(1, longest + 1):
        inside = keep.has(keys) if keep else np.ones(len(keys), bool)
        alive = inside | new if old else inside
        before = old.has(keys) & ~new if old else np.zeros(len(keys), bool)  # proposed and reached there
        yield length, phrases.filter(pa.array(new)), keys[new], counts[new], inside[new]
        if length == longest or not len(at):
            return
        # places where this phrase and the one a word further on may both be frequent
        slot = np.full(n + 1, -1, np.int64)
        good = alive[ids]
        slot[at[good]] = ids[good]
        at = at[good]
        at = at[slot[at + 1] >= 0]
        head, tail, word = slot[at], slot[at + 1], codes[np.minimum(at + length, n - 1)].astype(np.int64)
        uniq, first, ids, counts = np.unique(head * len(seen) + word, return_index=True, return_inverse=True, return_counts=True)
        keys = mix(keys[head[first]], hashes[word[first]])
        phrases = pc.binary_join_element_wise(phrases.take(pa.array(head[first])), text.take(pa.array(word[first])), b" ")
        new = ~(before[head[first]] & before[tail[first]]) if old else np.ones(len(uniq), bool)


def _sample_keys(texts: DataFrame, longest: int, least: int, share: float) -> DataFrame:
    """Hashes of the phrases that ``least`` or more windows' words of a sample hold. Windows are drawn, as a phrase may have all its places in one text."""

    def run(batches):
        draw = np.random.default_rng(TaskContext.get().partitionId())
        for lang, every in _by_language(batches):
            kept = np.flatnonzero(draw.random(len(every) // WINDOW + 1) < share) * WINDOW
            words = [w for k in kept.tolist() for w in (*every[k : k + WINDOW], _MARK)] or [_MARK]
            for _, _, keys, counts, _ in _levels(lang, words, longest, None, None):
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["key", "n"])

    return texts.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")


def _count(texts: DataFrame, longest: int, least: int, keep: Members, old: Members | None) -> DataFrame:
    """(lang, m, phrase, proposed, a) of counted phrases of ``least`` or more; m = 0 has the number of all words of a language."""
    sc = texts.sparkSession.sparkContext
    sent = sc.broadcast((keep, old))

    def run(batches):
        keep, old = sent.value
        for lang, words in _by_language(batches):
            for length, phrases, _, counts, inside in _levels(lang, words, longest, keep, old):
                if length == 1 and old is None:
                    phrases, counts, inside = pa.concat_arrays([phrases, pa.array([b""], pa.binary())]), np.append(counts, counts.sum()), np.append(inside, True)
                if len(counts):
                    tails = pa.array([b"\t-" + lang.encode("utf-8", "replace"), b"\t+" + lang.encode("utf-8", "replace")], pa.binary())
                    keys = pc.binary_join_element_wise(phrases, tails.take(pa.array(inside.astype(np.int8))), b"")
                    yield pa.record_batch([pc.cast(keys, pa.string(), safe=False), pa.array(counts, pa.int64())], ["key", "a"])

    # narrow rows, as there are many: a phrase has no tab, so one ends it. A chunk has counted its phrases, so grouping them once
    # more before the exchange would only take memory.
    rows = texts.mapInArrow(run, "key string, a bigint").repartition("key").groupBy("key").agg(F.sum("a").alias("a"))
    phrase, tail = F.substring_index("key", "\t", 1), F.expr("substring(key, instr(key, '\t') + 1)")
    words = F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1)
    often = rows.where((F.col("a") >= least) | (phrase == ""))
    return often.select(F.substr(tail, F.lit(2)).alias("lang"), words.alias("m"), phrase.alias("phrase"), tail.startswith("+").alias("proposed"), "a")


def _hash_phrases(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            keys = np.zeros(b.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True)):
                key = np.array([xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"))], np.uint64)
                for w in phrase.split(b" "):
                    key = mix(key, np.array([xxhash.xxh64_intdigest(w)], np.uint64))
                keys[i] = key[0]
            yield pa.record_batch([pa.array(keys.view(np.int64))], ["key"])

    return rows.select("lang", "phrase").mapInArrow(run, "key bigint")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, sample_share: float = 0.125, sample_least: int | None = None, lang: str = "lang", text: str = "text", passes: list[int] | None = None) -> DataFrame:
    """(lang, m, phrase, a) of every phrase of 1 to ``longest`` words that occurs ``least`` times or more in its language.

    A further row a language, with m = 0 and an empty phrase, has the number of its words. Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?``
    and line ends, pieces into words at blanks and tabs; occurrences overlap, but don't cross pieces. A null text is empty, a null
    language ``und``; no rows for an empty table; rows of repeated ids count each; other columns are ignored.
    A long text is counted in slices that end where a piece does. ``sample_least`` is the count that makes a phrase of the sample a
    proposal, half of what ``least`` would come to there if none is given. ``passes`` takes the number of failures of each pass.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    spark = docs.sparkSession
    began = len(made)
    proposed = materialize(_sample_keys(texts, longest, sample_least or max(2, int(least * sample_share / 2)), sample_share), "proposed")
    bits = min(MAX_BITS, max(1 << 16, 1 << (32 * max(1, proposed.count()) - 1).bit_length()))
    keep, old, found = Members(bit_table(proposed, bits)), None, None
    drop_tables(spark, made[began:])
    for expand in (False, True):
        counted = materialize(_count(texts, longest, least, keep, old), "phrases")
        found = counted if found is None else found.unionByName(counted)
        failed = counted.where("NOT proposed AND m > 0")
        n = failed.count()
        if passes is not None:
            passes.append(n)
        if not n or expand:  # the second pass counted all that its own failures bring: closed
            break
        old, keep = keep, Members(keep.words | bit_table(_hash_phrases(failed), bits))
    return found.drop("proposed")


def score_phrases(phrases: DataFrame, cover_percent: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of two words or more that no longer one covers. Takes what ``frequent_phrases`` returns.

    The score is the least over all cuts of floor(1000 a n / (l r)), l and r the counts of what lies before and behind the cut,
    ties to the first cut. A phrase goes if a longer frequent one holds it and has ``cover_percent`` of its count.
    Numbers are decimals of 38 digits, so products up to that are exact.
    """
    key = lambda lang, part: F.concat(F.length(lang).cast("string"), F.lit(":"), lang, part)
    many = phrases.where("m > 1").withColumn("w", F.split("phrase", " "))
    cut = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(True).alias("left"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("part")),
        F.struct(k.alias("k"), F.lit(False).alias("left"), F.array_join(F.slice("w", k + 1, F.col("m") - k), " ").alias("part")),
    ))))
    asked = many.select("lang", "phrase", "a", cut.alias("c")).select("lang", "phrase", "a", "c.k", "c.left", key(F.col("lang"), F.col("c.part")).alias("key"))
    rows = many.agg(F.sum(2 * (F.col("m") - 1))).first()[0] or 0
    parts = phrases.where("m > 0").select(key(F.col("lang"), F.col("phrase")).alias("key"), F.col("a").alias("f"))
    parts = parts.join(asked.groupBy("key").agg(F.count("*").alias("times")), "key")
    told = salted_join(asked, parts, "key", "times", "phrase", rows)
    sides = told.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    totals = phrases.where("m = 0").select("lang", F.col("a").alias("n")).join(sides.groupBy("lang").agg(F.count("*").alias("times")), "lang")
    sides = salted_join(sides, totals, "lang", "times", "phrase", rows)
    d = lambda c: F.col(c).cast("decimal(38,0)")
    sides = sides.withColumn("p", F.lit(1000).cast("decimal(38,0)") * d("a") * d("n")).withColumn("q", d("l") * d("r"))
    best = sides.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("p div q").alias("score"), "k", "l", "r")).alias("b"))
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("m") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " ")))))
    held = many.where("m > 2").select("lang", inner.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a")))
    return kept.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def top_phrases(scored: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` of each language by score, count and phrase (bytes). Hash parts of a language are cut first, so no task gets them all."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return few.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000, **sample) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language that hold together most. See ``frequent_phrases`` and ``score_phrases``."""
    return top_phrases(score_phrases(frequent_phrases(docs, least, longest, **sample)), most)
