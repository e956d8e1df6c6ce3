"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a reject predicate over a text, its words and its lines, and computes what it needs itself. On a bounded
sample every rule is timed and its verdicts are recorded; the cascade takes next the rule that rejects most of the rows
that the rules before it leave, per second. A row stops at its first rejection, so what later rules would count is
never computed for it. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, let

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: What lies between words.
SPACES = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Parts:
    """What rules read: the whole text, its words, its lines that hold a word, and the counts of the base."""

    text: Column
    words: Column
    lines: Column
    base: Column


@dataclass(frozen=True)
class Rule:
    """reject: the rows to reject, from a text's Parts."""

    name: str
    reject: Callable[[Parts], Column]


def _share(hits: Column, of: Column, percent: int) -> Column:
    return 100 * hits > percent * of


#: Shares in whole numbers, so that every engine agrees.
DEFAULT_RULES = (
    Rule("symbols", lambda p: _share(p.base["n_symbols"], p.base["n_words"], 10)),
    Rule("word_length", lambda p: (p.base["word_chars"] < 2 * p.base["n_words"]) | (p.base["word_chars"] > 14 * p.base["n_words"])),
    Rule("dup_lines", lambda p: (F.size(p.lines) >= 4) & _share(p.base["n_dup_lines"], F.size(p.lines), 40)),
    Rule("bullets", lambda p: (F.size(p.lines) >= 5) & _share(F.size(F.filter(p.lines, lambda x: x.rlike(r"^[ \t]*[-*•]"))), F.size(p.lines), 90)),
    Rule("ellipses", lambda p: (F.size(p.lines) >= 5) & _share(F.size(F.filter(p.lines, lambda x: x.rlike(r"(\.\.\.|…)[ \t\r]*$"))), F.size(p.lines), 50)),
    Rule("stutter", lambda p: _share(F.size(F.filter(p.words, lambda x, i: x.eqNullSafe(F.get(p.words, i - 1)))), p.base["n_words"], 30)),
    Rule("few_letters", lambda p: 2 * F.length(F.regexp_replace(p.text, r"\P{L}+", "")) < p.base["word_chars"]),
)


def _repeat_words(w: Column) -> Column:
    """Words of the array in windows that occur twice; the common case of no such window ends at a set of hashes."""

    def of_hashes(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(by_hash, of_sorted))

    def of_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(F.slice(w, i + 1, WINDOW)))
    return F.when(F.size(w) > WINDOW, let(hashes, of_hashes))


def _base(t: Column, w: Column, lines: Column) -> Column:
    """The counts that the base and the output need of every row."""
    return F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(_repeat_words(w), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _judged(text: Column, use: Callable[[Parts], Column]) -> Column:
    """``use`` of the parts of a text, each computed once; a null text is empty."""
    t = F.coalesce(text, F.lit(""))
    words, lines = F.array_remove(F.split(t, SPACES, -1), ""), F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    return let(words, lambda w: let(lines, lambda x: let(_base(t, w, x), lambda b: use(Parts(t, w, x, b)))))


def _base_failed(b: Column) -> Column:
    return (b["n_words"] < 20) | (100 * b["n_repeat_words"] > 30 * b["n_words"])


def greedy_order(costs: Sequence[float], hits: Sequence[tuple[tuple[bool, ...], int]]) -> list[int]:
    """Numbers of the rules, each next one with most rejections of what is left per cost; hits: (verdicts of the rules, rows)."""
    left, order = list(hits), []
    while len(order) < len(costs):
        free = [k for k in range(len(costs)) if k not in order]
        best = max(free, key=lambda k: (sum(n for v, n in left if v[k]) / costs[k], -costs[k], -k))
        order.append(best)
        left = [(v, n) for v, n in left if not v[best]]
    return order


def plan_cascade(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = DEFAULT_RULES, sample_rows: int = 500, repeats: int = 5) -> list[Rule]:
    """The rules by rejection per cost, from at most ``sample_rows`` texts.

    A twentieth of the rows is read until there are enough (the first rows where the table is too small for that), so
    a few partitions are read however many there are. A rule's cost is the time of judging the sample with it alone
    less that of a comparison, each run once to compile and then timed; a clock that sees no difference gives a floor.
    """
    rules, spark = list(rules), docs.sparkSession
    texts = docs.select(F.col(text).alias("t")).where(F.col(text).isNotNull())
    sample = texts.sample(0.05, seed=1).take(sample_rows) if len(rules) > 1 else []
    if len(rules) > 1 and len(sample) < sample_rows:
        sample = texts.take(sample_rows)
    if len(rules) < 2 or not sample:
        return rules
    parts = lambda p: F.struct(p.text.alias("t"), p.words.alias("w"), p.lines.alias("l"), p.base.alias("b"))
    held = spark.createDataFrame(sample, "t string").coalesce(1).select(_judged(F.col("t"), parts).alias("p")).select("p.*").cache()
    own = Parts(*[F.col(c) for c in "twlb"])
    flags = [F.coalesce(r.reject(own), F.lit(False)) for r in rules]
    hits = [(tuple(r["v"]), r["count"]) for r in held.where(~_base_failed(own.base)).groupBy(F.array(*flags).alias("v")).count().collect()]

    def seconds(flag: Column) -> float:
        took = []
        for _ in range(2):  # a frame of its own each: one that ran keeps its shuffle
            run = held.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).agg(F.count_if(flag))
            began = time.perf_counter()
            run.collect()
            took.append(time.perf_counter() - began)
        return took[-1]

    idle = seconds(own.base["n_words"] < 0)
    costs = [max(seconds(f) - idle, 1e-3) / repeats for f in flags]
    held.unpersist()
    return [rules[k] for k in greedy_order(costs, hits)]


def cascade(rules: Sequence[Rule], p: Parts) -> Column:
    """Name of the first rule that rejects the row, else null; CASE stops at the first hit."""
    out = None
    for r in rules:
        hit = r.reject(p)
        out = F.when(hit, r.name) if out is None else out.when(hit, r.name)
    return F.lit(None).cast("string") if out is None else out


def judge_quality(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = DEFAULT_RULES, sample_rows: int = 500) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by and kept.

    n_repeat_words: words inside 8-word windows that occur twice or more in the text, the first occurrence included;
    windows are compared by 64-bit hashes within one text. rejected_by: ``base``, or the rule of the cascade that hit
    first. Null and empty texts have no words and fail the base. Everything stays in the row: repeated rows repeat, a
    very long text is one row, and no key is shuffled. Columns of ``docs`` named like a result are replaced by it.
    An empty table gives no rows.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept", "_q"} - {text}
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    ordered = plan_cascade(docs, text, rules, sample_rows)
    verdict = lambda p: F.struct(p.base.alias("b"), F.when(_base_failed(p.base), "base").otherwise(cascade(ordered, p)).alias("by"))
    q = docs.select(*kept, _judged(F.col(f"`{text}`"), verdict).alias("_q"))
    counts = [F.col(f"_q.b.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return q.select(*kept, *counts, F.col("_q.by").eqNullSafe("base").alias("base_failed"), F.col("_q.by").alias("rejected_by"), F.col("_q.by").isNull().alias("kept"))
