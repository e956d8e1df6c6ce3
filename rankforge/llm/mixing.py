"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic). The cells are raked to the three marginals in turn until all are
met; none may get more tokens than it has, so that documents can be sampled by their cell's calibrated probability and
the sample meets the marginals. A table of few cells is raked on the driver; one of more than ``max_cells`` is raked
by the same steps as a table of Spark, and never reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import WORD, drop_tables, made, materialize

#: Topics and a pattern of their telling words; fixed values of the example queries, a parameter everywhere else.
TOPICS = {"code": r"[{}();=]{2,}|\bdef\b|\bfunction\b", "table": r"\|", "contact": r"@[a-z0-9.-]+\.[a-z]{2,}|https?://", "legal": r"(?i)\blicen[sc]e\b|\bcopyright\b"}
OTHER = "other"


def topic_of(text: Column, topics: Mapping[str, str] = TOPICS) -> Column:
    """The topic with most matches in the whole text, the first named on a tie, ``other`` without a match or text."""
    hits = [F.struct(F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, p) in enumerate(topics.items())]
    best = F.greatest(*hits) if len(hits) > 1 else hits[0]
    return F.when(best["n"] > 0, best["name"]).otherwise(OTHER)


def rake(counts: np.ndarray, codes: list[np.ndarray], wants: list[np.ndarray], tolerance: float = 1e-9, rounds: int = 1000) -> np.ndarray:
    """Tokens to take of each cell, ``counts`` at most, such that each category of each dimension gets what it wants.

    A category that has too much is scaled down; one that has too little scales up its cells that are not used up.
    Wants that contradict each other end after ``rounds`` with the last dimension met as far as the counts allow.
    """
    mass, total = counts.astype(float).copy(), max(float(wants[0].sum()), 1.0) if wants else 1.0
    for _ in range(rounds):
        worst = 0.0
        for code, want in zip(codes, wants, strict=True):
            full = mass >= counts
            now, used = np.bincount(code, mass, len(want)), np.bincount(code, mass * full, len(want))
            down = np.divide(want, now, out=np.ones_like(want), where=now > 0)
            up = np.divide(want - used, now - used, out=np.ones_like(want), where=now - used > 0)
            low = now < want
            factor = np.where(low[code], np.where(full, 1.0, up[code]), down[code])
            worst = max(worst, float(np.abs(now - want).max(initial=0)) / total)
            mass = np.minimum(mass * factor, counts)
        if worst < tolerance:
            break
    return mass


def affordable(share: np.ndarray, totals: np.ndarray, budget: float) -> np.ndarray:
    """Tokens of each category: its share of the budget, but no more than it has; the others share what that leaves."""
    want = np.zeros_like(share)
    free = np.ones(len(share), bool)
    while True:
        left = budget - want[~free].sum()
        want[free] = left * share[free] / max(share[free].sum(), 1e-300)
        short = free & (want > totals)
        if not short.any():
            return np.minimum(want, totals)
        want[short] = totals[short]
        free &= ~short


def tempered(totals: np.ndarray, power: float) -> np.ndarray:
    """Shares in proportion to a power of the present tokens (1: as they are, 0: equal)."""
    p = np.where(totals > 0, np.power(np.maximum(totals, 1e-300), power), 0.0)
    return p / p.sum() if p.sum() else p


def target_shares(names: np.ndarray, totals: np.ndarray, target: Mapping[str, float] | float) -> np.ndarray:
    """Shares by category: those named and, for the others, what is left by their tokens; or a power for ``tempered``."""
    if not isinstance(target, Mapping):
        return tempered(totals, float(target))
    named = np.array([target.get(n, np.nan) for n in names], float)
    free = np.isnan(named)
    share = np.where(free, max(0.0, 1 - np.nansum(named)) * totals / max(totals[free].sum(), 1e-300), named)
    return share / max(share.sum(), 1e-300)


def cell_probabilities(rows: list[Row], dims: tuple[str, ...], targets: Mapping[str, Mapping[str, float] | float], keep_share: float) -> list[tuple]:
    """Rows (dims..., probability) of cells with their tokens."""
    if not rows:
        return []
    counts = np.array([float(r["tokens"]) for r in rows])
    codes, wants = [], []
    for d in dims:
        names, code = np.unique(np.array([r[d] for r in rows], object), return_inverse=True)
        totals = np.bincount(code, counts, len(names))
        codes.append(code)
        wants.append(affordable(target_shares(names, totals, targets.get(d, 1.0)), totals, keep_share * counts.sum()))
    return [(*[r[d] for d in dims], float(m / c)) for r, m, c in zip(rows, rake(counts, codes, wants), counts, strict=True)]


def cell_table(cells: DataFrame, dims: tuple[str, ...], targets: Mapping[str, Mapping[str, float] | float], keep_share: float, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """(dims..., probability) like ``cell_probabilities``, by the same steps on tables of Spark, each round written."""
    spark = cells.sparkSession
    budget = keep_share * (cells.agg(F.sum("tokens")).first()[0] or 0)
    wants = []
    for d in dims:
        target = targets.get(d, 1.0)
        sums = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("has"))
        if isinstance(target, Mapping):
            named = F.create_map(*[F.lit(x) for pair in target.items() for x in pair])[F.col(d)] if target else F.lit(None).cast("double")
            sums = sums.withColumn("named", named.cast("double"))
            left = sums.where("named IS NULL").agg(F.sum("has")).first()[0] or 0.0
            sums = sums.withColumn("share", F.coalesce("named", F.lit(max(0.0, 1 - sum(target.values())) / max(left, 1e-300)) * F.col("has"))).drop("named")
        else:
            sums = sums.withColumn("share", F.pow("has", F.lit(float(target))))
        sums = materialize(sums.withColumn("want", F.lit(-1.0)), "wants")
        while True:
            free = F.col("want") < 0
            left = sums.agg(F.sum(F.when(free, 0.0).otherwise(F.col("want"))), F.sum(F.when(free, F.col("share")))).first()
            due = F.lit((budget - left[0]) / max(left[1] or 0.0, 1e-300)) * F.col("share")
            short = free & (due > F.col("has"))
            if not sums.where(short).limit(1).count():
                wants.append(materialize(sums.select(d, F.when(free, due).otherwise(F.col("want")).alias("want")), "wants"))
                break
            sums = materialize(sums.withColumn("want", F.when(short, F.col("has")).otherwise(F.col("want"))), "wants")
    now = materialize(cells.withColumn("mass", F.col("tokens").cast("double")), "cells")
    path = made[-1]
    for _ in range(rounds):
        worst = 0.0
        for d, want in zip(dims, wants, strict=True):
            full = F.col("mass") >= F.col("tokens")
            sums = now.groupBy(d).agg(F.sum("mass").alias("now"), F.sum(F.when(full, F.col("mass")).otherwise(0.0)).alias("used")).join(want, d)
            worst = max(worst, sums.agg(F.max(F.abs(F.col("now") - F.col("want")))).first()[0] or 0.0)
            up = F.when(full | (F.col("now") <= F.col("used")), 1.0).otherwise((F.col("want") - F.col("used")) / (F.col("now") - F.col("used")))
            factor = F.when(F.col("now") < F.col("want"), up).otherwise(F.coalesce(F.col("want") / F.col("now"), F.lit(1.0)))
            now = materialize(now.join(sums, d).withColumn("mass", F.least(F.col("mass") * factor, F.col("tokens").cast("double"))).select(*dims, "tokens", "mass"), "cells")
            drop_tables(spark, [path])
            path = made[-1]
        if worst < tolerance * max(budget, 1.0):
            break
    return now.select(*dims, (F.col("mass") / F.col("tokens")).alias("probability"))


def add_features(docs: DataFrame, text: str = "text", topics: Mapping[str, str] = TOPICS) -> DataFrame:
    """``docs`` with topic and n_tokens (words of the whole text; null: none), in place of columns of these names."""
    kept = docs.select(*[c for c in docs.columns if c not in ("topic", "n_tokens")])
    return kept.withColumns({"topic": topic_of(F.col(text), topics), "n_tokens": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")})


def mix_sources(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float], keep_share: float = 0.5, id_col: str = "doc_id", text: str | None = "text", topics: Mapping[str, str] = TOPICS, seed: int = 17, max_cells: int = 100_000) -> DataFrame:
    """``docs`` (without columns of these names) with topic, n_tokens, weight, probability and selected.

    n_tokens * probability has, of ``keep_share`` of all tokens, each category's target; a category that has less than
    its target is taken whole, and the others of its dimension share the rest. weight: probability / keep_share. With ``text=None``
    the rows have topic and n_tokens already (add_features, written to a table), so that whole texts are scanned once
    and not for the counts and for the result.

    Null sources and languages are categories of their own, named empty. A text without words has no tokens, and the
    probability of its cell, or ``keep_share`` if no document of the cell has any. Selection compares a hash with the
    probability: of the id, so that repeated rows of an id are decided alike and every run decides alike; where the id is
    null, of all columns. An empty table gives no rows; a very long text is one row.
    """
    made_here = ("weight", "probability", "selected", "_source", "_lang")
    rows = docs.select(*[c for c in docs.columns if c not in made_here])
    rows = rows if text is None else add_features(rows, text, topics)
    u = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit(seed), F.col(id_col))).otherwise(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in rows.columns]))
    u = F.pmod(u, F.lit(1 << 40)) / F.lit(float(1 << 40))
    columns = rows.columns
    rows = rows.withColumns({"_source": F.coalesce("source", F.lit("")), "_lang": F.coalesce("lang", F.lit(""))})
    dims = ("_source", "_lang", "topic")
    cells = rows.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    named = {{"source": "_source", "lang": "_lang"}.get(k, k): v for k, v in targets.items()}
    counted = cells.limit(max_cells + 1).collect()
    if len(counted) > max_cells:
        table = cell_table(materialize(cells, "cells"), dims, named, keep_share)
    else:
        found = cell_probabilities(counted, dims, named, keep_share)
        table = F.broadcast(docs.sparkSession.createDataFrame(found, "_source string, _lang string, topic string, probability double"))  # max_cells rows at most
    rows = rows.join(table, list(dims), "left").withColumn("probability", F.coalesce("probability", F.lit(float(keep_share))))
    return rows.select(*columns, (F.col("probability") / F.lit(float(keep_share))).alias("weight"), "probability", (u < F.col("probability")).alias("selected"))
