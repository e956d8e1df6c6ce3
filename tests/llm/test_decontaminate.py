"""Benchmark matches against a brute-force search."""

import random
import re

import numpy as np
import pytest

from rankforge.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(text, items, window):
    w = words(text)
    matches = set()
    for item, t in items:
        v = words(t)
        least = min(window, len(v))
        for i in range(len(v)):
            for p in range(len(w)):
                if v[i] != w[p] or (i and p and v[i - 1] == w[p - 1]):
                    continue
                n = 0
                while i + n < len(v) and p + n < len(w) and v[i + n] == w[p + n]:
                    n += 1
                if n >= least:
                    matches.add(("" if item is None else str(item), i, p, n))
    hit = {p + k for _, _, p, n in matches for k in range(n)}
    return len(w), len(hit), sorted({m[0] for m in matches}), matches


@pytest.fixture(scope="module")
def data():
    rng = random.Random(8)
    v = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(v, k=rng.choice([1, 2, 3, 7, 12, 40])))) for k in range(14)]
    items += [(20, None), (21, " .,"), (22, "Straße, 日本 x"), (3, "again w1 w2 w3 w4"), (None, "no id here at all"), (23, items[5][1]), (24, items[5][1] + " w0")]
    texts = [" ".join(rng.choices(v, k=rng.randrange(0, 60))) for _ in range(25)]
    texts += [None, "", "--", "q " * 3000 + (items[4][1] or "") + " q" * 10, "STRASSE straße日本 x", "a straße 日本 X! no ID here at-all", items[9][1] + "." + items[9][1], "again W1_w2 w3 w4"]
    return [(k if k % 5 else None, t) for k, t in enumerate(texts + texts[:2])], items


@pytest.mark.parametrize("window,block_bytes,blocks_a_pass", [(4, 10**6, 16), (4, 60, 2), (10, 100, 100), (2, 10**6, 1), (1, 200, 3)])
def test_matches(spark, data, window, block_bytes, blocks_a_pass):
    rows, items = data
    docs = spark.createDataFrame([(i, k, t, 1, "m") for i, (k, t) in enumerate(rows)], "i int, doc_id bigint, text string, n_words int, matches string").repartition(3)
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id bigint, text string, word string")
    got = dc.with_digest(dc.benchmark_matches(docs, bench, ["i", "matches"], window, block_bytes=block_bytes, blocks_a_pass=blocks_a_pass)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, ids, matches = brute(rows[r["row"]["i"]][1], items, window)
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (n, hit, ids, hit > 0)
        assert {tuple(m) for m in r["matches"]} == matches and r["row"]["matches"] == "m"
    clean = dc.decontaminate(docs, bench, window=window)
    assert clean.columns == docs.columns
    assert sorted(r["i"] for r in clean.collect()) == [i for i, (_, t) in enumerate(rows) if not brute(t, items, window)[1]]


def test_items_in_pieces(monkeypatch):
    monkeypatch.setattr(dc, "PIECE_WORDS", 1)
    rng = random.Random(1)
    item = [f"a{rng.randrange(50)}".encode() for _ in range(200)]
    pieces = [("x", f, 200, item[f : f + 8 + 3]) for f in range(0, 197, 8)]
    block = dc.Block(pieces, 4)
    text = [b"z"] * 5 + item[30:90] + [b"z"]
    codes = np.array([block.number.get(w, 0) for w in text] + [0], np.int32)
    place, _, length = dc.search(codes, block, 8)
    assert {p + k for p, n in zip(place, length, strict=True) for k in range(n)} == set(range(5, 65))


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    codes = np.concatenate([rng.integers(0, 4, 500), np.zeros(9, int)]).astype(np.int32)
    order = dc.suffix_array(codes, np.flatnonzero(codes), 8)
    until = lambda p: tuple(codes[p : p + 8][: (list(codes[p : p + 8]) + [0]).index(0)])
    keys = [until(p) for p in order]
    assert keys == sorted(keys)


def test_empty_tables(spark, data):
    rows, items = data
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert dc.with_digest(dc.benchmark_matches(docs, bench.limit(0), ["doc_id"])).where("contaminated OR n_hit > 0").count() == 0
    assert dc.benchmark_matches(docs.limit(0), bench, ["doc_id"]).collect() == []
    assert dc.decontaminate(docs, bench.limit(0)).count() == len(rows)
