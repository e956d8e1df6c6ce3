"""Phrase mining against a brute-force count."""

import random
import re
from collections import Counter, defaultdict

import pytest

from rankforge.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows, longest):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    return f, n


def brute(rows, least, longest, most):
    f, n = counts(rows, longest)
    often = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    out = defaultdict(list)
    for (lang, p), a in often.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (x, q), b in often.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right, n[lang]))
    return {(lang, i + 1, p.decode(), -a, left, right, total, -s) for lang, v in out.items() for i, (s, a, p, left, right, total) in enumerate(sorted(v)[:most])}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    w = [f"w{chr(97 + k)}" for k in range(26)] + ["Über", "日本", "A-b", "x\x85y"]
    out = []
    for k in range(60):
        t = [rng.choice(w[: rng.choice([4, 10, 30])]) for _ in range(rng.randrange(0, 60))]
        out.append((rng.choice(["en", "de", None, "und", ""]), "".join(x + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", " ! "]) for x in t)))
    out += [("en", None), (None, ""), ("en", " .\n,\t"), ("en", "one"), ("fr", "the of " * 300), ("fr", "Echo " * 40 + "Zug zug"), ("en", "Hold on tight. " * 9)]
    return out + out[5:9]


@pytest.mark.parametrize("least,share,sample_least,most", [(3, 0.5, 2, 2000), (2, 0.3, 4, 7), (5, 0.0, None, 2000), (4, 1.0, 1, 3)])
def test_phrases(spark, rows, least, share, sample_least, most):
    docs = spark.createDataFrame([(i if i % 3 else None, *r, 1, "x") for i, r in enumerate(rows)], "doc_id bigint, lang string, text string, n int, phrase string").repartition(4)
    got = [tuple(r) for r in collocations.collocations(docs, least, 5, most, sample_share=share, sample_least=sample_least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least, 5, most)


def test_the_sample_decides_the_passes_only(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string")
    f, n = counts(rows, 3)
    want = {(lang, len(p), " ".join(p), a) for (lang, p), a in f.items() if a >= 4} | {(lang, 0, "", a) for lang, a in n.items() if a}
    for share, first in ((0.0, None), (1.0, 0)):
        passes = []
        got = {tuple(r) for r in collocations.frequent_phrases(docs, 4, 3, share, 1, passes=passes).select("lang", "m", "phrase", "a").collect() if r["m"] or r["a"]}
        assert got == want
        assert passes[0] > 0 if first is None else passes == [first]


def test_products_beyond_64_bits(spark):
    a, l, r, n = 3 * 10**9, 4 * 10**9 + 7, 5 * 10**9 + 1, 10**13 + 3
    rows = [("en", 0, "", n), ("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)]
    got = collocations.score_phrases(spark.createDataFrame(rows, "lang string, m int, phrase string, a bigint")).collect()
    assert [tuple(x) for x in got] == [("en", "x y", a, l, r, n, 1000 * a * n // (l * r))]


def test_long_texts_come_in_slices(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 20)
    text = b"one two three. four five six seven eight nine ten, eleven\n\ntwelve " * 3
    whole = [w for part in collocations._slices(text) for w in part]
    drop = lambda words: [p.split() for p in b" ".join(words).split(b"\xff") if p.strip()]
    assert len(list(collocations._slices(text))) > 3
    assert drop(whole) == drop(text.replace(b".", b" \xff ").replace(b",", b" \xff ").replace(b"\n", b" \xff ").split())


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, lang string, text string")
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(none.unionByName(spark.sql("SELECT 1L AS doc_id, CAST(NULL AS STRING) AS lang, CAST(NULL AS STRING) AS text"))).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
