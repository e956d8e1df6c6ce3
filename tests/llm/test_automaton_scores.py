"""Scores of texts that the training texts say little about."""

import numpy as np

from rankforge.llm import lm


def test_an_ngram_with_the_count_of_another_leaves_scores_finite():
    grams = lm.grams_of(["a b c d e f", "c d a f e b"], 4, 5)
    counts, numbers = [], []
    for n, (key, live) in enumerate(zip(grams.keys, grams.live, strict=True)):
        seen, back = np.unique(key[live], return_inverse=True)
        number = np.zeros(len(key), np.int64)
        number[live] = back
        # words were seen, longer n-grams were not; every other one of three tokens shares its key with one that was
        counts.append(np.full(len(seen), int(n == 0)) if n != 2 else np.arange(len(seen)) % 2)
        numbers.append(number)
    for starts in (0, 2):
        got = lm.Automaton(grams, counts, numbers, starts, 14, 7, lm.MUS).walk()
        assert np.isfinite(got).all() and (got < 0).all()


def test_no_held_out_text_scores_far_below_its_base(spark):
    # "|" is in every training text, before ever other words; 1301 is held out (crc32("1301") % 7 = 2)
    rows = [(k, " | ".join(f"w{(7 * k + j) % 500}" for j in range(40))) for k in range(100) if k != 1301]
    rows.append((1301, " | ".join(f"w{j * 13 % 500}" for j in range(400))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    walked, got = ({r["doc_id"]: r for r in lm.score_texts(docs, root_share=s).collect()} for s in (0.0, 0.5))
    assert got[1301]["held_out"] and walked[1301]["score"] < got[1301]["base_score"] - 10
    for k, r in got.items():
        low, high = sorted((walked[k]["score"], r["base_score"]))
        assert high - 0.302 < r["score"] <= high and (r["score"] > low or high - low < 0.61)
