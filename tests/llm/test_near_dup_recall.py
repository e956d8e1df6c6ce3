"""The pipeline's near-duplicate stage against the exact similarity of all pairs, and hot groups of op10 and op5."""

import random
from collections import defaultdict
from itertools import combinations

import corpus_pipeline
from rankforge.llm import simhash, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _families(rng):
    """Texts of 60 to 300 words in families of one to six edits, a few of them many times; all words are drawn alike."""
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(260):
        base = rng.choices(vocabulary, k=rng.randrange(60, 300))
        texts.append(base)
        for _ in range(rng.randrange(1, 6)):
            new = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 28))):
                at = rng.randrange(len(new))
                new[at : at + rng.choice([0, 1, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1, 1])
            texts.append(new)
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def _similar(texts, least=0.8):
    """Pairs of that Jaccard similarity of their five-word shingles, by an index of shingles."""
    shingles = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    holders = defaultdict(list)
    for k, s in enumerate(shingles):
        for x in s:
            holders[x].append(k)
    shared = defaultdict(int)
    for ks in holders.values():
        for pair in combinations(ks, 2):
            shared[pair] += 1
    return {p: j for p, n in shared.items() if (j := n / (len(shingles[p[0]]) + len(shingles[p[1]]) - n)) >= least}


def test_near_duplicates_are_found_and_nothing_else(spark):
    texts = _families(random.Random(17))
    pairs = _similar(texts)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, **corpus_pipeline.SIMHASH, min_similarity=corpus_pipeline.SIMILARITY).collect()}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert all(root(k) == root(c) for k, c in found.items())  # whoever is joined is linked by pairs of that similarity
    close = [p for p, j in pairs.items() if j < 0.85]
    hit = lambda ps: sum(found[a] == found[b] for a, b in ps) / len(ps)
    assert len(pairs) > 400 and len(close) > 50
    print("recall", hit(list(pairs)), "of pairs under 0.85", hit(close), len(pairs), len(close))
    assert hit(list(pairs)) >= 0.95 and hit(close) >= 0.9


def test_a_fingerprint_of_most_rows(spark):
    rows = [(k, "the same words again and again") for k in range(2500)] + [(None, "the same words again and again"), (9999, "quite other words than those before"), (None, None), (10000, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got if r["doc_id"] is not None and r["doc_id"] < 2500} == {0}
    assert {r["doc_id"]: r["component_id"] for r in got if (r["doc_id"] or 0) > 2500} == {9999: 9999, 10000: 10000}
    assert sum(r["component_id"] is None for r in got) == 2


def test_a_url_of_most_rows_and_rows_without_a_host(spark):
    link = '<link rel="canonical" href="https://bad.net/fr/x">'
    rows = [(k, "https://a.org/p", link) for k in range(300)] + [(k, None if k % 2 else "no url", link) for k in range(300, 400)] + [(400, "https://a.org/q", "")]
    got = {r["page_id"]: (r["verdict"], r["inherited"]) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), urls.EXAMPLE_RULES).collect()}
    assert len(got) == 401 and {got[k] for k in range(300)} == {("block", True)} and {got[k] for k in range(300, 401)} == {("allow", False)}


def test_many_near_copies_make_few_edges(spark):
    """A group of near copies makes an edge for each group of tables and fingerprint at most, and all of it is linked."""
    rng, base = random.Random(3), random.Random(4).getrandbits(256)
    fps = {base ^ (1 << rng.randrange(256)) ^ (1 << rng.randrange(256)) for _ in range(1500)} | {rng.getrandbits(256) for _ in range(500)}
    rows = spark.createDataFrame([(k, x.to_bytes(32, "big")) for k, x in enumerate(sorted(fps))], "id long, fp binary")
    groups = simhash.plan_groups(len(fps), 256, 50, 0.94)[0]
    edges = simhash.link_fingerprints(rows, len(fps), 56, 4, (50, 0.94), 4).collect()
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    near = [k for k, x in enumerate(sorted(fps)) if (x ^ base).bit_count() <= 2]
    assert len({root(k) for k in near}) == 1 and len(edges) <= groups * len(near)
    assert all((sorted(fps)[a] ^ sorted(fps)[b]).bit_count() <= 56 for a, b in edges)
