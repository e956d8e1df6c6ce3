"""Training-data operators against brute force, exact round trips and edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankforge.llm import ann, lm, mixing, packing, passages, quality, sharding, simhash, urls
from rankforge.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = {k: " ".join(words(rng, rng.randrange(30, 200))) for k in range(30)}
    out[30] = out[3]
    out[31] = out[3] + " tail"
    out[32], out[33], out[34], out[35] = None, "", "  \n\t ", "One"
    out[36] = "\n".join(["same line here again"] * 9)
    out[37] = " ".join(words(rng, 9) * 12)
    out[38] = " ".join("x#%$" for _ in range(40))
    out[45] = " ".join(w for w in words(rng, 12) for _ in range(5))
    out[39] = "Über straße 日本語 🙂 a  b\n \nc " * 4
    out[40] = " ".join(words(rng, 5000, 400))
    passage = words(rng, 80)
    fuzzy = list(passage)
    for k in (13, 40, 66):
        fuzzy[k] = "changed"
    del fuzzy[30]
    for k, p in ((41, passage), (42, passage), (43, fuzzy)):
        out[k] = " ".join(words(rng, 40) + p + words(rng, 50))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, None if k == 5 else ["en", "de"][k % 2], None if k == 6 else f"s{k % 3}", 0) for k, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_features(docs, texts):
    got = {r["doc_id"]: r for r in quality.judge_quality(docs).collect()}
    for k, t in texts.items():
        w = WORD.findall(t or "")
        win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        held = {i + j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(held))
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert not got[38]["kept"] and not got[45]["kept"] and got[0]["kept"] and not got[32]["kept"]


def test_quality_order_keeps_the_verdict(spark, docs):
    rules = quality.DEFAULT_RULES
    a = {(r["doc_id"], r["kept"]) for r in quality.judge_quality(docs, rules=rules).collect()}
    b = {(r["doc_id"], r["kept"]) for r in quality.judge_quality(docs, rules=rules[::-1], sample_rows=3).collect()}
    assert a == b
    assert sorted(r.name for r in quality.plan_cascade(docs)) == sorted(r.name for r in rules)
    dear = quality.Rule("dear", lambda p: F.size(F.array_distinct(F.transform(p.words, lambda x: F.regexp_replace(x, "(a|b|c)+x?", "")))) < 0)
    cheap = quality.Rule("cheap", lambda p: p.base["n_words"] > 25)
    assert [r.name for r in quality.plan_cascade(docs, rules=[dear, cheap])] == ["cheap", "dear"]
    # the second rule alone rejects less than the third, but what it rejects is left after the first
    assert quality.greedy_order([1, 1, 1], [((True, False, True), 5), ((False, True, False), 3), ((True, False, False), 2)]) == [0, 1, 2]
    assert quality.greedy_order([10, 1], [((True, False), 5), ((False, True), 3)]) == [1, 0]
    body = docs.selectExpr("doc_id", "text AS body", "1 AS text", "2 AS `n_words`").union(docs.selectExpr("doc_id", "text AS body", "1 AS text", "2 AS `n_words`"))
    kept = quality.judge_quality(body, "body").where("kept")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(2 * [k for k, ok in a if ok])
    assert quality.judge_quality(empty(spark)).count() == 0
    clash = docs.selectExpr("*", "1 AS n_words", "'x' AS kept")
    assert quality.judge_quality(clash).where("kept").count() == quality.judge_quality(docs).where("kept").count()


def brute_fp(t, shingle=4):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
    if not w:
        return 0
    s = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_simhash_brute_force(spark, docs, texts):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs.union(docs.where("doc_id < 4"))).collect()}
    fp = {k: brute_fp(t) for k, t in texts.items()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{v:016x}" for k, v in fp.items()}
    linked = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    assert {k: r["component_id"] for k, r in got.items()} == groups_of(fp, linked)
    assert simhash.near_duplicates(empty(spark)).count() == 0
    lone = simhash.near_duplicates(spark.createDataFrame([(None, "a b", "", "", 0)], SCHEMA)).first()
    assert lone["component_id"] is None and lone["fingerprint"]


def test_pipeline_links_by_shingle_similarity(spark):
    import corpus_pipeline

    rng = random.Random(31)
    rows, want = [], set()
    for k, j in enumerate([0.6, 0.65, 0.7, 0.75, 0.79, 0.82, 0.85, 0.9, 0.95] * 3):
        base, same = words(rng, 404, 100000), round(800 * j / (1 + j))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: same + 4] + words(rng, 400 - same, 100000)))]
        want |= {2 * k} | ({2 * k + 1} if j < 0.8 else set())
    rows += [(100, "x " * 300 + " ".join(words(rng, 100, 100000))), (101, "x " * 300 + " ".join(words(rng, 100, 100000)))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    assert want | {100, 101} == kept == {k for k in sets if not any(len(sets[k] & sets[i]) >= 0.8 * len(sets[k] | sets[i]) for i in sets if i < k)}


def test_links_are_whole_in_hot_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)} | {int(x) for x in rng.integers(0, 2**63, 300)}
    chain = [int(rng.integers(0, 2**63))]
    for k in range(40):
        chain.append(chain[-1] ^ (0b111 << (k % 60)))
    fps = sorted(fps | set(chain))
    monkeypatch.setattr(simhash, "HOT_BUCKET", 64)
    rows = spark.createDataFrame([(k, bytearray(f.to_bytes(8, "big"))) for k, f in enumerate(fps)], "id long, fp binary")
    edges = simhash.link_fingerprints(rows, len(fps), 4)
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    a = np.array(fps, np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 4, 1)).tolist()
    want = groups_of(range(len(fps)), near)
    assert {k: got.get(k, k) for k in range(len(fps))} == want
    assert edges.count() <= 15 * len(fps) * 8


def test_bit_tables_lose_no_pair():
    for d in (1, 4):
        tables = [set(t) for t in simhash.bit_tables(64, d)]
        rng = random.Random(1)
        for _ in range(200):
            flips = set(rng.sample(range(64), d))
            assert any(not t & flips for t in tables)
    assert simhash.table_recall(256, 39, 64, 14) > 0.99
    for n in (0, 10**5, 10**7, 10**10):
        tables, width = simhash.plan_tables(n, 256, 50, 0.94)
        assert simhash.table_recall(256, 50, tables, width) >= 0.94 and n / 2**width <= 16
    assert simhash.plan_tables(200_000, 256, 50, 0.94)[0] <= 68


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[1000 + k] == 1000 for k in range(200))
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


VOCABULARY = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_packing_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    size = 64
    got = packing.pack_documents(docs.union(docs.where("doc_id = 7")), VOCABULARY, size, bucket_rows=20).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for k, t in texts.items():
        ids = np.array([*(library.encode(t or "", add_special_tokens=False).ids), 0], "<u4")
        own = sorted(by_doc[k], key=lambda r: r["start"])
        if k == 7:
            assert len(own) == 2 * math.ceil(len(ids) / size)
            continue
        assert [r["start"] for r in own] == list(range(0, len(ids), size))
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert sum(r["length"] for r in got) > 0.9 * size * len(by_seq)
    assert packing.pack_documents(empty(spark), VOCABULARY, size).count() == 0


def test_stretches_give_the_library_ids():
    tok = packing.StretchTokenizer(VOCABULARY)
    odd = ["a  b\n \nc <|endoftext|> d  e  ", " x", "y ", "", "\n", "it's  we'll\t\tz", "a\0 b\0c", "日本語 テスト 🙂 x 🙂🙂", "<|endoftext|>a b<|endoftext|>", "  x  y"]
    want = [tok.library.encode(t, add_special_tokens=False).ids for t in odd]
    assert [np.frombuffer(b, "<u4").tolist() for b in tok.encode(odd)] == want


def test_shortest_pack_first_counts():
    rng = random.Random(2)
    for _ in range(20):
        hist = {rng.randrange(1, 65): rng.randrange(1, 50) for _ in range(rng.randrange(1, 30))}
        patterns = packing.shortest_pack_first(hist, 64)
        held = Counter()
        for n, p in patterns:
            assert sum(p) <= 64 and n > 0
            for x in p:
                held[x] += n
        assert held == Counter(hist)


def test_resharding(docs, spark):
    got = sharding.reshard(docs, "pmod(crc32(source), 4)", 7, block_bytes=2000).collect()
    assert len(got) == docs.count()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(7)) <= largest  # it is longer than a shard's share
    assert sharding.reshard(empty(spark), "0", 3).count() == 0


def test_resharded_sizes_are_near_equal(spark):
    rng = random.Random(12)
    rows = [(k if k % 50 else None, None if k % 97 == 0 else "x" * int(rng.paretovariate(1.1) * 40 % 20000), rng.choice([0, 0, 0, 1, 2, 3, 9])) for k in range(3000)]
    rows += [(7, "same " * 30, 0)] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int").repartition(4)
    got = sharding.reshard(docs.selectExpr("*", "1 AS shard", "2 AS row"), "at", 8, block_bytes=30_000).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["old_shard"]) for r in got) == Counter((k, len(t or "") + 16, zlib.crc32((t or "").encode()), a) for k, t, a in rows)
    sizes, old = Counter(), Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
        old[r["old_shard"]] += r["size"]
    middling = sorted(r["size"] for r in got)[len(got) // 2]
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) < middling
    caps = sharding.equal_capacities(sum(old.values()), 8)
    fewest = sum(v for (i, j), v in sharding.min_cost_transfers(dict(old), caps).items() if i != j)
    moved = sum(r["size"] for r in got if r["shard"] != r["old_shard"])
    assert moved <= fewest + 8 * max(r["size"] for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_fewest_bytes_move():
    rng = random.Random(4)
    for _ in range(20):
        sizes = {k: rng.randrange(0, 100) for k in range(rng.randrange(1, 6))}
        caps = sharding.equal_capacities(sum(sizes.values()), rng.randrange(1, 7))
        moves = sharding.min_cost_transfers(sizes, caps)
        assert all(sum(v for (i, _), v in moves.items() if i == k) == s for k, s in sizes.items())
        assert all(sum(v for (_, j), v in moves.items() if j == k) == c for k, c in caps.items())
        stay = sum(v for (i, j), v in moves.items() if i == j)
        assert stay == sum(min(sizes.get(k, 0), caps.get(k, 0)) for k in caps)


def test_rewrite_touches_only_shards_that_change(spark, docs, tmp_path):
    sized = docs.where("doc_id < 30")
    placed = sharding.reshard(sized, "doc_id % 2", 3, block_bytes=2000)
    touched = {r["shard"] for r in sharding.rewrite_affected(sized, placed, str(tmp_path / "o")).collect()}
    back = spark.read.parquet(str(tmp_path / "o"))
    assert {r["shard"] for r in back.select("shard").distinct().collect()} <= touched
    assert back.count() == placed.where(placed["shard"].isin(*touched)).count()


def test_rewrite_of_the_present_layout(spark, tmp_path):
    path = str(tmp_path / "layout")
    old = [(k, f"{k:03d}" + "x" * 81, 0) for k in range(10)] + [(k, f"{k:03d}" + "y" * 81, 1) for k in range(20, 36)] + [(None, "n" * 84, 2), (None, "m" * 84, 2), (50, "p" * 84, 2), (50, "p" * 84, 2), (50, "q" * 84, 2)] + [(60, "z" * 84, 3)]
    spark.createDataFrame(old, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(path)
    files = lambda n: sorted(p.name for p in (tmp_path / "layout" / f"shard={n}").glob("*.parquet"))
    kept = files(0)
    now = spark.read.parquet(path)
    placed = sharding.reshard(now, "shard", capacities={0: 1000, 1: 1200, 2: 1000})
    touched = {r["shard"] for r in sharding.rewrite_affected(now, placed, path, old_shard="shard").collect()}
    assert 0 not in touched and {1, 2, 3} == touched and files(0) == kept and not files(3)
    spark.catalog.refreshByPath(path)
    back = spark.read.parquet(path)
    want = Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in placed.collect())
    assert Counter((r["doc_id"], zlib.crc32(r["text"].encode()), r["shard"]) for r in back.collect()) == want
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((k, t) for k, t, _ in old)


def test_backoff_automaton(docs, texts):
    got = {r["doc_id"]: r for r in lm.score_texts(docs, mus=(3.0, 2.0)).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    toks = {k: [*WORD.findall((t or "").lower()), None] for k, t in texts.items() if k != 39}
    toks[39] = [*WORD.findall(texts[39].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))), None]
    grams = Counter()
    for k, t in toks.items():
        if not held[k]:
            for i in range(len(t)):
                grams[(t[i],)] += 1
                for n in (2, 3):
                    if i + 2 >= n:
                        grams[tuple((["<s>"] + t)[i + 2 - n : i + 2])] += 1
            grams["<s>"] += 1
    total = sum(c for g, c in grams.items() if g != "<s>" and len(g) == 1)
    types = sum(1 for g in grams if g != "<s>" and len(g) == 1)
    for k, t in toks.items():
        base = score = known = 0
        for i, w in enumerate(t):
            c = grams[(w,)]
            known += c > 0
            p = (c + 1) / (total + types + 1)
            base += math.log10(p)
            hist = ["<s>"] + t[:i]
            for n in (2, 3):
                if len(hist) >= n - 1:
                    h = tuple(hist[len(hist) - n + 1 :])
                    state = grams["<s>"] if h == ("<s>",) else grams[h]
                    p = (grams[(*h, w)] + (5.0 - n) * p) / (state + 5.0 - n)
            score += math.log10(p)
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(t), known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_automaton_edges(spark):
    big = (1 << 60) + 1
    rows = [(big, "a b c d", "", "", 0), (None, "a b c e", "", "", 0), (7, "a b c d " * 400_000, "", "", 0), (8, "x", "", "", 0), (8, "x", "", "", 0)]
    got = lm.score_texts(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "2 AS chunk").coalesce(1)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([big, None, 7, 8, 8])
    long = next(r for r in got if r["doc_id"] == 7)
    assert long["n_tokens"] == 1_600_001 and math.isfinite(long["score"])
    assert lm.score_texts(empty(spark)).count() == 0
    one = lm.score_texts(spark.createDataFrame([(None, None, "", "", 0), (None, "a", "", "", 0)], SCHEMA)).collect()
    assert sorted(r["n_tokens"] for r in one) == [1, 2] and all(r["score"] < 0 for r in one)


@pytest.mark.parametrize('list_rows', [100, 4096])
def test_one_bit_codes_against_brute_force(spark, monkeypatch, list_rows):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((900, 48)).astype(np.float32)
    x[50] = x[51] = x[52]
    x[300:600] = x[300] + 0.05 * x[300:600]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 48), (2002, [None] + [1.0] * 47), (2003, [float("nan")] + [1.0] * 47), (2004, [1.0, 2.0])]
    rows += [(2020, [3.0, 1.0]), (60, x[60].tolist())]
    monkeypatch.setattr(ann, "LIST_ROWS", list_rows)
    table = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, score string")
    got = ann.nearest(table, "vec_id % 20 = 0", 20, row_block=200, query_block=16).collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got if r["query_id"] >= 2000] == [(2020, 2004, 5.0)]
    got = [r for r in got if r["query_id"] < 2000]
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r["query_id"]].append(r)
    y, hits = x.astype(float), 0
    for q in range(0, 900, 20):
        s = y @ y[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s)).tolist()
        want = (want[: want.index(60) + 1] + want[want.index(60) :] if q != 60 else want)[:20]  # row 60 is there twice
        rows = found[q]
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert all(a["score"] >= b["score"] for a, b in zip(rows, rows[1:], strict=False))
        assert all(r["score"] == pytest.approx(s[r["vec_id"]]) for r in rows)
        hits += (Counter(want) & Counter(r["vec_id"] for r in rows)).total()
    assert hits >= 0.99 * 45 * 20
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>"), "vec_id = 0").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in few] == [(0, 1, 0.5)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id = 0").count() == 0


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 100, 60).astype(float)
    codes = [np.arange(60) % 5, np.arange(60) // 5 % 4, np.arange(60) // 20]
    wants = [mixing.affordable(mixing.tempered(np.bincount(c, counts), 0.3), np.bincount(c, counts), 0.9 * counts.sum()) for c in codes]
    mass = mixing.rake(counts, codes, wants)
    assert (mass <= counts).all() and (mass == counts).any()
    for c, t in zip(codes, wants, strict=True):
        assert np.bincount(c, mass) == pytest.approx(t, abs=1e-4)
    assert mixing.affordable(np.array([0.5, 0.25, 0.25]), np.array([10.0, 100, 100]), 100.0).tolist() == [10, 45, 45]


def brute_rake(rows, dims, want, rounds=3000):
    """Plain proportional fitting of tokens by cell (a dict), each cell bounded by what it has."""
    mass = dict(rows)
    for _ in range(rounds):
        for k, wanted in enumerate(want):
            for name, w in wanted.items():
                own = [c for c in rows if c[k] == name]
                for _ in range(60):
                    now = sum(mass[c] for c in own)
                    open_cells = [c for c in own if now > w or mass[c] < rows[c]]
                    free = sum(mass[c] for c in open_cells)
                    if abs(now - w) < 1e-9 * w or free <= 0:
                        break
                    for c in open_cells:
                        mass[c] = min(rows[c], mass[c] * (w - now + free) / free)
    return mass


def test_mixing(spark, docs, texts):
    targets = {"source": {"s0": 0.25}, "lang": 0.9}
    got = mixing.mix_sources(docs, targets, keep_share=0.4).collect()
    again = mixing.mix_sources(docs.repartition(5), targets, keep_share=0.4).collect()
    assert {(r["doc_id"], r["selected"]) for r in got} == {(r["doc_id"], r["selected"]) for r in again}
    total = sum(r["n_tokens"] for r in got)
    assert total == sum(len(WORD.findall(t or "")) for t in texts.values())
    cells = Counter()
    for r in got:
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    cells = {c: n for c, n in cells.items() if n}
    has = [Counter() for _ in range(3)]
    for c, n in cells.items():
        for k in range(3):
            has[k][c[k]] += n
    shares = [{s: 0.25 if s == "s0" else 0.75 * n / (total - has[0]["s0"]) for s, n in has[0].items()}, {s: n**0.9 / sum(x**0.9 for x in has[1].values()) for s, n in has[1].items()}, {s: n / total for s, n in has[2].items()}]
    want = [{s: 0.4 * total * v for s, v in share.items()} for share in shares]
    assert all(v <= has[k][s] for k in range(3) for s, v in want[k].items())
    for k in range(3):
        reached = Counter()
        for r in got:
            reached[(r["source"], r["lang"], r["topic"])[k]] += r["n_tokens"] * r["probability"]
        assert {s: pytest.approx(reached[s], rel=1e-5) for s in want[k]} == want[k]
    brute = brute_rake(cells, 3, want, 300)
    for r in got:
        if r["n_tokens"]:
            c = (r["source"], r["lang"], r["topic"])
            assert r["probability"] == pytest.approx(brute[c] / cells[c], rel=0.02, abs=1e-3) and r["weight"] == pytest.approx(r["probability"] / 0.4)
    spread = {r["doc_id"]: r["probability"] for r in mixing.mix_sources(docs, targets, keep_share=0.4, max_cells=1).collect()}
    assert all(spread[r["doc_id"]] == pytest.approx(r["probability"], abs=1e-3) for r in got)
    assert mixing.mix_sources(empty(spark), {}).count() == 0
    assert mixing.mix_sources(docs.selectExpr("*", "1 AS weight", "2 AS topic"), {}).columns.count("weight") == 1


def test_null_ids_are_drawn_one_by_one(spark):
    rows = [(None, f"word {k} here", "en", "s", 0) for k in range(400)] + [(9, "a b", None, None, 0)] * 3 + [(10, "w " * 500_000, "en", "s", 0)]
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), {"source": 1.0}).collect()
    assert len(got) == 404 and 120 < sum(r["selected"] for r in got if r["doc_id"] is None) < 280
    assert len({r["selected"] for r in got if r["doc_id"] == 9}) == 1


def test_passages(spark, docs, texts):
    got = passages.repeated_passages(docs).collect()
    pairs = {(r["doc_id"], r["src_doc_id"]) for r in got}
    assert {(30, 3), (31, 3), (42, 41), (43, 41)} == pairs
    exact = next(r for r in got if r["doc_id"] == 42)
    assert (exact["start_word"], exact["end_word"], exact["identity"]) == (40, 120, 1.0)
    fuzzy = next(r for r in got if r["doc_id"] == 43)
    assert abs(fuzzy["start_word"] - 40) <= 2 and abs(fuzzy["end_word"] - 119) <= 2 and 0.9 < fuzzy["identity"] < 1
    assert passages.repeated_passages(empty(spark)).count() == 0
    left = {r["doc_id"]: r["text"] for r in passages.remove_passages(docs, passages.repeated_passages(docs)).collect()}
    assert WORD.findall(left[42]) == WORD.findall(texts[42])[:40] + WORD.findall(texts[42])[120:]
    assert left[30].strip() == "" and left[0] == texts[0] and left[32] is None


def test_passages_whose_parts_are_scattered(spark):
    rng = random.Random(21)
    line, other = words(rng, 50, 100000), lambda n: words(rng, n, 100000)
    rows = {1: other(30) + line[:30] + other(30), 2: other(20) + line[24:] + other(40), 8: other(35) + line + other(30), 9: other(60) + line + other(10), 11: other(9) + line[5:45] + other(9)}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["src_doc_id"]): (r["start_word"], r["end_word"]) for r in passages.repeated_passages(docs).collect()}
    assert got == {(9, 8): (60, 110), (11, 8): (9, 49)}
    long = spark.createDataFrame([(1, " ".join(other(100))), (2, " ".join(other(100)))], "doc_id long, text string")
    assert passages.repeated_passages(long).count() == 0
    short = spark.createDataFrame([(1, " ".join(line[:20])), (2, " ".join(line[:20]))], "doc_id long, text string")
    assert passages.repeated_passages(short).count() == 0


def test_exact_runs_against_brute_force(spark):
    rng = random.Random(22)
    pool = [words(rng, n, 100000) for n in (60, 45, 40, 90, 200)]
    rows = {}
    for k in range(40):
        w = words(rng, 15, 100000)
        for _ in range(4):
            p = rng.choice(pool)
            a = rng.randrange(0, len(p) - 10)
            w += p[a : a + rng.randrange(10, 70)] + words(rng, rng.randrange(1, 12), 100000)
        rows[k] = w
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], "doc_id long, text string").repartition(4)
    hit = defaultdict(set)
    for r in passages.repeated_passages(docs).collect():
        hit[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    seen = set()
    for k, w in rows.items():
        runs = [tuple(w[a : a + 40]) for a in range(len(w) - 39)]
        for a, run in enumerate(runs):
            assert run not in seen or set(range(a, a + 40)) <= hit[k]
        seen |= set(runs)


def local_identity(a, b, min_words):
    """Whether some words a[i:j] of min_words and some b[k:l] match in 90 % of the longer one (local alignment with unit costs)."""
    n, m = len(a), len(b)
    score, start, hit = np.zeros(m + 1), np.tile([-1, -1], (m + 1, 1)), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        new, at, got = np.zeros(m + 1), np.tile([-1, -1], (m + 1, 1)), np.zeros(m + 1, int)
        for j in range(1, m + 1):
            same = a[i - 1] == b[j - 1]
            best = max((score[j - 1] + (1 if same else -4), 0), (score[j] - 4, 1), (new[j - 1] - 4, 2))
            if best[0] > 0:
                new[j] = best[0]
                prev = ((start[j - 1], hit[j - 1]), (start[j], hit[j]), (at[j - 1], got[j - 1]))[best[1]]
                at[j] = prev[0] if prev[0][0] >= 0 else (i - 1, j - 1)
                got[j] = prev[1] + (best[1] == 0 and same)
                if i - at[j][0] >= min_words and got[j] >= 0.9 * max(i - at[j][0], j - at[j][1]):
                    return True
        score, start, hit = new, at, got
    return False


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + (x == y), row[j + 1], new[j]))
        row = new
    return row[-1]


def test_passages_against_brute_force(spark):
    rng = random.Random(41)
    pool = [words(rng, n, 100000) for n in (50, 60, 70, 55, 65)]

    def edited(p):
        out = list(p)
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(len(out))
            out[k : k + rng.randrange(0, 2)] = words(rng, rng.randrange(0, 2), 100000)
        return out

    rows = {k: words(rng, rng.randrange(10, 40), 100000) + edited(rng.choice(pool)) + words(rng, rng.randrange(5, 30), 100000) for k in range(26)}
    rows |= {k: words(rng, 90, 100000) for k in range(26, 34)}
    docs = spark.createDataFrame([(k, " ".join(w), "x", 1) for k, w in rows.items()], "doc_id long, text string, chunk string, src_doc_id int").repartition(4)
    got = passages.repeated_passages(docs).collect()
    assert all(r["src_doc_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 40 for r in got)
    for r in got:
        a, b = rows[r["doc_id"]][r["start_word"] : r["end_word"]], rows[r["src_doc_id"]][r["src_start_word"] : r["src_end_word"]]
        assert common(a, b) >= r["n_matched"] >= 0.8 * max(len(a), len(b)) and r["identity"] == pytest.approx(r["n_matched"] / max(len(a), len(b)))
    want = {k for k in rows if any(local_identity(rows[k], rows[j], 40) for j in range(k))}
    assert want <= {r["doc_id"] for r in got} and len(want) > 10 and not {r["doc_id"] for r in got} & set(range(26, 34))


def test_passages_of_repeated_ids_and_long_texts(spark):
    rng = random.Random(51)
    shared, long = words(rng, 60, 100000), words(rng, 900_000, 1_000_000)
    rows = [(1, " ".join(words(rng, 5) + shared)), (1, " ".join(words(rng, 20))), (2, " ".join(shared)), (2, "few words"), (2, None), (None, " ".join(shared)), (3, " ".join(long)), (4, " ".join(words(rng, 30) + long[500_000:500_100]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(docs)
    assert {(r["doc_id"], r["src_doc_id"], r["start_word"], r["end_word"]) for r in found.collect()} == {(2, 1, 0, 60), (4, 3, 30, 130)}
    left = Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in passages.remove_passages(docs, found).collect())
    assert left == Counter({(1, 65): 1, (1, 20): 1, (2, 0): 3, (None, 60): 1, (3, 900_000): 1, (4, 30): 1})


def test_a_loose_chain_hides_no_close_one():
    a = np.arange(1000, 1300)
    b = np.concatenate([a[:100], np.arange(5000, 5040), a[100:130], a[160:]])
    spread = np.array([(0, 0, 100), (100, 140, 30), (160, 170, 140)])
    assert passages.verified(a, b, spread, 40, 0.8)
    x, y = np.array([1, 2, 9, 3, 4, 5]), np.array([1, 7, 2, 3, 8, 4, 5])
    assert passages.common_words(x, y) == common(x.tolist(), y.tolist()) == 5


def test_chain_is_the_best_chain():
    rng = random.Random(8)
    for _ in range(60):
        blocks = np.array(sorted({(rng.randrange(0, 60), rng.randrange(0, 60), rng.randrange(3, 8)) for _ in range(7)}))
        best = np.zeros(len(blocks))
        for i in sorted(range(len(blocks)), key=lambda i: blocks[i, 0]):
            p, q, n = blocks[i].tolist()
            before = [best[j] - passages.GAP_COST * (p - blocks[j, 0] - blocks[j, 2] + q - blocks[j, 1] - blocks[j, 2]) for j in range(len(blocks)) if j != i and blocks[j, 0] + blocks[j, 2] <= p and blocks[j, 1] + blocks[j, 2] <= q]
            best[i] = n + max([0, *before])
        top = passages.chain(blocks)[0]
        score = sum(blocks[i, 2] for i in top) - sum(passages.GAP_COST * (blocks[b, 0] - blocks[a, 0] - blocks[a, 2] + blocks[b, 1] - blocks[a, 1] - blocks[a, 2]) for a, b in zip(top, top[1:], strict=False))
        assert score == pytest.approx(best.max())


def test_a_long_block_does_not_hide_nearer_ones():
    blocks = np.array([(0, 0, 300), (400, 400, 20), (425, 428, 20)])
    assert sorted(passages.chain(blocks)) == [[0], [1, 2]]
    rng = random.Random(3)
    for _ in range(60):
        blocks = np.array(sorted({(rng.randrange(0, 200), rng.randrange(0, 200), rng.randrange(3, 30)) for _ in range(9)}))
        gap = lambda j, i: (blocks[i, :2] - blocks[j, :2] - blocks[j, 2]).tolist()
        best = np.zeros(len(blocks))
        for i in range(len(blocks)):
            near = [best[j] - passages.GAP_COST * sum(gap(j, i)) for j in range(i) if min(gap(j, i)) >= 0 and max(gap(j, i)) <= passages.MAX_GAP]
            best[i] = blocks[i, 2] + max([0, *near])
        top = passages.chain(blocks)[0]
        assert sum(blocks[i, 2] for i in top) - sum(passages.GAP_COST * sum(gap(a, b)) for a, b in zip(top, top[1:], strict=False)) == pytest.approx(best.max())


def test_urls(spark):
    page = lambda link: f'<html><head><link rel="canonical" href="{link}"></head></html>'
    rows = [
        (1, "http://a.example.net/es/x", "<html></html>"),
        (2, "http://mirror.example.org/1", page("http://a.example.net/es/x")),
        (3, "http://other.example.org/2", page("//mirror.example.org/1")),
        (4, "http://ok.example.com/es/3", page("http://mirror.example.org/1")),
        (5, "http://free.example.org/", "<meta http-equiv='refresh' content='0; url=http://b.example.net/fr/9'>"),
        (6, None, None),
        (7, "nonsense", "<p>"),
        (8, "HTTP://WWW.Example.com/en/p?x#y", None),
        (9, "http://example.com/en/", ""),
    ]
    got = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), urls.EXAMPLE_RULES).collect()}
    assert [got[k]["verdict"] for k in range(1, 10)] == ["block", "allow", "allow", "allow", "block", "allow", "allow", "allow", "block"]
    assert got[8]["host"] == "www.example.com" and got[8]["rule"] == "www.example.com/en/" and got[6]["host"] == "" and got[7]["path"] == ""
    no_allow = [r for r in rows if r[0] != 4]
    got = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(no_allow, "page_id long, url string, html string"), urls.EXAMPLE_RULES).collect()}
    assert got[2]["verdict"] == got[3]["verdict"] == "block" and got[3]["inherited"]
    rows += [
        (10, "http://slash.example.org/q", page("http://a.example.net/es/")),  # a target that is no page and ends in a slash
        (11, "http://apart.example.org/?ref=1", page("http://z.example.net/fr/1")), (12, "http://apart.example.org/?ref=2", ""),
        (13, "http://track.example.org/a/?utm_source=x", page("http://z.example.net/fr/1")), (14, "https://track.example.org/a#top", ""), (14, "https://track.example.org/a#top", ""),
        (15, "http://rel.example.org/d/e?k=1", page("f")), (16, "http://rel.example.org/d/f", page("../x")), (17, "http://net/es/", page("http://rel.example.org/d/f")),
        (None, "http://rel.example.org/d/f", None),
    ]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, node string, verdict string")
    got = urls.judge_urls(table, urls.EXAMPLE_RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    said = {r["page_id"]: r["verdict"] for r in got}
    assert [said[k] for k in range(10, 18)] == ["block", "block", "allow", "block", "block", "block", "block", "block"] and said[None] == "block"
    import duckdb
    import pandas as pd

    from rankforge.llm import queries

    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    con.execute("CREATE VIEW pages AS SELECT page_id, url, html FROM frame")
    assert Counter(map(tuple, got)) == Counter(con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLE_SQL['op5_url_aliases']})").fetchall())
    assert urls.judge_urls(table.limit(0), urls.EXAMPLE_RULES).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in out}
    assert kept and not kept & {30, 31, 32, 33, 34, 35, 36, 37, 38, 45}
    assert len(corpus_pipeline.STAGES) == 5
    odd = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 AS weight", "'x' AS topic", "2 AS n_words", "3 AS component_id")
    odd = odd.union(odd).union(odd.where("doc_id < 3").selectExpr("CAST(NULL AS BIGINT)", "text", "lang", "source", "n_chars", "1", "'y'", "2", "3")).union(odd.where("doc_id = 7").selectExpr("doc_id", "concat(text, ' and other words')", "lang", "source", "n_chars", "1", "'y'", "2", "3"))
    odd.coalesce(2).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    again = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r["doc_id"] for r in again} - {None} <= set(range(46)) and len({(r["doc_id"], r["start"]) for r in again if r["doc_id"] is not None}) == sum(r["doc_id"] is not None for r in again)
    empty(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_licences(spark):
    import textwrap

    import duckdb
    import pandas as pd

    from rankforge.llm import licences as L
    from rankforge.llm.licence_texts import NOTICES

    notice = lambda name: max((t for n, _, t in NOTICES if n == name), key=len)
    wrap = lambda t, lead="", width=75: "\n".join(textwrap.wrap(t, width, initial_indent=lead, subsequent_indent=lead))
    grant, rest = notice("MIT").split("conditions: ")
    mit = "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + wrap(grant + "conditions:") + "\n\n" + wrap(rest)
    commented = "/*\n * Copyright 2021 Some Body\n *\n" + "\n *\n".join(wrap(x, " * ") for x in notice("Apache-2.0").split("\n\n")) + "\n */\nint main;"
    rows = [
        (1, "Prose here.\nLicensed under the Apache License, Version 2.0."),
        (2, mit + "\nReleased  under the MIT Licence!"),
        (3, "All rights reserved. Licensed under CC BY-NC 4.0. All rights reserved."),
        (4, "It is not licensed under the Apache License, Version 2.0."),
        (5, None), (6, ""), (7, "The software is provided \"AS IS\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
        (8, commented), (9, wrap(notice("GPL-3.0-or-later"), "# ", 60)), (10, wrap(notice("GPL-2.0-or-later"), "// ", 72)),
        (11, wrap(notice("BSD-3-Clause"), "  ")), (12, "// SPDX-License-Identifier: MIT\nint x;"), (13, "no stop here\nReleased under the MIT License\nand on it goes"),
        (14, "a line with no stop\n" + wrap(grant + "conditions:", "", 40) + "\n" + rest), (15, wrap(notice("Zlib"), "; ")), (16, "word " * 200_000 + "\n\n" + wrap(notice("ISC"))),
        (17, "Copyright (c) 2019, Somebody\nAll rights reserved.\n\n" + wrap(notice("BSD-3-Clause"))), (18, "Copyright 2020.\nAll rights reserved."),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = L.scan_licences(docs.union(docs.where("doc_id < 4"))).collect()
    named = {r["doc_id"]: r["licences"] for r in got}
    assert named == {1: "Apache-2.0", 2: "MIT", 3: "CC-BY-NC-4.0", 4: "", 5: "", 6: "", 7: "", 8: "Apache-2.0", 9: "GPL-3.0-or-later", 10: "GPL-2.0-or-later", 11: "BSD-3-Clause", 12: "MIT", 13: "MIT", 14: "MIT", 15: "Zlib", 16: "ISC", 17: "BSD-3-Clause", 18: "Proprietary"}
    assert {r["doc_id"]: r["n_unmatched"] for r in got} == {k: int(k == 7) for k, _ in rows}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([*rows, *rows[:3]], columns=["doc_id", "text"]))
    assert Counter(map(tuple, got)) == Counter(con.sql(L.scan_sql()).fetchall())
    assert L.scan_licences(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 AS licences", "2 AS _ids")
    assert L.scan_licences(clash).columns == ["doc_id", "sentence_ids", "licences", "n_unmatched"]


def test_every_notice_is_found(spark):
    from rankforge.llm import licences as L
    from rankforge.llm.licence_texts import NOTICES

    docs = spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(NOTICES)], "doc_id int, text string")
    got = {r["doc_id"]: r["licences"].split(",") for r in L.scan_licences(docs).collect()}
    assert all(name in got[k] for k, (name, _, _) in enumerate(NOTICES))
    assert len(L.SENTENCES) > 120 and len(L.RULES) > 80


def test_each_quality_rule_has_its_sql(spark):
    import duckdb

    from rankforge.llm import queries

    rng = random.Random(12)
    prose = lambda n: " ".join(words(rng, n, 100000))
    rows = [prose(60), "\n".join(f"- {prose(6)}" for _ in range(10)), "\n".join(f" \t* {prose(6)}" for _ in range(9)) + "\nplain " + prose(5), "\n".join(f"{prose(5)}..." for _ in range(6)), "\n".join(f"{prose(5)}… \t" if k % 2 else prose(5) for k in range(8))]
    rows += ["\n".join(f"• {prose(8)}" for _ in range(4)), " ".join(f"#{w}" for w in words(rng, 30, 100000)), " ".join("abcdefghijklmno" + w for w in words(rng, 30, 100000)), "\n".join([prose(6), "the same line of words"] * 5), " ".join(w for w in words(rng, 14, 100000) for _ in (0, 1, 2)), " ".join("1234" + w[0] for w in words(rng, 30, 100000)), None, ""]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    judged = quality.judge_quality(docs).collect()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, kept FROM ({queries.ORACLE_SQL['op3_quality_cascade']})").fetchall()}
    assert {r["doc_id"]: r["kept"] for r in judged} == want
    assert not want[1] and not want[3] and want[0] and sum(want.values()) < 6
