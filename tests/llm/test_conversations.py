"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from rankforge.llm import conversations as cv

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost int"


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def brute(rows):
    """Of rows (turn, role, text) in order: the contract's columns."""
    seen, faults = set(), []
    for _, r, x in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", x)
        faults.append("b" if not solid else "d" if (r, x) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((r, x))
    best = {0: (0, "", ())}
    step = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    def put(into, q, value):
        into[q] = min(into.get(q, value), value)

    def insert(table):
        for q in [0, 1, 3, 2, 3]:
            if q in table:
                cost, a, out = table[q]
                put(table, step[q][0], (cost + 2, a + "I", (*out, step[q][1] + ":")))
        return table

    insert(best)
    for (_, r, x), f in zip(rows, faults, strict=True):
        after = {}
        for q, (cost, a, out) in best.items():
            put(after, q, (cost + 3, a + "D", out))
            if f in ("b", "d"):
                continue
            add = f == "t"
            put(after, step[q][0], (cost + 2 + add, a + "R", (*out, f"{step[q][1]}:{x}")))
            to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((r[:1], q))
            if to:
                put(after, to, (cost + add, a + "K", (*out, f"{r}:{x}")))
        best = insert(after)
    cost, audit, out = min(v for q, v in best.items() if q in (0, 3))
    t = [t for t, _, _ in rows if t is not None]
    bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(t) - min(t) + 1 - len(set(t)) if t else 0, faults.count("b"), faults.count("d"), faults.count("t"), bad, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def order(rows):
    said = lambda c, r, x: hashlib.sha256(f"{len(str(' ' if c is None else c))}:{' ' if c is None else c}{len(r)}:{r}{x}".encode()).digest()
    return sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0, v[2].encode(), said(v[0], v[2], v[3])))


def want(rows, ids):
    groups = {i: [] for i in ids}
    for c, t, r, x in order(rows):
        groups[c].append((t, r, x))
    return {c: brute(v) for c, v in groups.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for c in range(60):
        for t in range(rng.randrange(1, 14)):
            out.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "u2"]), rng.choice(["yes.", "no", "Über 日本!", " \t\n", "", None, f"w{rng.random()}?", f"cut {rng.random()} "])))
    out += [(None, t, "user", f"q{t}.") for t in range(5)] + [(70, None, "user", "a."), (70, None, "user", "b.")]
    out += [(80, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(300)]  # converges at once
    out += [(81, t, "user", f"turn {t}.") for t in range(301)]  # never does
    out += [(82, t, "user", "the same.") for t in range(150)] + [(83, t, "system", f"s{t}.") for t in range(90)]
    out += [(84, t, rng.choice(["system", "user", "assistant", "tool"]), f"x{t}" + rng.choice([".", ""])) for t in range(400)]
    return out + out[:9] + [(85, 0, "user", "long " * 40000)]


@pytest.mark.parametrize("parts,chunk", [(1, 65536), (5, 7), (23, 3)])
def test_repairs(spark, rows, parts, chunk):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in cv.repair_conversations(cv.damage(df), df, parts, chunk).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert got == want(damaged(rows), {r[0] for r in rows})


def test_undamaged_rows_and_empty_tables(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows if r[0] in (80, 84, 3)], SCHEMA)
    got = {r["conv_id"]: r["audit"] for r in cv.repair_conversations(df, parts=4, chunk_turns=50).collect()}
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c in (80, 84, 3)]
    assert got == {c: v[6] for c, v in want(plain, {80, 84, 3}).items()} and got[80] == "K" * 300
    assert cv.repair_conversations(df.limit(0)).collect() == []
    lone = cv.repair_conversations(df.limit(0), df.select("conv_id")).collect()
    assert {tuple(r)[1:] for r in lone} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(lone) == 3


def test_speculative_vectors_span_all_costs():
    s = cv.SPECULATIVE
    fits = lambda v: all(v[q] <= v[j] + s[j][q] for j in range(4) for q in range(4))
    assert fits(cv.END) and all(map(fits, s))
    assert all(fits(cv.step_back(v, code)) for v in s for code in range(9))


def test_speculation_is_exact_and_converges():
    rng = random.Random(9)
    for _ in range(200):
        codes = bytes(rng.choice([0, 1, 2, 2, 3, 4, 4, 5, 6, 7, 8]) for _ in range(rng.randrange(0, 30)))
        m = cv.speculate(codes, False)
        for behind in (bytes(rng.choice(range(9)) for _ in range(rng.randrange(9))) for _ in range(5)):
            v = cv.END
            for c in reversed(behind):
                v = cv.step_back(v, c)
            told = tuple(min(v[j] + m[4 * j + q] for j in range(4)) for q in range(4))
            for c in reversed(codes):
                v = cv.step_back(v, c)
            assert told == v
    m = cv.speculate(bytes([2, 4] * 5), False)
    assert all(m[4 * j + q] - m[4 * j] == m[q] - m[0] for j in range(4) for q in range(4))
