"""Repair of conversations: the cheapest edits that make roles alternate, by a rank-convergence parallel Viterbi.

A repaired conversation's roles are empty, or an optional system turn and pairs of user and assistant. Keeping a turn costs 0,
giving it another role 2, deleting it 3 (blank and repeated turns must go), inserting an empty turn 2, leaving a truncated turn 1.

Costs to the end are vectors over four states (nothing yet, system, user, assistant), and a turn maps them by a min-plus linear
map. Turns are sorted by Spark into ranges and cut to chunks (a byte a turn), so a conversation of any length is many tasks' work.
A chunk of a longer conversation doesn't know the costs behind it: it starts from four speculative vectors, of which every possible
vector is a min-plus combination. Mostly they soon differ only by constants, and the chunk's left end is settled whatever follows.
Chunks where they still differ are fixed up by those behind them, in passes that double the reach, until all are settled. With the
true costs at its right end each chunk is run again and traced forwards from its state, always by the least letter that a cheapest path allows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, materialize, salted_join

#: Turns of a chunk, a byte each.
CHUNK_TURNS = 65_536
_FAR = 1 << 40
#: The state after any turn but a system turn that is kept, and the role that leads there.
_AHEAD = (2, 2, 3, 2)
_ROLES = ("user", "user", "assistant", "user")
_KEEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
#: A turn's byte: 2 * (system 0, user 1, assistant 2, other 3) + truncated, or 8 for one that must go.
GONE = 8


def _closed(v: list[int]) -> tuple[int, ...]:
    """Costs where inserted turns may come first."""
    u = min(v[2], 2 + v[3])
    return min(v[0], 2 + u), min(v[1], 2 + u), u, min(v[3], 2 + u)


#: Costs behind the last turn.
END = _closed([0, _FAR, _FAR, 0])
#: How much dearer than state j (row) a state (column) can be, whatever follows. Each row is such costs itself; their
#: min-plus combinations are all there are (``v = min_j v[j] + SPECULATIVE[j]``).
SPECULATIVE = ((0, 4, 5, 3), (0, 0, 2, 0), (2, 2, 0, 2), (0, 4, 2, 0))


def step_back(v: tuple[int, ...], code: int) -> tuple[int, ...]:
    """Costs before a turn from those behind it."""
    if code == GONE:
        return tuple(x + 3 for x in v)
    role, cut = code >> 1, code & 1
    return _closed([min(3 + v[q], cut + 2 + v[_AHEAD[q]], cut + v[_KEEP[q, role]] if (q, role) in _KEEP else _FAR) for q in range(4)])


class _Steps(dict):
    """(vector less its minimum, code) to (the next such vector, the constant): there are few of them."""

    def __missing__(self, key):
        w = step_back(*key)
        least = min(w)
        self[key] = tuple(x - least for x in w), least
        return self[key]


_steps = _Steps()


def speculate(codes: bytes, last: bool) -> list[int]:
    """The left end's costs for each of the speculative vectors at the right end (four times the true ones in the last chunk)."""
    ends = [END] * 4 if last else list(SPECULATIVE)
    now = [(tuple(x - min(v) for x in v), min(v)) for v in ends]
    at = len(codes)
    while at and len({v for v, _ in now}) > 1:
        at -= 1
        now = [(w, c + d) for (v, c) in now for w, d in (_steps[v, codes[at]],)]
    v, more = now[0][0], 0
    if at:  # they differ by constants only
        for code in reversed(codes[:at]):
            v, d = _steps[v, code]
            more += d
        now = [(v, c + more) for _, c in now]
    return [x + c for v, c in now for x in v]


def trace(codes: bytes, end: tuple[int, ...], state: int, last: bool) -> tuple[str, int, int]:
    """(letters, cost, state behind) of the cheapest edits from a state, the least in ASCII, by the costs ``end`` at the right end."""
    least = min(end)
    vectors = [tuple(x - least for x in end)]
    for code in reversed(codes):
        vectors.append(_steps[vectors[-1], code][0])
    vectors.pop()
    letters, cost = [], 0
    for code in codes:
        behind = vectors.pop()
        found, more, state = _choices[behind, code, state]
        letters.append(found)
        cost += more
    if last:
        while END[state]:
            letters.append("I")
            cost, state = cost + 2, _AHEAD[state]
    return "".join(letters), cost, state


class _Choices(dict):
    """(vector behind a turn, code, state) to (letters, their cost, state behind)."""

    def __missing__(self, key):
        behind, code, q = key
        now, letters, cost = step_back(behind, code), "", 0
        role, cut = code >> 1, code & 1
        while True:
            if now[q] == 3 + behind[q]:
                found = "D", 3, q
            elif now[q] == 2 + now[_AHEAD[q]]:
                letters, cost, q = letters + "I", cost + 2, _AHEAD[q]
                continue
            elif (q, role) in _KEEP and now[q] == cut + behind[_KEEP[q, role]]:
                found = "K", cut, _KEEP[q, role]
            else:
                found = "R", 2 + cut, _AHEAD[q]
            self[key] = letters + found[0], cost + found[1], found[2]
            return self[key]


_choices = _Choices()


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Test damage by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it the user's. Nulls are a blank there."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_id), F.lit(":"), said(turn))) % 20
    out = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    out = out.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _ordered(df: DataFrame) -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("same")]


_CHUNK = "conv_id {}, part int, seq bigint, codes binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, first_turn bigint, last_turn bigint, turns bigint"


def _cut(batches: Iterator[pa.RecordBatch], types: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Chunks of sorted turns (conv_id, turn, initial, times, blank, fresh, cut); see _CHUNK."""
    part, seq, now, out = TaskContext.get().partitionId(), 0, None, []

    def ended():
        nonlocal seq
        out.append({**now, "part": part, "seq": seq, "codes": bytes(now["codes"])})
        seq += 1

    for b in batches:
        for conv, turn, initial, times, blank, fresh, cut in zip(*(c.to_pylist() for c in b.columns), strict=True):
            while times:
                if now is None or now["conv_id"] != conv or len(now["codes"]) >= most:
                    if now:
                        ended()
                    now = {"conv_id": conv, "codes": bytearray(), "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": initial, "last": None, "first_turn": turn, "last_turn": None, "turns": 0}
                n = min(times, most - len(now["codes"]))
                if now["last"] is not None:
                    now["illegal"] += now["last"] + initial not in ("su", "ua", "au")
                now["illegal"] += n - 1
                now["last"] = initial
                if turn is not None and turn != now["last_turn"]:
                    now["turns"] += 1
                    now["first_turn"] = turn if now["last_turn"] is None else now["first_turn"]
                    now["last_turn"] = turn
                if blank:
                    now["blank"] += n
                    now["codes"] += bytes([GONE]) * n
                else:
                    now["codes"] += (bytes([2 * {"s": 0, "u": 1, "a": 2}.get(initial, 3) + cut]) if fresh else b"") + bytes([GONE]) * (n - fresh)
                    now["duplicate"] += n - fresh
                    now["truncated"] += fresh and cut
                    fresh = False
                times -= n
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=types)
            out.clear()
    if now:
        ended()
        yield pa.RecordBatch.from_pylist(out, schema=types)


def _settle(rows: DataFrame, way: int, compose: Callable[[str, str], Column], settled: Column) -> DataFrame:
    """(conv_id, idx, m) with maps composed with those ``way`` of them until each is settled; the reach doubles in every pass."""
    reach = 1
    while not rows.where(~settled).isEmpty():
        near = rows.select(F.col("conv_id").alias("c"), (F.col("idx") - way * reach).alias("i"), F.col("m").alias("other"))
        open_ = rows.where(~settled).join(near, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("idx") == F.col("i"))).select("conv_id", "idx", compose("m", "other").alias("m"))
        rows = materialize(rows.where(settled).unionByName(open_), "settled")
        reach *= 2
    return rows


def _neighbour(chunks: DataFrame, told: DataFrame, way: int, name: str) -> DataFrame:
    told = told.select(F.col("conv_id").alias("c"), (F.col("idx") - way).alias("i"), F.col("m").alias(name))
    return chunks.join(told, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("idx") == F.col("i")), "left").drop("c", "i")


def _run(rows: DataFrame, schema: str, kind: pa.Schema, one: Callable[[dict], dict]) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([one(r) for r in b.to_pylist()], schema=kind)

    return rows.mapInArrow(run, schema)


def _solve(chunks: DataFrame, kind: str, arrow: pa.DataType) -> DataFrame:
    """(conv_id, idx, letters, cost) of chunks (conv_id, idx, total, codes)."""
    shape = f"conv_id {kind}, idx int, m array<bigint>"
    maps = pa.schema([("conv_id", arrow), ("idx", pa.int32()), ("m", pa.list_(pa.int64()))])
    many = chunks.where("total > 1")
    done = chunks.where("total = 1").select("*", F.lit(None).cast("array<bigint>").alias("ends"), F.lit(0).alias("state"))
    if not many.isEmpty():
        spec = materialize(_run(many, shape, maps, lambda r: {"conv_id": r["conv_id"], "idx": r["idx"], "m": speculate(r["codes"], r["idx"] == r["total"])}), "speculated")
        at = lambda m, j, q: F.col(m)[4 * j + q]
        chain = lambda m, o: F.array(*[F.least(*[at(o, j, k) + at(m, k, q) for k in range(4)]) for j in range(4) for q in range(4)])
        constant = F.lit(True)
        for j in range(1, 4):
            for q in range(1, 4):
                constant &= at("m", j, q) - at("m", j, 0) == at("m", 0, q) - at("m", 0, 0)
        left = _settle(spec, 1, chain, constant)
        told = materialize(_neighbour(many, left.withColumn("m", F.slice("m", 1, 4)), 1, "ends"), "ends")
        states = _run(told, shape, maps, lambda r: {"conv_id": r["conv_id"], "idx": r["idx"], "m": [trace(r["codes"], tuple(r["ends"] or END), 0 if r["idx"] == 1 else q, False)[2] for q in range(4)]})
        same = F.size(F.array_distinct("m")) == 1
        after = _settle(materialize(states, "states"), -1, lambda m, o: F.transform(o, lambda q: F.col(m)[q.cast("int")]), same)
        done = done.unionByName(_neighbour(told, after, -1, "before").withColumn("state", F.coalesce(F.col("before")[0], F.lit(0)).cast("int")).drop("before"))
    out = pa.schema([("conv_id", arrow), ("idx", pa.int32()), ("letters", pa.string()), ("cost", pa.int64())])

    def last(r):
        letters, cost, _ = trace(r["codes"], tuple(r["ends"] or END), r["state"], r["idx"] == r["total"])
        return {"conv_id": r["conv_id"], "idx": r["idx"], "letters": letters, "cost": cost}

    return _run(done.select("conv_id", "idx", "total", "codes", "ends", "state"), f"conv_id {kind}, idx int, letters string, cost bigint", out, last)


def _join_up(batches: Iterator[pa.RecordBatch], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row a conversation from its chunks (in order), then its turns (in order), as they stream by."""
    now, out = None, []

    def ended():
        for letter in now["letters"][now["at"] :]:  # inserted at the end
            say(letter, None, None)
        span = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
        out.append({k: now[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")} | {"gaps": span, "audit": now["letters"], "repaired_sha256": now["sha"].hexdigest()})

    def say(letter, role, text):
        q = now["state"]
        if letter != "D":
            if letter != "K":
                role, q = _ROLES[q], _AHEAD[q]
            else:
                q = _KEEP[q, {"s": 0, "u": 1, "a": 2}[role[0]]]
            now["sha"].update(("\n" * now["any"] + role + ":").encode() + (text or b""))
            now["any"], now["state"] = True, q

    for b in batches:
        for r in b.to_pylist():
            if now is None or now["conv_id"] != r["conv_id"]:
                if now:
                    ended()
                now = {"conv_id": r["conv_id"], "parts": [], "letters": None, "at": 0, "sha": hashlib.sha256(), "any": False, "state": 0, "low": None, "high": None, "turns": 0, "last": None}
                now |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            if r["letters"] is not None:
                now["parts"].append(r["letters"])
                for k in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                    now[k] += r[k]
                if now["last"] is not None:
                    now["illegal"] += now["last"] + r["first"] not in ("su", "ua", "au")
                now["last"] = r["last"]
                if r["last_turn"] is not None:
                    now["turns"] -= now["high"] == r["first_turn"]
                    now["low"] = r["first_turn"] if now["low"] is None else now["low"]
                    now["high"] = r["last_turn"]
            if now["letters"] is None and (r["role"] is not None or r["letters"] is None):
                now["letters"] = "".join(now["parts"])
            if r["role"] is not None:
                while True:
                    letter = now["letters"][now["at"]]
                    now["at"] += 1
                    say(letter, r["role"], r["text"] if letter != "I" else None)
                    if letter != "I":
                        break
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=types)
            out.clear()
    if now:
        ended()
        yield pa.RecordBatch.from_pylist(out, schema=types)


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None, parts: int | None = None, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations (conv_id, turn, role, text).

    Turns come in the order of turn (nulls first), role and a digest of the text. A turn's first fault counts: blank, repeated (role
    and text seen earlier), truncated (its last letter isn't one of ``.!?``). ``audit`` has the letters of the cheapest edits (Keep,
    Rerole, Delete, Insert), the ASCII-least of equal cost; the digest is of the repaired ``role:text`` lines. A null role or text
    is a blank, a null conv_id an id like others, texts of any length are whole, other columns are ignored, an empty table gives no
    rows. ``ids`` (conv_id) also get a row if they have no turn: zeros, an empty audit, the digest of nothing. ``parts`` is the number of sorted
    ranges.

    Nothing of a conversation is gathered but a byte a turn (its audit); the digest of a conversation's text is one stream by its
    nature, so one task reads the turns of one conversation, in order and without holding them.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(" "))
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    turns = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    turns = turns.withColumn("same", F.unhex(F.sha2(F.concat(sized(F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))), sized(F.col("role")), F.col("text")), 256)))
    kind = turns.schema["conv_id"].dataType.simpleString()
    arrow = turns.select("conv_id").limit(0).toArrow().schema.field(0).type
    end = F.regexp_extract("text", rf"({NOT_SPACE})[\x20\x09-\x0D]*$", 1)
    narrow = turns.select("conv_id", "turn", "role", "same", (~F.col("text").rlike(NOT_SPACE)).alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))
    # equal turns are counted where they lie, and the turn a text is first said in is joined back by salted keys
    narrow = materialize(narrow.groupBy("conv_id", "turn", "role", "same", "blank", "cut").agg(F.count("*").alias("times")), "turns")
    first = narrow.groupBy("same").agg(F.min(F.struct(F.col("turn").isNotNull().alias("k"), "turn")).alias("first"), F.count("*").alias("n"))
    marked = salted_join(narrow, first, "same", "n", "turn", narrow.count()).withColumn("fresh", ~F.col("blank") & F.col("turn").eqNullSafe(F.col("first.turn")))
    sorted_ = marked.repartitionByRange(parts, *_ordered(marked)) if parts else marked.repartitionByRange(*_ordered(marked))
    sorted_ = sorted_.sortWithinPartitions(*_ordered(marked)).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "times", "blank", "fresh", F.col("cut").cast("int").alias("cut"))
    types = pa.schema([("conv_id", arrow), ("part", pa.int32()), ("seq", pa.int64()), ("codes", pa.binary()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in ("first_turn", "last_turn", "turns"))])
    chunks = materialize(sorted_.mapInArrow(lambda b: _cut(b, types, chunk_turns), _CHUNK.format(kind)), "chunks")
    w = Window.partitionBy("conv_id")
    chunks = materialize(chunks.withColumn("idx", F.row_number().over(w.orderBy("part", "seq"))).withColumn("total", F.count("*").over(w).cast("int")), "chunks")
    solved = _solve(chunks.select("conv_id", "idx", "total", "codes"), kind, arrow)
    solved = solved.withColumnsRenamed({"conv_id": "c", "idx": "i"}).join(chunks.drop("codes", "part", "seq", "total"), F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("i") == F.col("idx"))).drop("c", "i")
    no = {c: F.lit(None).cast(t) for c, t in solved.drop("conv_id").dtypes}
    lines = turns.select("conv_id", F.lit(1).alias("kind"), *[v.alias(c) for c, v in no.items()], "turn", "role", "same", F.col("text").cast("binary").alias("text"))
    lines = lines.unionByName(solved.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    if ids is not None:
        lines = lines.unionByName(ids.select("conv_id").distinct().withColumn("kind", F.lit(2)), allowMissingColumns=True)
    lines = lines.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", "idx", F.asc_nulls_first("turn"), "role", "same").drop("kind", "same", "turn", "idx")
    fields = [("gaps", "bigint"), ("blank", "bigint"), ("duplicate", "bigint"), ("truncated", "bigint"), ("illegal", "bigint"), ("cost", "bigint"), ("audit", "string"), ("repaired_sha256", "string")]
    last = pa.schema([("conv_id", arrow), *((c, pa.string() if t == "string" else pa.int64()) for c, t in fields)])
    return lines.mapInArrow(lambda b: _join_up(b, last), f"conv_id {kind}, " + ", ".join(f"{c} {t}" for c, t in fields))
