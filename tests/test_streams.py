"""Streams against their batch forms, over replayed micro-batches and a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rankforge.streaming import admission, quota

START = dt.datetime(2024, 1, 1)
SCHEMA = "ord bigint, ts timestamp, key bigint"


def events(rng, n, keys, step):
    t, out = START, []
    for i in range(n):
        t += dt.timedelta(microseconds=rng.randrange(step))
        out.append((i, t, rng.choice(keys)))
    return out


def play(spark, rows, cuts, folder, make, sink):
    """Writes the rows file by file, with a run of the query from its checkpoint after each."""
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        sink(make(stream).writeStream.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True)).awaitTermination()


def test_anchored_stream_equals_the_batch_form(spark, tmp_path):
    rows = events(random.Random(1), 400, [1, 2, 3, 2**60 + 1, 2**60 + 2, None], 9_000_000)
    rows += [(400, START + dt.timedelta(days=1), 1), (401, START + dt.timedelta(days=1, seconds=60), 1), (402, START + dt.timedelta(days=1, seconds=119, microseconds=999_999), 1)]
    columns = ["ord", "key", "window_start", "admitted", "remaining", "reset_ms"]
    play(spark, rows, [150, 151, 300], tmp_path, lambda s: quota.quota_anchored_stream(s, 60, 2, "30 seconds"), lambda w: w.format("parquet").start(str(tmp_path / "out")))
    want = quota.quota_anchored(spark.createDataFrame(rows, SCHEMA), 60, 2).select(*columns).collect()
    got = spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) == len(rows)


def test_null_and_large_keys(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [(1, at(0), 2**60 + 1), (2, at(1), 2**60 + 2), (3, at(2), None), (4, at(3), None), (5, at(60), 2**60 + 1), (6, at(62), None)]
    got = {r["ord"]: (r["key"], r["window_no"], r["admitted"], r["remaining"], r["reset_ms"]) for r in quota.quota_anchored(spark.createDataFrame(rows, SCHEMA), 60, 1).collect()}
    assert got == {1: (2**60 + 1, 1, True, 0, 60000), 2: (2**60 + 2, 1, True, 0, 60000), 3: (None, 1, True, 0, 60000), 4: (None, 1, False, 0, 59000), 5: (2**60 + 1, 2, True, 0, 60000), 6: (None, 2, True, 0, 60000)}
    assert quota.quota_anchored(spark.createDataFrame([], SCHEMA), 60, 1).collect() == []


def test_retention_stream_equals_the_batch_form(spark, tmp_path):
    rng, rows = random.Random(2), []
    for day in (0, 0, 1, 2, 4, 7, 8, 8, 20, 21, 22, 60):
        rows += [(len(rows), START + dt.timedelta(days=day, seconds=rng.randrange(86400)), 1)]
    rows.sort(key=lambda r: r[1])
    play(spark, rows, [4, 6, 9], tmp_path, lambda s: quota.retention_stream(s, 3, "0 seconds"), lambda w: w.format("parquet").start(str(tmp_path / "out")))
    lives = quota.retention_sessions(spark.createDataFrame(rows, SCHEMA), 3).orderBy("life").collect()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("life").collect()
    assert [tuple(r)[:4] for r in got] == [tuple(r) for r in lives][:-1]  # the last one hasn't ended
    assert all(r["deleted_on"] == r["last_day"] + dt.timedelta(days=3) for r in got)


def admit(rows, seconds, most):
    """The plain loop: (decision of each try)."""
    known, used, out = set(), {}, {}
    for o, t, k in sorted(rows, key=lambda r: (r[1], r[0])):
        w = int(t.replace(tzinfo=dt.timezone.utc).timestamp()) // seconds
        if k is None:
            out[o] = "limited"
        elif k in known:
            out[o] = "exists"
        elif used.get(w, 0) < most:
            known.add(k)
            used[w] = used.get(w, 0) + 1
            out[o] = "new"
        else:
            out[o] = "limited"
    return out


@pytest.mark.parametrize("cuts", [[], [30, 31, 70]])
def test_admission_stream(spark, tmp_path, cuts):
    rows = events(random.Random(5), 90, [*range(25), None], 14_000_000)
    sink = admission.AdmissionSink(str(tmp_path / "list"), 60, 2)
    play(spark, rows, cuts, tmp_path, lambda s: s, lambda w: w.foreachBatch(sink).start())
    got = {r["ord"]: r["decision"] for r in sink.decided(spark).collect()}
    assert got == admit(rows, 60, 2) and {"new", "exists", "limited"} <= set(got.values())


def test_a_replayed_batch_admits_nobody_twice(spark, tmp_path):
    rows = events(random.Random(6), 40, list(range(20)), 14_000_000)
    sink = admission.AdmissionSink(str(tmp_path / "list"), 60, 2)
    parts = [spark.createDataFrame(rows[a:b], SCHEMA) for a, b in ((0, 15), (15, 30), (30, 40))]
    for batch, k in ((0, 0), (1, 1), (1, 1), (2, 2), (2, 2)):
        sink(parts[k], batch)
    got = sink.decided(spark).collect()
    assert len(got) == 40 and {r["ord"]: r["decision"] for r in got} == admit(rows, 60, 2)
    new = [r["key"] for r in got if r["decision"] == "new"]
    assert len(new) == len(set(new))
