"""Quotas, admissions and retention, for tables and for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: Requests of a client that each kind of call admits in a window, and the window's seconds.
GUARD_LIMITS = {"analyze": 10, "sample": 30, "waitlist": 5, "reports": 60, "refresh-auth": 10}
GUARD_SECONDS = 60


def guard(events: DataFrame, limits: dict[str, int] = GUARD_LIMITS, seconds: int = GUARD_SECONDS) -> DataFrame:
    """Adds most, admitted and used_before by the limit of the event's bucket; a bucket without a limit is never admitted. events: ord, ts, key, bucket."""
    most = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("bucket")]
    e = events.withColumn("_w", F.floor(F.unix_seconds("ts") / seconds))
    n = F.row_number().over(Window.partitionBy("bucket", "key", "_w").orderBy("ts", "ord"))
    e = e.withColumn("used_before", (n - 1).cast("bigint")).withColumn("most", most)
    return e.withColumn("admitted", F.coalesce(F.col("used_before") < F.col("most"), F.lit(False))).drop("_w")


def quota_tumbling(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """Adds window_start, admitted, used_before and reset_at: the first ``most`` of a key in each epoch-aligned window. events: ord, ts, key."""
    e = events.withColumn("_w", F.floor(F.unix_seconds("ts") / seconds) * seconds)
    n = F.row_number().over(Window.partitionBy("key", "_w").orderBy("ts", "ord"))
    e = e.withColumn("_n", n)
    return e.select(*events.columns, F.timestamp_seconds("_w").alias("window_start"), (F.col("_n") <= most).alias("admitted"), (F.col("_n") - 1).cast("bigint").alias("used_before"), F.timestamp_seconds(F.col("_w") + seconds).alias("reset_at"))


def quota_tumbling_counts(events: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """The stream's form: events of a key in each window, final once the watermark passes. ts must be a TIMESTAMP."""
    return events.withWatermark("ts", late).groupBy("key", F.window("ts", f"{seconds} seconds")).count()


def _open(start: int | None, used: int, at: int, width: int, most: int) -> tuple[int, int, bool, int, int]:
    """(start, used, admitted, remaining, reset_us) after an event at ``at`` in the window that began at ``start``."""
    if start is None or at - start >= width:
        start, used = at, 0
    used += 1
    return start, used, used <= most, max(0, most - used), start + width - at


def quota_anchored(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """Adds window_no, window_start, admitted, remaining and reset_ms: a key's window opens with an event, the next one with the first event ``seconds`` later.

    Null keys are one key; keys of any type stay whole. A running fold over a key's events in order: they are streamed through it
    in Arrow batches of sorted partitions, so no key is gathered in memory. No rows for an empty table. events: ord, ts, key.
    """
    columns, width = events.columns, seconds * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, number, used = object(), None, 0, 0
        for b in batches:
            out = []
            for k, t in zip(b.column("key").to_pylist(), b.column("_us").to_pylist(), strict=True):
                if k != key:
                    key, start, number = k, None, 0
                before = start
                start, used, ok, left, reset = _open(start, used, t, width, most)
                number += start != before
                out.append((number, start, ok, left, reset // 1000))
            more = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()), strict=True)] if out else None
            if more:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *more], [*columns, *_ADDED])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    sorted_ = events.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))).repartition("key").sortWithinPartitions("key", "_us", "ord")
    done = sorted_.mapInArrow(fold, f"{schema}, window_no bigint, _start bigint, admitted boolean, remaining bigint, reset_ms bigint")
    return done.select(*columns, "window_no", F.timestamp_micros("_start").alias("window_start"), "admitted", "remaining", "reset_ms")


_ADDED = ("window_no", "_start", "admitted", "remaining", "reset_ms")


class _Anchored(StatefulProcessor):
    """One value a key (start of its window, events in it) and a timer at the window's end, which clears it."""

    def __init__(self, seconds: int, most: int):
        self.width, self.most = seconds * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start bigint, used bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        start, used = self.window.get() if self.window.exists() else (None, 0)
        began = start
        for r in sorted(rows, key=lambda r: (r["_us"], r["ord"])):
            start, used, ok, left, reset = _open(start, used, r["_us"], self.width, self.most)
            yield Row(ord=r["ord"], ts=r["ts"], key=r["key"], _start=start, admitted=ok, remaining=left, reset_ms=reset // 1000)
        self.window.update((start, used))
        if start != began:
            if began is not None:
                self.handle.deleteTimer(self._end(began))
            self.handle.registerTimer(self._end(start))

    def _end(self, start: int) -> int:
        return -(-(start + self.width) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.window.exists() and self._end(self.window.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State of ``transformWithState`` lives in RocksDB, on disk beside the checkpoint, so keys needn't fit in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def quota_anchored_stream(events: DataFrame, seconds: int, most: int, late: str = "10 minutes") -> DataFrame:
    """``quota_anchored`` of a stream: (ord, ts, key, window_start, admitted, remaining, reset_ms), the rows of the batch form if events come in order.

    Events of a micro-batch count in the order of ts and ord. One that comes later than others of its key counts in the window
    that is open; one behind the watermark (``late`` behind the newest event) is dropped. A key's state goes when the watermark passes its
    window, so state is bounded by the keys of ``late`` and ``seconds``. ts must be a TIMESTAMP.
    """
    use_rocksdb(events.sparkSession)
    e = events.select("ord", "ts", "key", F.unix_micros("ts").alias("_us")).withWatermark("ts", late)
    kind = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = f"ord {kind['ord']}, ts timestamp, key {kind['key']}, _start bigint, admitted boolean, remaining bigint, reset_ms bigint"
    done = e.groupBy("key").transformWithState(_Anchored(seconds, most), schema, "Append", "EventTime")
    return done.select("ord", "ts", "key", F.timestamp_micros("_start").alias("window_start"), "admitted", "remaining", "reset_ms")


def retention_sessions(events: DataFrame, ttl_days: int) -> DataFrame:
    """(life, first_day, last_day, n_events) of the whole list: it ends when no event comes for ``ttl_days``; days are aggregated first."""
    d = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day")  # one row a day
    d = d.withColumn("new", F.coalesce((F.date_diff("day", F.lag("day").over(w)) >= ttl_days).cast("int"), F.lit(1)))
    d = d.withColumn("life", F.sum("new").over(w))
    return d.groupBy("life").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("n_events"))


class _Life(StatefulProcessor):
    """The whole list's life (first and last day, events) and a timer that every day re-arms; when it goes off the list is deleted."""

    def __init__(self, ttl_days: int):
        self.ttl = ttl_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "life bigint, first bigint, last bigint, n bigint")

    def _row(self, life, first, last, n) -> Row:
        return Row(life=life, first_day=first, last_day=last, n_events=n, deleted_on=last + self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        number, first, last, n = self.life.get() if self.life.exists() else (0, None, None, 0)
        armed = last
        for r in sorted(rows, key=lambda r: r["day"]):
            if first is None or r["day"] - last >= self.ttl:
                if first is not None:
                    yield self._row(number, first, last, n)
                number, first, last, n = number + 1, r["day"], r["day"], 0
            last, n = max(last, r["day"]), n + r["n"]
        self.life.update((number, first, last, n))
        if last != armed:
            if armed is not None:
                self.handle.deleteTimer((armed + self.ttl) * 86_400_000)
            self.handle.registerTimer((last + self.ttl) * 86_400_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        number, first, last, n = self.life.get()
        if first is not None and (last + self.ttl) * 86_400_000 <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._row(number, first, last, n)
            self.life.update((number, None, None, 0))  # only its number stays

    def close(self) -> None:
        pass


def retention_stream(events: DataFrame, ttl_days: int, late: str = "1 day") -> DataFrame:
    """``retention_sessions`` of a stream: (life, first_day, last_day, n_events, deleted_on) of each life of the list, given out when it ends.

    Days are counted first, by all tasks; a day is final when the watermark (``late`` behind the newest event) passes its end, and only
    one row a day comes to the list's state. Events behind the watermark are dropped: they re-arm nothing. ts must be a TIMESTAMP in UTC.
    """
    use_rocksdb(events.sparkSession)
    day = F.window("ts", "1 day")
    days = events.withWatermark("ts", late).groupBy(day.alias("w")).agg(F.count("*").alias("n"))
    days = days.select(F.window_time("w").alias("at"), F.unix_date(F.to_date("w.start")).cast("bigint").alias("day"), "n", F.lit(0).alias("list"))
    done = days.groupBy("list").transformWithState(_Life(ttl_days), "life bigint, first_day bigint, last_day bigint, n_events bigint, deleted_on bigint", "Append", "EventTime")
    date = lambda c: F.date_from_unix_date(F.col(c).cast("int")).alias(c)
    return done.select("life", date("first_day"), date("last_day"), "n_events", date("deleted_on"))
