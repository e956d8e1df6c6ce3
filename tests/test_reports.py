"""Admissions, page decoding and report rows."""

import random

from pyspark.sql import functions as F

from rankforge.operators import invariants, provenance, report
from rankforge.sources import pages, reports
from rankforge.streaming import admission, quota


def test_admission_equals_the_sequential_rule(spark):
    rng = random.Random(11)
    tries = sorted((rng.randrange(0, 600), k, f"k{rng.randrange(25)}") for k in range(160))
    known, used, want = {}, {}, {}
    for s, o, k in tries:
        if k in known:
            continue
        w = s // 60
        if used.get(w, 0) < 2:
            used[w] = used.get(w, 0) + 1
            known[k] = o
    want = {k: known.get(k) for _, _, k in tries}
    df = spark.createDataFrame([(o, s, k) for s, o, k in tries], "ord long, s long, key string").select("ord", F.timestamp_seconds("s").alias("ts"), "key")
    assert {r["key"]: r["admitted_ord"] for r in admission.admit_signups(df, 60, 2).collect()} == want
    assert admission.admit_signups(df.limit(0)).count() == 0


def test_pages_are_decoded_and_cut(spark):
    rows = [
        (1, "u", "é".encode("latin-1"), "text/html; charset=ISO-8859-1", None),
        (2, "u", b'<meta charset="cp1252">\x80', "text/html", None),
        (3, "u", "é".encode(), "application/xhtml+xml", None),
        (4, "u", b"x", "image/png", None),
        (5, "u", b"x", "text/html", pages.PAGE_CAP + 1),
        (6, "u", b"y" * (pages.PAGE_CAP + 5), "text/html; charset=nonsense", None),
        (7, "u", None, "text/html", None),
    ]
    got = {r["page_id"]: r for r in pages.read_pages(spark.createDataFrame(rows, "page_id int, url string, content binary, content_type string, declared_length int")).collect()}
    assert (got[1]["html"], got[2]["html"][-1], got[3]["html"]) == ("é", "€", "é")
    assert (got[4]["failure"], got[5]["failure"], got[4]["html"]) == ("not_html", "too_large", None)
    assert (len(got[6]["html"]), got[6]["html_bytes"]) == (pages.PAGE_CAP, pages.PAGE_CAP + 5) and got[7]["html"] is None


def test_words_of_numbers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    names = lambda *x: F.array(*[F.lit(v) for v in x])
    assert [one(report.list_names(names(*"abcde"[:n]))) for n in (1, 2, 3, 5)] == ["a", "a and b", "a, b and c", "a, b, c and 2 more"]
    assert one(report.metric(F.lit(3), " km", True)) == "+3 km" and one(report.metric(F.lit(None).cast("int"))) == "N/A"
    assert one(report.rank_text(F.lit(2), F.lit(True))) == "tied #2" and one(report.plural(F.lit(1), "page", "pages")) == "1 page"


def test_report_violations_find_one_broken_field(spark):
    good = (1, "a", False, True, False, 10, 10, 10, 10, 10, 50, 50, 40, 20, 50, True, 1)
    cols = "market_id int, id string, is_user boolean, available boolean, is_chain boolean, seo int, conversion int, trust int, content int, technical int, website_score int, local_presence int, momentum int, risk int, final_score int, scored boolean, rank int"
    other = (1, "b", True, True, False, 5, 5, 5, 5, 5, 25, 50, 40, 20, 35, True, 2)
    assert provenance.record_violations(spark.createDataFrame([good, other], cols)).count() == 0
    names = [c.split()[0] for c in cols.split(", ")]
    for field, value, rule in (("seo", 26, "seo_range"), ("website_score", 51, "website_sum"), ("final_score", 52, "final_arithmetic"), ("rank", None, "rank"), ("available", False, "unavailable_has_score")):
        bad = list(good)
        bad[names.index(field)] = value
        found = {r["rule"] for r in provenance.record_violations(spark.createDataFrame([tuple(bad), other], cols)).collect()}
        assert rule in found


def test_pool_and_sessions(spark):
    s = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2026-01-10'), (2, TIMESTAMP_NTZ'2026-01-01'), (3, TIMESTAMP_NTZ'2026-02-01') t(id, generated_at)")
    assert [(r["id"], r["pool"]) for r in reports.serving_pool(s, "2026-01-12").collect()] == [(1, "active")]
    assert {(r["id"], r["pool"]) for r in reports.serving_pool(s, "2026-01-20").collect()} == {(1, "retained"), (2, "retained")}
    h = reports.pool_health(s, s.select("id"), "2026-01-12").first()
    assert (h["active"], h["retained"], h["lacking"], h["newest_h"]) == (1, 2, 2, 48.0)
    e = spark.sql("SELECT TIMESTAMP'2026-01-01' + make_dt_interval(d) AS ts FROM VALUES (0), (1), (1), (11), (12), (22) t(d)")
    assert [(r["life"], r["n_events"]) for r in quota.retention_sessions(e, 10).orderBy("life").collect()] == [(1, 3), (2, 2), (3, 1)]


def test_stream_counts_equal_the_batch(spark, tmp_path):
    rows = spark.sql("SELECT id AS ord, timestamp_seconds(id * 37) AS ts, concat('k', cast(id % 3 AS string)) AS key FROM range(200)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = quota.quota_tumbling_counts(stream, 600).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["key"], r["window"]["start"]): r["count"] for r in spark.table("counts").collect()}
    want = {(r["key"], r["window_start"]): r["n"] for r in quota.quota_tumbling(rows, 600, 5).groupBy("key", "window_start").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_sound_reports_break_no_invariant(spark):
    e = spark.sql("SELECT 1 AS report_id, 2 AS schema_version, 'real-only' AS policy, false AS synthetic, CAST(null AS int) AS scoring_version, 1 AS n_sources, 90D AS lat, -180D AS lon, '2026-01-01T10:00:00Z' AS generated_at")
    assert invariants.envelope_violations(e).count() == 0
    bad = e.select("report_id", *[F.lit(None).cast(t).alias(c) for c, t in e.dtypes if c != "report_id"])
    assert {r["rule"] for r in invariants.envelope_violations(bad).collect()} == {"schema_version", "policy", "synthetic", "no_sources", "coordinates", "generated_at"}
    s = spark.sql("SELECT 1 AS report_id, 1 AS source_id, 'homepage' AS kind, 'p' AS provider, 't' AS title, '2026-01-01' AS accessed_at, 'used' AS status, 'HTTP://a.example' AS url")
    assert invariants.source_row_violations(s).count() == 0
    c = spark.sql("SELECT 1 AS report_id, * FROM VALUES ('a', true, array(1)), ('b', false, slice(array(1), 1, 0)), ('c', true, slice(array(1), 1, 0)), ('d', true, array(1, 1, 7, 8)), ('e', false, null) t(label, required, source_ids)")
    assert {(r["label"], r["rule"]) for r in invariants.citation_violations(c, s).collect()} == {("c", "empty"), ("d", "repeated"), ("d", "unknown"), ("e", "missing")}


def test_record_states_find_one_broken_field(spark):
    good = {"market_id": 1, "id": "a", "available": True, "is_chain": False, "skipped": False, "audit_status": "complete", "signal_status": "complete", "rank": 1, "tied": False, "word_count": 5, **{c: 50.0 for c in invariants.SCORES}}
    down = good | {"id": "b", "available": False, "skipped": True, "audit_status": "unavailable", "signal_status": "unavailable", "rank": None, "word_count": None, **{c: None for c in invariants.SCORES}}
    kinds = {bool: "boolean", str: "string", int: "int", float: "double"}
    schema = ", ".join(f"{c} {kinds[type(v)]}" for c, v in good.items())
    found = lambda *rows: {(r["id"], r["rule"]) for r in invariants.record_state_violations(spark.createDataFrame([tuple(r[c] for c in good) for r in rows], schema), ("word_count",)).collect()}
    assert found(good, down) == set() and found() == set()
    for change, rule in (({"risk": 101.0}, "risk_range"), ({"momentum": float("nan")}, "momentum_range"), ({"change": None}, "change_missing"), ({"is_chain": True}, "chain_scored"), ({"signal_status": None}, "audit_states"), ({"tied": True}, "tied")):
        assert found(good | change, down) == {("a", rule)}
    assert found(good, down | {"skipped": None, "word_count": 0}) == {("b", "not_skipped"), ("b", "word_count_observed")}
    assert found(good, good | {"id": "c"}) == {("a", "tied"), ("c", "tied")}


def test_summaries_must_follow_from_records(spark):
    rows = spark.sql("SELECT 1 AS market_id, * FROM VALUES ('a', 'A', true, true, false, 60, 60, 2, false, 'scored', 'complete'), ('b', 'B', false, true, false, 70, 71, 1, false, 'scored', 'partial'), ('c', 'C', false, false, false, null, null, null, false, 'failed:timeout', 'unavailable') t(id, name, is_user, scored, is_chain, website_score, final_score, rank, tied, outcome, audit_status)")
    said = spark.sql("SELECT 1 AS market_id, 2L AS competitors, 1L AS audited, 70L AS average_website, 71L AS average_final, 2 AS your_rank, false AS your_tied, -11L AS market_gap, 'recoverable' AS status, 1L AS failed, 1L AS limited, 0L AS chains, 1L AS scored, 0L AS no_website, 0L AS not_attempted, 1L AS audit_failed")
    assert invariants.summary_violations(said, rows).count() == 0
    rules = lambda s: {r["rule"] for r in invariants.summary_violations(s, rows).collect()}
    assert rules(said.withColumn("market_gap", F.lit(None).cast("long"))) == {"market_gap"}
    assert rules(said.withColumn("limited", F.lit(0)).withColumn("status", F.lit("leading"))) == {"limited", "status"}
    assert rules(said.limit(0)) == {"summary_missing"}
