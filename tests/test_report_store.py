"""The versioned report store and the walk through nested reports."""

import datetime as dt
import json

import pytest

from rankforge.operators import nested
from rankforge.sources.report_store import ReportStore

DAY = dt.datetime(2026, 3, 1, 12)


def report(k, days=0, **more):
    at = DAY - dt.timedelta(days=days)
    return (f"r{k}", at, json.dumps({"version": 2, "id": f"r{k}", "createdAt": at.isoformat() + "Z", **more}))


def frame(spark, rows):
    return spark.createDataFrame(rows, "report_id string, created_at timestamp, payload string")


def ids(store, version=None):
    return sorted(r["report_id"] for r in store.read(version).collect())


def test_versions_are_whole(spark, tmp_path):
    store = ReportStore(spark, str(tmp_path / "store"))
    assert store.versions() == [] and ids(store) == []
    assert store.save(frame(spark, [report(1), report(2, 5)])) == 1
    commit = store.write(frame(spark, [report(3), report(4, 40)]))  # a crash here leaves the version before
    assert ids(ReportStore(spark, str(tmp_path / "store"))) == ["r1", "r2"]
    assert store.publish(commit) == 2 and ids(store) == ["r1", "r2", "r3", "r4"] and ids(store, 1) == ["r1", "r2"]
    assert {r["status"] for r in store.read().collect()} == {"ok"}
    assert store.save(frame(spark, [])) == 3 and len(ids(store)) == 4


@pytest.mark.parametrize("bad", [("r9", DAY, None), ("r9", DAY, "{"), ("r9", None, report(9)[2]), ("r9", DAY, report(8)[2]), ("r9", DAY, '{"old":1}'), report(9, report={"competitors": [{"x": {"usedMockData": False}}]})])
def test_invalid_reports_are_not_stored(spark, tmp_path, bad):
    store = ReportStore(spark, str(tmp_path / "store"))
    store.save(frame(spark, [report(1)]))
    with pytest.raises(ValueError, match="r9"):
        store.save(frame(spark, [report(2), bad]))
    assert ids(store) == ["r1"] and store.versions() == [1]
    assert len(list((tmp_path / "store/data").iterdir())) == 1


@pytest.mark.parametrize("days,kept", [(90, ["r0", "r29", "r30", "r31", "r89"]), (30, ["r0", "r29"])])
def test_retention_drops_whole_days(spark, tmp_path, days, kept):
    store = ReportStore(spark, str(tmp_path / "store"), days)
    store.save(frame(spark, [report(k, k) for k in (0, 29, 30, 31, 89, 90, 91)]))
    assert store.expire(DAY.date()) == 2
    assert ids(store) == sorted(kept) and len(ids(store, 1)) == 7
    assert len(store.vacuum()) == 7 - len(kept) and store.versions() == [2] and ids(store) == sorted(kept)


def test_forbidden_fields_at_any_depth(spark):
    rows = [
        ("a", '{"x":{"y":[1,{"demoMode":null},[{"z":{"Uplifted":3}}]]},"note":"a demo of demoMode"}'),
        ("b", '{"sources":[{"provider":"Mock maps"},{"provider":"maps"},{"source":3}],"policy":"SYNTHETIC","title":"mock"}'),
        ("c", '{"policy":{"source":["demo"]},"usedmockdata":1}'),
        ("d", None), ("e", "{broken"), ("f", "[]"), ("g", "7"), ("h", '[{"usedMockData":{}}]'),
    ]
    got = {tuple(r) for r in nested.synthetic_fields(spark.createDataFrame(rows, "report_id string, payload string")).collect()}
    assert got == {
        ("a", "response.x.y[1].demoMode", "forbidden_field"), ("a", "response.x.y[2][0].z.Uplifted", "forbidden_field"),
        ("b", "response.sources[0].provider", "synthetic_source"), ("b", "response.policy", "synthetic_source"), ("h", "response[0].usedMockData", "forbidden_field"),
    }
