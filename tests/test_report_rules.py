"""A sound nested report, and the same with one thing broken at a time."""

import copy
import json

import pytest

from rankforge.operators import report_rules
from rankforge.operators.scoring import CATEGORIES


def audit(status, scores=None):
    out = dict.fromkeys(report_rules.AUDIT_NAMES.values())
    out |= {"auditStatus": status, "skipped": status == "unavailable", "sourceIds": ["S2"] if status != "unavailable" else [], "scoreBreakdown": dict.fromkeys(c for c, _ in CATEGORIES), "evidence": []}
    if scores:
        out |= {"scoreBreakdown": dict(zip((c for c, _ in CATEGORIES), scores, strict=True)), "websiteScore": sum(scores), "h1Count": 1, "isHttps": True, "evidence": [{"sourceIds": ["S2"]}]}
    return out


def record(name, status="complete", final=None, rank=None, tied=False, scores=None, **more):
    signals = {"auditStatus": status, "sourceIds": ["S2"] if scores else [], "momentumScore": 40 if scores else None, "riskScore": 20 if scores else None, "changeScore": 0 if scores else None, "newsSignals": [{"sourceIds": ["S3"]}] if scores else []}
    return {"id": name, "auditStatus": status, "sourceIds": ["S1"], "websiteAudit": audit(status, scores), "signals": signals, "categoryMatchScore": 90, "localPresenceScore": 50, "finalScore": final, "rank": rank, "rankTied": tied, **more}


@pytest.fixture(scope="module")
def sound(spark):
    from pyspark.sql import functions as F

    from rankforge.operators.scoring import final_score

    most = [m for _, m in CATEGORIES]
    n = lambda x: F.lit(float(x))
    final = spark.range(1).select(final_score(n(sum(most)), n(50), n(40), n(20)).alias("f")).first()["f"]
    source = lambda k, kind, url: {"id": f"S{k}", "kind": kind, "provider": "p", "title": f"t{k}", "accessedAt": "2026-03-01T00:00:00Z", "status": "used", **({"url": url} if url else {})}
    report = {
        "schemaVersion": 2,
        "provenance": {"policy": "real-only", "containsSyntheticData": False, "sources": [source(1, "openstreetmap", None), source(2, "homepage", "https://a.example/x"), source(3, "news_article", "https://n.example/")]},
        "market": {"lat": 37.5, "lon": -122.0, "sourceIds": ["S1"]},
        "summary": {"scoringVersion": 2, "competitorCount": 3, "yourRankTied": True},
        "user": record("u", final=final, rank=1, tied=True, scores=most),
        "competitors": [record("a", final=final, rank=1, tied=True, scores=most), record("b", "unavailable"), record("c", scores=most, isChain=True)],
        "report": {"topFindings": [{"title": "x", "sourceIds": ["S2"]}], "topRisks": [], "competitorHighlights": [], "actionPlan": [{"title": "y", "sourceIds": ["S1", "S3"]}]},
        "recommendations": [{"title": "z", "sourceIds": ["S2"]}],
    }
    return {"schemaVersion": 2, "id": "r0", "createdAt": "2026-03-01T00:00:00Z", "report": report}


def put(path, value):
    def change(doc):
        for k in path[:-1]:
            doc = doc[k]
        if value is None and isinstance(doc, dict) and path[-1] not in doc:
            raise KeyError(path[-1])
        doc[path[-1]] = value

    return change


R, P, U, C = ["report"], ["report", "provenance"], ["report", "user"], ["report", "competitors"]
BROKEN = {
    "schema_version": put([*R, "schemaVersion"], 3),
    "policy": put([*P, "policy"], "mixed"),
    "synthetic": put([*P, "containsSyntheticData"], "no"),
    "coordinates": put([*R, "market", "lat"], 91),
    "scoring_version": put([*R, "summary", "scoringVersion"], 3),
    "competitor_count": put([*R, "summary", "competitorCount"], 4),
    "your_tied": put([*R, "summary", "yourRankTied"], False),
    "provider": put([*P, "sources", 0, "provider"], " "),
    "kind": put([*P, "sources", 0, "kind"], "guess"),
    "accessed_at": put([*P, "sources", 0, "accessedAt"], "soon"),
    "url_missing": put([*P, "sources", 1, "url"], ""),
    "url_scheme": put([*P, "sources", 1, "url"], "ftp://a"),
    "url_twice": put([*P, "sources", 2, "url"], "https://A.example/x/#top"),
    "not_sequential": put([*P, "sources", 2, "id"], "S4"),
    "unknown": put([*R, "report", "topFindings", 0, "sourceIds"], ["S9"]),
    "empty": put([*R, "recommendations", 0, "sourceIds"], []),
    "missing": put([*U, "signals", "newsSignals", 0, "sourceIds"], None),
    "repeated": put([*U, "sourceIds"], ["S1", "S1"]),
    "local_presence_range": put([*C, 0, "localPresenceScore"], 101),
    "momentum_missing": put([*C, 0, "signals", "momentumScore"], None),
    "h1_count_observed": put([*C, 1, "websiteAudit", "h1Count"], 0),
    "chain_scored": put([*C, 2, "rank"], 1),
    "unavailable_ranked": put([*C, 1, "rank"], 2),
    "not_skipped": put([*C, 1, "websiteAudit", "skipped"], False),
    "audit_states": put([*C, 0, "websiteAudit", "auditStatus"], "partial"),
    "tied": put([*C, 0, "rankTied"], False),
    "website_sum": put([*C, 0, "websiteAudit", "scoreBreakdown", CATEGORIES[0][0]], 1),
    "final_arithmetic": put([*C, 0, "finalScore"], 1),
    "rank": put([*C, 0, "rank"], 2),
    "forbidden_field": put([*U, "upliftEstimate"], 3),
    "synthetic_source": put([*P, "sources", 0, "provider"], "Demo maps"),
}


def test_each_broken_rule_makes_a_report_invalid(spark, sound):
    rows = [("r0", json.dumps(sound)), ("none", None), ("old", '{"report":{}}'), ("bad", "{")]
    for name, change in BROKEN.items():
        doc = copy.deepcopy(sound)
        doc["id"] = name
        change(doc)
        rows.append((name, json.dumps(doc)))
    rows.append(("other id", json.dumps(sound)))
    got = {r["report_id"]: (r["status"], r["rules"]) for r in report_rules.checked_status(spark.createDataFrame(rows, report_rules.REPORT_TEXT)).collect()}
    assert got["r0"] == ("ok", []) and got["none"][0] == "missing" and got["old"][0] == got["bad"][0] == "legacy" and got["other id"][0] == "invalid"
    assert {name: got[name] for name in BROKEN if got[name][0] != "invalid" or name not in got[name][1]} == {}


def test_what_the_text_alone_rules_out(spark):
    """Whatever synthetic_fields finds is suspect, escapes and spaces included; reports without such words are never opened."""
    from pyspark.sql import functions as F

    from rankforge.operators import nested

    broken = ['{"a": [{"Uplift_by": 1}]}', '{"demoMode": null}', '{"provider" :\n "big \\"Demo\\" x"}', '{"policy": "sYnthetic"}', '{"d\\u0065moMode": 1}', '{"source": "m\\u006fck"}', '{"sourceType": "a, \\\\ mock"}', '{"provider": "x", "provider2": {"provider": "mock"}}']
    sound = ['{"containsSyntheticData": false, "policy": "real-only", "title": "a mock demo"}', '{"provider": "x", "note": "synthetic"}', "{", None, '"demo"']
    rows = spark.createDataFrame(list(enumerate([*broken, *sound])), "report_id int, payload string")
    assert {r["report_id"] for r in nested.synthetic_fields(rows).collect()} == set(range(len(broken)))
    assert [bool(r[0]) for r in rows.orderBy("report_id").select(nested.suspect(F.col("payload"))).collect()] == [True] * len(broken) + [False] * len(sound)


def test_one_pass_over_payloads(spark, sound):
    """Sources and cited ids of a report come with it, so no join and one parse; ids that are null or of another report are unknown."""
    docs = [copy.deepcopy(sound) for _ in range(3)]
    docs[1]["report"]["market"]["sourceIds"] = ["S1", None]
    docs[2]["report"]["provenance"]["sources"] = docs[2]["report"]["provenance"]["sources"][:1]
    rows = [(f"r{k}", json.dumps(d)) for k, d in enumerate(docs)]
    df = spark.createDataFrame(rows, report_rules.REPORT_TEXT)
    found = report_rules.report_rules(df)
    got = {(r["report_id"], r["part"]) for r in found.collect() if r["rule"] == "unknown"}
    assert ("r1", "market") in got and ("r2", "recommendations") in got and not any(i == "r0" or (i, p) == ("r2", "market") for i, p in got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "parse_json" not in plan
