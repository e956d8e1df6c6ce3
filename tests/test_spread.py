"""Joins that keep hot keys apart: against brute force over all pairs, and on their plans."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from rankforge.functions import urls
from rankforge.operators import audit, domains, entity, market


def fits(rule, path):
    """Backtracking over every place of every star."""
    if rule == "":
        return True
    if rule == "$":
        return path == ""
    if rule[0] == "*":
        return any(fits(rule[1:], path[k:]) for k in range(len(path) + 1))
    return path[:1] == rule[0] and fits(rule[1:], path[1:])


def test_robots_against_backtracking(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab/") for _ in range(rng.randint(0, n)))
    rules = {(h, "/" + "*".join(word(3) for _ in range(rng.randint(1, 4))) + rng.choice(["", "$"])) for h in "xyz" for _ in range(25)}
    rules |= {("x", "*ab"), ("x", "/"), ("y", "/a*$"), ("y", "/**b")}
    rows = [(h, rng.random() < 0.5, r) for h, r in sorted(rules)] + [("x", True, "/ab"), ("x", False, "/ab")]
    paths = [(k, rng.choice(["x", "x", "y", "z", "none", None]), rng.choice([None, "", "/" + word(8)])) for k in range(400)]
    got = audit.robots_allowed(spark.createDataFrame(paths, "id int, host string, path string"), spark.createDataFrame(rows, "host string, allow boolean, rule string"))
    want = {}
    for k, host, path in paths:
        hits = [(len(r), a) for h, a, r in rows if h == host and fits(r, path or "/")]
        want[k] = max(hits)[1] if hits else True
    assert {r["id"]: r["allowed"] for r in got.collect()} == want and len(set(want.values())) == 2


def test_robots_without_rules_and_long_paths(spark):
    none = spark.createDataFrame([], "host string, allow boolean, rule string")
    u = spark.createDataFrame([(1, "h", "/" + "a" * 100_000 + "b", "x"), (2, "h", "/b", "y")], "id int, host string, path string, head string")
    assert {r["allowed"] for r in audit.robots_allowed(u, none).collect()} == {True}
    stars = spark.createDataFrame([("h", False, "/" + "*a" * 16 + "$"), ("h", False, "/" + "*a" * 16 + "*b$")], "host string, allow boolean, rule string")
    assert [(r["id"], r["allowed"], r["head"]) for r in audit.robots_allowed(u, stars).orderBy("id").collect()] == [(1, False, "x"), (2, True, "y")]
    assert audit.robots_allowed(u.limit(0), stars).count() == 0
    plan = audit.robots_allowed(u, stars)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_asof_against_all_pairs(spark):
    rng, start = random.Random(7), dt.datetime(2026, 1, 1)
    at = lambda: start + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 60))
    requests = [(k, rng.choice(["hot", "hot", "a", "b", None]), rng.choice([at(), at(), at(), None]), rng.random() < 0.5) for k in range(300)]
    saved = [(rng.choice(["hot", "a", None]), rng.choice([at(), at(), None])) for _ in range(40)]
    requests += [(300 + k, key, s, True) for k, (key, s) in enumerate(saved)]  # exactly then
    requests += [(400 + k, key, s + dt.timedelta(hours=336), True) for k, (key, s) in enumerate(saved) if s]  # just not too old
    requests += [(500 + k, key, s + dt.timedelta(hours=336, microseconds=1), True) for k, (key, s) in enumerate(saved) if s]
    r = spark.createDataFrame(requests, "id int, key string, as_of timestamp, live_failed boolean")
    s = spark.createDataFrame(saved + saved[:5], "key string, saved_at timestamp")
    want = {}
    for k, key, as_of, failed in requests:
        ages = [as_of - x for y, x in saved if key is not None and y == key and x is not None and as_of is not None and x <= as_of]
        age = min(ages) if ages and min(ages) <= dt.timedelta(hours=336) else None
        state = "none" if age is None else "fresh" if age <= dt.timedelta(hours=72) else "stale" if failed else "none"
        want[k] = (state, as_of - age if state != "none" else None)
    for hours in (1, 6, 1000):
        got = entity.asof_snapshot(r, s, slice_hours=hours).collect()
        assert len(got) == len(requests) and {x["id"]: (x["state"], x["snapshot_at"]) for x in got} == want
    assert {x["state"] for x in entity.asof_snapshot(r, s.limit(0)).collect()} == {"none"} and entity.asof_snapshot(r.limit(0), s).count() == 0
    assert "Join" not in entity.asof_snapshot(r, s)._jdf.queryExecution().executedPlan().toString()


RANKED = "market_id int, id string, name string, is_user boolean, is_chain boolean, available boolean, final_score int, rank int, tied boolean"


def test_one_market_is_ranked_without_a_window(spark):
    rng = random.Random(11)
    rows = [(1, str(k), "n", False, rng.random() < 0.1, rng.random() < 0.9, rng.choice([None, *range(101)])) for k in range(3000)] + [(None, "x", "n", False, False, True, 5), (2, "y", "n", False, False, True, 5)]
    df = spark.createDataFrame(rows, RANKED.split(", rank")[0])
    ranked = market.competition_rank(df)
    scores = [r[6] for r in rows if r[0] == 1 and not r[4] and r[5] and r[6] is not None]
    for x in ranked.collect():
        counts = x["market_id"] == 1 and x["scored"]
        assert x["rank"] == (1 + sum(s > x["final_score"] for s in scores) if counts else None)
        assert x["tied"] == (counts and scores.count(x["final_score"]) > 1)
    assert "Window" not in ranked._jdf.queryExecution().executedPlan().toString()


def metres(a, b):
    (la, lo), (lb, lp) = [tuple(map(math.radians, p)) for p in (a, b)]
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("lat", [0.0, 37.0, -60.0, 89.9, 89.9999, -90.0])
def test_near_pairs_everywhere(spark, lat):
    rng = random.Random(3)
    wide = min(180.0, 0.004 / max(1e-9, math.cos(math.radians(lat))))
    points = []
    for k in range(120):
        la = max(-90.0, min(90.0, lat + rng.uniform(-0.004, 0.004)))
        lo = rng.choice([0.0, 180.0]) + rng.uniform(-wide, wide)
        points.append((1, f"{k:03d}", "joe", la, lo - 360 if lo > 180 else lo))
    c = spark.createDataFrame([*points, (2, "zzz", "joe", lat, 0.0), (1, "yyy", "joe", None, 0.0), (1, "xxx", None, lat, 0.0), (1, "www", "joe", float("nan"), 0.0)], "market_id int, id string, name_key string, lat double, lon double")
    want = {(a[1], b[1]) for a in points for b in points if a[1] < b[1] and metres(a[3:], b[3:]) <= 150}
    got = [(r["a"], r["b"]) for r in entity.near_pairs(c, "name_key", 150.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_a_name_all_over_the_map(spark):
    """10^5 equal names 1 km apart: as many groups, no pair."""
    c = spark.range(100_000).select(F.lit(1).alias("market_id"), F.format_string("%06d", "id").alias("id"), F.lit("joe").alias("name_key"), (30 + F.floor(F.col("id") / 316) * 0.009).alias("lat"), (F.col("id") % 316 * 0.0105).alias("lon"))
    assert entity.near_pairs(c, "name_key", 150.0).count() == 0


def test_links_connect_what_pairs_do(spark):
    """As many links as rows, where pairs grow with the square; the same groups survive as by a walk over all pairs."""
    rng = random.Random(5)
    rows = [(1, f"{k:04d}", "joe", "x", None, None, None, None, float(k % 7)) for k in range(400)]
    for k in range(400, 1000):
        place = rng.choice([(None, None), (float("nan"), 0.0), (37 + rng.randrange(6) * 0.0012, rng.randrange(6) * 0.0014), (37 + rng.uniform(0, 0.01), rng.uniform(0, 0.01))])
        pick = lambda n: rng.choice([None, *map(str, range(n))])
        rows.append((rng.randrange(1, 3), f"{k:04d}", pick(6), pick(40), pick(60), pick(60), *place, float(rng.randrange(5))))
    c = spark.createDataFrame(rows, "market_id int, id string, name_key string, address_key string, site_key string, phone_key string, lat double, lon double, priority_score double")
    links, pairs = entity.business_links(c).collect(), entity.same_business_pairs(c).collect()

    def groups(edges):
        of = {(r[0], r[1]): {(r[0], r[1])} for r in rows}
        for e in edges:
            a, b = of[e["market_id"], e["a"]], of[e["market_id"], e["b"]]
            if a is not b:
                a |= b
                of.update(dict.fromkeys(b, a))
        return {frozenset(g) for g in of.values()}

    want = groups(pairs)
    assert groups(links) == want and 10 < len(want) < 900
    assert len(pairs) > 79_800 and len(links) < 3000
    score = {(r[0], r[1]): (-r[-1], r[1]) for r in rows}
    assert {(r["market_id"], r["id"]) for r in entity.dedupe_businesses(c, entity.business_links(c)).collect()} == {min(g, key=score.get) for g in want}


def test_registrable_domains(spark):
    rules = spark.createDataFrame([(r,) for r in ("com", "CO.uk", "*.ck", "!www2.ck", "ck", "a.b.example", None, "co.uk")], "rule string")
    hosts = ["shop.Example.co.uk", "www.example.co.uk", "co.uk", "x.y.ck", "p.x.y.ck", "ck", "www2.ck", "p.www2.ck", "t.a.b.example", "u.t.a.b.example", "b.example", "one.two.com.sg", "localhost", "", "x.com.", None, "x.com."]
    got = {r["host"]: r["root"] for r in domains.registrable_domains(spark.createDataFrame([(h,) for h in hosts], "host string"), rules).collect()}
    assert got == {
        "shop.Example.co.uk": "example.co.uk", "www.example.co.uk": "example.co.uk", "co.uk": "co.uk", "x.y.ck": "x.y.ck", "p.x.y.ck": "x.y.ck", "ck": "ck",
        "www2.ck": "www2.ck", "p.www2.ck": "www2.ck", "t.a.b.example": "t.a.b.example", "u.t.a.b.example": "t.a.b.example", "b.example": "b.example",
        "one.two.com.sg": "two.com.sg", "localhost": "localhost", "": "", "x.com.": "x.com",
    }


def test_default_suffixes_agree_with_the_column(spark):
    hosts = spark.createDataFrame([(f"{p}{s}",) for s in (*urls.TWO_LABEL_SUFFIXES, "com", "com.sg", "ne.jp", "xyz.de", "nom.museum") for p in ("", "a.", "b.a.", "www.c.")], "host string")
    r = domains.registrable_domains(hosts, domains.default_suffixes(spark)).withColumn("want", urls.domain_root(F.col("host")))
    assert r.where("NOT root <=> want").count() == 0 and r.count() == 72


def test_shared_hosts(spark):
    u = spark.createDataFrame([("https://m.facebook.com/Joe/?id=5#x",), ("https://facebook.com/?id=5",), ("http://joe.square.site/menu",), ("https://sites.google.com/view/x/",), ("https://notfacebook.com/joe",), ("https://x.com",), ("mailto:a",), (None,)], "u string")
    assert [r[0] for r in u.select(urls.site_identity(F.col("u"))).collect()] == ["facebook.com/joe?id=5", None, "joe.square.site", "sites.google.com/view/x", "notfacebook.com", None, None, None]


def test_request_bodies(spark):
    from rankforge.operators import resolve

    good = '{"businessName": "A\\tb", "businessUrl": " https://a.example ", "businessType": "cafe", "market": "Town, UK"%s}'
    bodies = [good % "", good % ', "z": 1, "y": {"businessName": 2}', "[]", "null", "{", None, "{}", '{"businessName": 5, "businessUrl": null, "businessType": [], "market": "Town"}', good % ', "market": "T, UK"']
    r = resolve.validate_requests(resolve.read_requests(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"))).orderBy("id").collect()
    absent = [f"{f}:not_text" for f in ("business_name", "business_url", "business_type", "market")]
    assert [x["form_errors"] for x in r] == [[], ["unknown:y", "unknown:z"], *[["body:not_object"]] * 4, absent, absent[:3], ["body:not_object"]]
    assert (r[0]["business_name"], r[0]["business_url"], r[0]["violations"], r[0]["message"]) == ("Ab", "https://a.example", [], None)
    assert r[1]["message"] == "invalid" and r[6]["violations"] == absent and r[7]["violations"] == [*absent[:3], "market:no_region"] and r[7]["message"] == "market:no_region"
    assert {(*x["violations"], x["message"]) for x in r if "body:not_object" in x["form_errors"]} == {("body:not_object", "invalid")}
