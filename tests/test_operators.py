"""Boundary cases of single operators, on rows made by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from rankforge.functions import scalars, urls
from rankforge.operators import audit, entity, market, provenance, report, resolve, scoring, signals, spatial
from rankforge.sources import poi, reports
from rankforge.streaming import quota


def one(spark, column, **values):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_half_up(spark):
    got = [one(spark, scalars.half_up(F.lit(x))) for x in (-2.5, 2.5, -0.3, 0.5)]
    assert got == [-2, 3, 0, 1]
    assert one(spark, scalars.half_up(F.lit(1.25), 1)) == 1.3


@pytest.mark.parametrize(("inputs", "want"), [((True, False, None, None, None), 60), ((True, False, True, True, 0.75), 78), ((None,) * 5, None), ((True, None, None, None, float("nan")), 100)])
def test_local_presence(spark, inputs, want):
    cols = [F.lit(x).cast("double" if k == 4 else "boolean") for k, x in enumerate(inputs)]
    assert one(spark, scoring.local_presence(*cols)) == want


def test_scores(spark):
    m = lambda count: scoring.momentum_score(F.lit(0), F.lit(0), F.lit(0), F.lit(1), F.lit(0), F.lit(count), F.lit(True))
    assert (one(spark, m(False)), one(spark, m(True))) == (5, 4)
    assert one(spark, scoring.final_score(F.lit(50), F.lit(50), F.lit(0), F.lit(0))) == 45
    assert one(spark, scoring.final_score(F.lit(50), F.lit(None).cast("int"), F.lit(0), F.lit(0))) is None
    assert one(spark, scoring.position_status(F.lit(2), F.lit(-0.5))) == "recoverable"


def test_category_match(spark):
    pairs = F.array(F.struct(F.lit("shop").alias("key"), F.lit("bakery").alias("value")))
    tags = lambda v: F.create_map(F.lit("shop"), F.lit(v), F.lit("name"), F.lit("Corner Bread"))
    assert one(spark, scoring.category_match(tags("deli; Bakery"), pairs, F.lit("bread shop"))) == 1.0
    assert one(spark, scoring.category_match(tags("bakery"), pairs, F.lit("xyz"))) == 0.5
    assert one(spark, scoring.category_match(tags("deli"), pairs, F.lit("bread"))) == 0.0
    assert one(spark, scoring.category_match(F.lit(None).cast("map<string,string>"), pairs, F.lit("bread"))) is None


RECORD = "market_id int, id string, name string, is_user boolean, is_chain boolean, available boolean, final_score int, website_score int, ord int"


def test_competition_rank(spark):
    rows = [(1, "u", "U", True, False, True, 68, 1, 0), (1, "a", "A", False, False, True, 68, 1, 1), (1, "b", "B", False, False, True, 80, 1, 2), (1, "c", "C", False, True, True, 99, 1, 3), (1, "d", "D", False, False, False, None, None, 4), (2, "u", "U", True, False, True, 50, 1, 0)]
    r = market.display_order(market.competition_rank(spark.createDataFrame(rows, RECORD)))
    got = {(x["market_id"], x["id"]): (x["rank"], x["tied"], x["place"]) for x in r.collect()}
    assert got == {(1, "b"): (1, False, 1), (1, "u"): (2, True, 2), (1, "a"): (2, True, 3), (1, "c"): (None, False, 4), (1, "d"): (None, False, 5), (2, "u"): (None, False, 1)}


def test_summary_gap_shows_zero_but_is_behind(spark):
    rows = [(1, "u", "U", True, False, True, 70, 1, 0), (1, "a", "A", False, False, True, 71, 1, 1), (1, "b", "B", False, False, True, 70, 1, 2)]
    s = market.market_summary(market.competition_rank(spark.createDataFrame(rows, RECORD))).first()
    assert (s["market_gap"], s["status"], s["average_final"], s["strongest"]) == (0, "recoverable", 71, "A")


def test_radius(spark):
    b = spark.createDataFrame([(1, None, None, None, None), (2, 1.0, 1.001, 1.0, 1.001), (3, 1.0, 3.0, 1.0, 3.0)], "market_id int, south double, north double, west double, east double")
    assert {r["market_id"]: r["radius_km"] for r in spatial.market_radius(b).collect()} == {1: 8.0, 2: 2.0, 3: 12.0}


def test_radius_join_edges(spark):
    m = spark.createDataFrame([(1, 0.0, 0.0, 5.0)], "market_id int, lat double, lon double, radius_km double")
    p = spark.createDataFrame([("in", 0.0, 0.0449), ("edge", 0.04496, 0.0), ("out", 0.0, 0.0451)], "id string, lat double, lon double")
    assert {r["id"] for r in spatial.radius_join(m, p, 1).collect()} == {"in", "edge"}
    assert {r["id"] for r in spatial.radius_join(m, p, 0).collect()} <= {"in", "edge"}


CAND = "market_id int, id string, name_key string, address_key string, site_key string, phone_key string, lat double, lon double, priority_score double"


def test_dedupe(spark):
    rows = [
        (1, "a", "joe", None, None, None, 0.0, 0.0, 1.0), (1, "b", "joe", None, "s", None, 0.0, 0.001, 2.0), (1, "c", "zed", None, "s", None, 0.0, 0.002, 2.0),
        (1, "d", "joe", None, None, None, 0.0, 0.02, 9.0), (1, "e", "pat", "x", None, None, None, None, 1.0), (1, "f", "pat", "x", None, None, None, None, 1.0),
        (2, "a", "joe", None, None, None, 0.0, 0.0, 1.0), (1, "g", "moe", None, None, "9", None, None, 1.0), (1, "h", "ned", None, None, "9", None, None, 1.0),
    ]
    c = spark.createDataFrame(rows, CAND)
    pairs = entity.same_business_pairs(c)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {("a", "b"), ("b", "c"), ("e", "f")}
    assert {(r["market_id"], r["id"]) for r in entity.dedupe_businesses(c, pairs).collect()} == {(1, "b"), (1, "d"), (1, "e"), (2, "a"), (1, "g"), (1, "h")}


def test_self_and_chains(spark):
    c = spark.createDataFrame([(1, "a", "x", "x", "s1", 2.0), (1, "b", "y", "joe", "s2", 1.0), (1, "c", "z", "z", None, 3.0)], "market_id int, id string, name_key string, name_segment string, site_key string, distance_km double")
    u = spark.createDataFrame([(1, "joe", "s1")], "market_id int, user_name_key string, user_site string")
    rest, best = entity.exclude_self(c, u)
    assert [r["id"] for r in rest.collect()] == ["c"] and [(r["id"], r["match"]) for r in best.collect()] == [("a", "site")]
    ch = spark.createDataFrame([(1, "a", "A", "r", None), (1, "b", "B", "r", None), (1, "c", "C", None, None), (1, "d", "D", None, "Big"), (2, "e", "E", "r", None)], "market_id int, id string, name string, domain_root string, brand string")
    assert {r["id"]: r["brand"] for r in entity.flag_chains(ch).where("is_chain").collect()} == {"a": "A", "b": "B", "d": "Big"}


def test_asof(spark):
    r = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ'2026-01-10', true), ('b', TIMESTAMP_NTZ'2026-01-10', true), ('c', TIMESTAMP_NTZ'2026-01-10', false), ('d', TIMESTAMP_NTZ'2026-01-10', true) t(key, as_of, live_failed)")
    s = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ'2026-01-07'), ('a', TIMESTAMP_NTZ'2026-01-11'), ('b', TIMESTAMP_NTZ'2026-01-01'), ('c', TIMESTAMP_NTZ'2026-01-01'), ('d', TIMESTAMP_NTZ'2025-12-01') t(key, saved_at)")
    assert {x["key"]: x["state"] for x in entity.asof_snapshot(r, s).collect()} == {"a": "fresh", "b": "stale", "c": "none", "d": "none"}


def test_industry(spark):
    m = spark.createDataFrame([("coffee shop", 0, "amenity", "cafe"), ("shop", 0, "shop", "yes"), ("dead", 0, None, None), ("big coffee shop", 0, "x", "y")], "keyword string, ord int, key string, value string")
    r = spark.createDataFrame([(1, "Coffee Shop"), (2, "the big coffee shop"), (3, "dead shop"), (4, "shop dead"), (5, "odd thing"), (6, "")], "request_id int, business_type string")
    got = {x["request_id"]: (x["stage"], x["keyword"], len(x["tags"])) for x in resolve.resolve_industry(r, m).collect()}
    assert got == {1: ("map", "coffee shop", 1), 2: ("map", "big coffee shop", 1), 3: ("map", "shop", 1), 4: ("none", "dead", 0), 5: ("probe", None, 18), 6: ("none", None, 0)}


def test_industry_broadcasts_the_map_only(spark, monkeypatch):
    m = spark.createDataFrame([("shop", 0, "shop", "yes")], "keyword string, ord int, key string, value string")
    r = spark.range(2000).selectExpr("id AS request_id", "concat('odd thing ', id, if(id % 2 = 0, ' shop', '')) AS business_type")
    for most, sent in ((1, 1), (0, 0)):
        monkeypatch.setattr(resolve, "MOST_SENT", most)
        got = resolve.resolve_industry(r, m)
        rows = got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert (plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")) == (sent, 2 - sent)
        assert ("BroadcastExchange" in plan) == bool(sent) and "BuildLeft" not in plan
        assert sorted(x["stage"] for x in rows) == ["map"] * 1000 + ["probe"] * 1000


def test_requests(spark):
    r = spark.createDataFrame([("Joe's", " HTTPS://u:p@joe.example:80/a b ", "cafe", "Town, , CA"), ("A\tb", "joe.example", "ca\x00fe", "Town, C"), ("<>", "ftp://x", "c" * 90, "Town")], "business_name string, business_url string, business_type string, market string")
    got = [x["violations"] for x in resolve.validate_requests(r).collect()]
    assert got == [[], ["business_url:not_http", "market:no_region"], ["business_name:too_short", "business_type:too_long", "business_url:not_http", "market:no_region"]]


HTML = "<html><head><title> A  page </title><meta name=description content='Says it'><meta name=viewport content=x></head><body><nav>Menu <a href='/about'>About us</a></nav><h1>Big</h1><p>one<p>two <b>bold</b>ly<script>no()</script><div hidden>not</div><a href='tel:1'>call</a> <a href='https://facebook.com/joe'>fb</a><footer>end</footer></body></html>"


def test_page_parse(spark):
    p = spark.createDataFrame([(1, "https://x.example/", HTML), (2, "https://y.example/", None)], "page_id int, url string, html string")
    r = {x["page_id"]: x for x in audit.page_features(p).collect()}
    assert (r[1]["title"], r[1]["meta_description"], r[1]["h1_count"], r[1]["has_viewport"], r[1]["has_tel"]) == ("A page", "Says it", 1, True, True)
    assert r[1]["text"] == "Menu About us Big one two boldly call fb end" and r[1]["content"] == "Big one two boldly call fb"
    assert r[2]["title"] is None and r[2]["word_count"] == 0
    assert [(x["href"], x["type"]) for x in audit.page_links(audit.page_features(p)).orderBy("ord").collect()] == [("https://x.example/about", "about"), ("https://facebook.com/joe", "social")]


def test_bare_references(spark, tmp_path):
    from rankforge.plans import page_queries

    html = "<html><head><title>a&amp;&amp</title></head><body><p>b&ampx; &copy;&quot &#38;amp; &#x26; &</p></body></html>"
    p = spark.createDataFrame([(1, "https://x.example/", html)], "page_id long, url string, html string")
    read = lambda bare: audit.page_features(p, bare).select("title", "text").first()
    assert tuple(read(True)) == ("a&&", 'b&x; ©" &amp; & &') and tuple(read(False)) == ("a&&amp", "b&ampx; ©&quot &amp; & &")
    p.write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view pages as select page_id, url, replace(replace(html, '&#38;', '&amp;'), '&#x26;', '&amp;') as html from '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.execute(page_queries.SQL["page_text"]).fetchall()
    assert [tuple(r) for r in page_queries.page_text(spark, str(tmp_path)).select("page_id", "title", "word_count", "text_chars", "content_chars").collect()] == want


def test_refresh_hop(spark):
    body = " ".join(["word"] * 50)
    stub = lambda to: f"<meta http-equiv=refresh content='0; url={to}'>hi"
    p = spark.createDataFrame([(1, "https://x.example/", stub("/home")), (2, "https://x.example/home", body), (3, "https://z.example/", stub("https://x.example/home"))], "page_id int, url string, html string")
    assert {r["page_id"]: (r["audited_page_id"], r["status"]) for r in audit.audit_gate(audit.page_features(p)).collect()} == {1: (2, "ok"), 2: (2, "ok"), 3: (None, "insufficient_content")}


def test_refresh_hop_to_a_url_of_two_pages(spark, tmp_path):
    from rankforge.plans import page_queries

    page = lambda n: f"<html><head></head><body>{' word' * n}</body></html>"
    rows = [(1, "https://x.example/a", page(50)), (2, "https://x.example/a", page(50)), (4, "https://x.example/b", page(5)), (5, "https://x.example/b", page(50)), (7, "https://x.example/c", page(50)), (8, "https://x.example/c", page(5))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view pages as from '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.execute(page_queries.SQL["audit_gate"]).fetchall()
    assert len(want) == 12 and (1_000_000_002, 2, "ok") in want and (1_000_000_008, None, "insufficient_content") in want
    assert sorted(tuple(r) for r in page_queries.audit_gate(spark, str(tmp_path)).select("page_id", "audited_page_id", "status").collect()) == sorted(want)


def test_robots(spark):
    body = "User-agent: a\n\nUser-agent: b\nDisallow: /x\nnonsense\nAllow: /x/ok\nUser-agent: *\nDisallow: /\n"
    rules = audit.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"), "B")
    u = spark.createDataFrame([(1, "h", "/x/1"), (2, "h", "/x/ok/1"), (3, "h", "/y"), (4, "other", "/x")], "id int, host string, path string")
    assert {r["id"]: r["allowed"] for r in audit.robots_allowed(u, rules).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_names_and_news(spark):
    n = spark.createDataFrame([("Café O'Hara & Söhne GmbH",)], "n string")
    assert n.select(signals.normalize_name(F.col("n"))).first()[0] == "cafe ohara and sohne"
    e = spark.createDataFrame([(1, "a", "joe cafe"), (1, "b", "joe cafe north"), (1, "c", "twin"), (1, "d", "twin"), (1, "e", "abc")], "market_id int, entity string, name_norm string")
    ok = signals.eligible_entities(e)
    assert {r["entity"] for r in ok.collect()} == {"a", "b"}
    t = spark.createDataFrame([(1, 1, "news on joe cafe north today"), (1, 2, "joe cafe opens"), (1, 3, "joe cafes")], "market_id int, article int, title_norm string")
    assert {r["article"]: r["entity"] for r in signals.attribute_articles(t, ok).collect()} == {1: "b", 2: "a"}


def test_many_keywords_count_like_one_regex_each(spark):
    import random
    import re

    rng = random.Random(3)
    parts = ["ab", "abs", "cd's", "x1", "ef-gh", "ij", "é", "klé", "&", "s", "ss", "mn"]
    texts = [None, "", *("".join(rng.choice(parts) + rng.choice([" ", "  ", ". ", "\u00a0", "", "'", "-"]) for _ in range(60)) for _ in range(12))]
    words = sorted({" ".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(900)} | {f"word{k} other{k}" for k in range(4200)})
    pages = spark.createDataFrame(list(enumerate(texts)), "page int, text string")
    lexicon = spark.createDataFrame([("c", k, w) for k, w in enumerate(words)], "category string, kw_ord int, keyword string")
    rows = signals.keyword_hits(pages, lexicon)
    got = {(r["page"], r["keyword"]): r["n"] for r in rows.collect()}
    plain = {r["page"]: r["t"] or "" for r in pages.select("page", signals.for_matching(F.col("text")).alias("t")).collect()}
    want = {}
    for w in words:
        # java's \\p{Z} and \\s by a list of what the texts have
        pattern = re.compile(r"(?<![a-z0-9])" + r"[\s\u00a0]+".join(map(re.escape, w.lower().split())) + r"s?(?![a-z0-9])")
        want |= {(p, w): n for p, t in plain.items() if (n := len(pattern.findall(t)))}
    assert got == want and len(want) > 300
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp") < 20


def test_keywords(spark):
    p = spark.createDataFrame([("x", "Free quote, free  quotes; freequote don’t Café-free quote")], "site string, text string")
    lex = spark.createDataFrame([("offer", 0, "free quote"), ("offer", 1, "don't"), ("risk", 0, "quo")], "category string, kw_ord int, keyword string")
    assert {r["keyword"]: r["n"] for r in signals.keyword_hits(p, lex).collect()} == {"free quote": 3, "don't": 1}


def test_urls(spark):
    c = lambda f, x: one(spark, f(F.lit(x)))
    assert c(urls.canonical_url, "HTTPS://WWW.Ex.com/A//#f") == "https://www.ex.com/A/"
    assert c(urls.canonical_url, " Odd Thing ") == "odd thing"
    assert [c(urls.domain_root, h) for h in ("a.b.example.com", "x.com.sg", "y.com.sg", "one")] == ["example.com", "x.com.sg", "y.com.sg", "one"]
    assert c(urls.site_identity, "https://facebook.com/Joe/") == "facebook.com/joe" and c(urls.site_identity, "https://joe.wixsite.com/a") == "joe.wixsite.com" and c(urls.site_identity, "https://facebook.com") is None
    u = spark.createDataFrame([("example.com",), ("http://0x7f.1/",), ("http://u:p@x.com/",), ("http://x.com:8080/",), ("http://[::1]/",), ("ftp://x",), ("http://printer.local/",)], "u string").withColumn("p", urls.url_parts("u"))
    assert [r[0] for r in u.select(urls.screen_reason(F.col("p"))).collect()] == [None, "address", "credentials", "port", "address", "scheme", "name"]
    assert u.select(urls.normalize_url(F.col("p"))).first()[0] == "https://example.com/"
    assert c(lambda x: urls.template_url("https://m/?q={}&z", x), "a b&c") == "https://m/?q=a%20b%26c&z"


def test_sources(spark):
    rows = [(1, 1, "site", "p", "T", "https://A.com/x/", "Joe", "used"), (1, 2, "site", "p", "T", "https://a.com/x", "Ann", "unavailable"), (1, 3, "map", "q", "M", None, "Joe", "used"), (1, 4, "map", "q", "M", None, "joe", "limited")]
    got = provenance.source_registry(spark.createDataFrame(rows, "report_id int, seq int, kind string, provider string, title string, url string, business string, status string")).orderBy("source_id").collect()
    assert [(r["source_id"], r["shared"], r["business"], r["status"]) for r in got] == [(1, True, None, "used"), (2, False, "Joe", "limited")]


def test_poi_ingest(spark):
    lines = [
        '\x1e{"id":"n5","properties":{"name":"A","shop":"x","source_ref":"z","n":3},"geometry":{"type":"Point","coordinates":[1.0000049,2]}}',
        '{"id":"n5","properties":{"name":"B","shop":"x"},"geometry":{"coordinates":[1,2]}}',
        '{"properties":{"@id":"a7","name":"C","office":"y"},"geometry":{"coordinates":[[[0,0],[2,0],[2,4],[0,0]]]}}',
        '{"id":"w1","properties":{"name":"D","shop":7},"geometry":{"coordinates":[1,2]}}',
        "broken", "  ", '{"id":"n9","properties":{"name":"Far","shop":"x"},"geometry":{"coordinates":[50,50]}}',
    ]
    good, bad = poi.ingest_pois(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string"), (0, 0, 10, 10))
    got = {(r["osm_type"], r["osm_id"]): (r["lat"], r["lon"], r["tags"]) for r in good.collect()}
    assert got == {("node", 5): (2.0, 1.0, {"name": "A", "shop": "x"}), ("relation", 3): (2.0, 1.0, {"name": "C", "office": "y"})}
    assert sorted(r["line_no"] for r in bad.collect()) == [3, 4, 6]


def test_reports(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"email":"a@x"}\n\nbroken\n{"email":"b@x"}\n')
    good, bad = reports.read_jsonl(spark, str(tmp_path / "e.jsonl"), "email string")
    assert sorted(r["email"] for r in good.collect()) == ["a@x", "b@x"] and bad.count() == 1
    reports.write_csv(spark.createDataFrame([("=1", "ok", 'q"r')], "email string, at string, note string"), str(tmp_path / "c"), ["email", "at"])
    text = next((tmp_path / "c").glob("part-*")).read_bytes().decode()
    assert text == 'email,at,note\r\n\'=1,ok,"q""r"\r\n'
    e = spark.createDataFrame([(2, "A@x ", "web", "two"), (1, "a@x", "ad", " "), (3, "a@x", None, "three")], "event_ord int, email string, source string, message string")
    r = reports.merge_signups(e).first()
    assert (r["source"], r["n_events"], r["messages"]) == ("ad", 3, "[2] two\n[3] three")


def test_quotas(spark):
    e = spark.sql("SELECT ord, timestamp_seconds(s) AS ts, 'k' AS key FROM VALUES (1, 50), (2, 55), (3, 61), (4, 110), (5, 111), (6, 169), (7, 170) t(ord, s)")
    t = {r["ord"]: r["admitted"] for r in quota.quota_tumbling(e, 60, 1).collect()}
    assert t == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False}
    a = {r["ord"]: (r["window_no"], r["admitted"]) for r in quota.quota_anchored(e, 60, 2).collect()}
    assert a == {1: (1, True), 2: (1, True), 3: (1, False), 4: (2, True), 5: (2, True), 6: (2, False), 7: (3, True)}


def test_names_in_titles_like_brute_force(spark):
    import random

    rng = random.Random(5)
    words = ["joe", "cafe", "north", "bar", "the"]
    names = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(25)})
    titles = [None, "", "joe", " the cafe ", *(" ".join(rng.choices([*words, "news"], k=rng.randrange(1, 9))) for _ in range(300))]
    held = {k: [n for n in names if f" {n} " in f" {t} "] for k, t in enumerate(titles) if t is not None}
    longest = {k: max(h, key=lambda n: (len(n), n)) for k, h in held.items() if h}
    want = {k: n for k, n in longest.items() if all(f" {x} " in f" {n} " for x in held[k])}
    a = spark.createDataFrame([(1, k, t) for k, t in enumerate(titles)] + [(1, 4, titles[4])], "market_id int, article int, title_norm string")
    e = spark.createDataFrame([(1, n, n) for n in names] + [(2, "z", "joe")], "market_id int, entity string, name_norm string")
    assert {r["article"]: r["entity"] for r in signals.attribute_articles(a, e).collect()} == want and len(want) > 50


def test_failed_audits_measure_nothing(spark):
    f = spark.createDataFrame([(1, "u", "timeout", [4]), (2, "u", None, []), (3, None, None, None), (4, None, None, [1])], "id int, url string, reason string, source_ids array<int>")
    got = {r["id"]: r for r in report.failed_audits(f).collect()}
    assert all(r[m] is None for r in got.values() for m in report.METRICS) and [len(got[k]["evidence"]) for k in (1, 2, 3, 4)] == [1, 0, 0, 1]
    assert got[1]["evidence"][0].asDict() == {"claim": "No audit of the website: timeout.", "source_url": "u", "source_type": "homepage", "source_ids": [4], "confidence": "low"}


def test_text_flags_take_whole_words(spark):
    rows = [(1, "A preview, uninsured"), (2, "Reviews; our work"), (3, None), (4, "case study. AWARD’s")]
    got = {r[0]: tuple(r)[2:] for r in audit.with_text_flags(spark.createDataFrame(rows, "page_id int, text string"), ("view", "award")).collect()}
    assert got == {1: (0, False, False, False), 2: (0, True, False, True), 3: (0, False, False, False), 4: (1, True, True, True)}
