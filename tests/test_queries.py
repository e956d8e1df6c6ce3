"""Registered queries of the reference's operators against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from rankforge.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        return
    r = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(w[names.index(c)]) for c in cols) for w in r.fetchall())
    assert got == want


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_pages_are_parsed_once(spark):
    plan = registry.QUERIES["website_score"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") + plan.count("ArrowEvalPython(") <= 1 and plan.count("parse_page(") == 1, plan


def test_page_queries_meet_their_cases(duck):
    """The SQL that the queries are held against has rows of every kind."""
    ask = lambda name, column: {r[0] for r in duck.execute(f"SELECT DISTINCT {column} FROM ({registry.ORACLE_SQL[name]})").fetchall()}
    assert ask("classify_links", "type") == {"social", "booking", "quote", "contact", "pricing", "services", "about", "blog", "careers", "other"}
    assert ask("pages_to_follow", "type") >= {"about", "services", "careers", "blog"} and ask("pages_to_follow", "place") == {1, 2}
    assert ask("audit_gate", "status") == {"ok", "insufficient_content"} and ask("audit_gate", "audited_page_id <> page_id") >= {True, False}
    assert ask("contact_flags", "has_phone") == ask("contact_flags", "has_email") == {True, False}
    assert ask("screen_urls", "reason") == {None, "scheme", "credentials", "port", "name", "address"}
    assert ask("resolve_industry", "stage") == {"map", "none", "probe"}
    assert len(ask("website_score", "website_score")) > 10 and len(ask("ranked_pages", "rank")) > 2
