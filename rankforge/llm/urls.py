"""URL filter with redirect equivalence: block decisions reach aliases over redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from .common import connected_components, materialize

#: (verdict, rule): host up to the first slash, then the path's beginning.
EXAMPLE_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*http-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*([^"'\s>]+)"""
#: Query parameters that name a visit, not a page.
_TRACKING = r"(?<=[?&])(?:utm_[a-z]+|gclid|fbclid)=[^&]*&?"


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased; null or without: empty."""
    return _lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """The name under which a url takes part in equivalence: no scheme, fragment, tracking parameter or last slash."""
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1), _TRACKING, "")
    query = F.regexp_replace(query, r"[?&]$", "")
    name = F.concat(host_of(url), F.regexp_replace(path_of(url), r"/$", ""), query)
    return F.when(host_of(url) != "", name)


def resolve(base: Column, link: Column) -> Column:
    """An absolute url for a link found on a page (http, //host, /path or relative)."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(root, link)).when(F.length(link) > 0, F.concat(root, F.when(folder == "", "/").otherwise(folder), link))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):  # the last that fits wins
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def equivalence_edges(pages: DataFrame, url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(src_url, dst_url, src, dst): canonical links and refresh redirects of the pages and a table (src, dst) of redirects, with the ends' node names."""
    found = pages.select(F.col(url).alias("u"), F.explode(F.array(F.regexp_extract(html, _CANONICAL, 1), F.regexp_extract(html, _REFRESH, 1))).alias("link")).where("link <> ''")
    edges = found.select(F.col("u").alias("src_url"), resolve(F.col("u"), F.col("link")).alias("dst_url"))
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst"))
    edges = edges.select("*", node_of(F.col("src_url")).alias("src"), node_of(F.col("dst_url")).alias("dst"))
    return edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, inherited): the longest rule's verdict, else that of the url's aliases.

    Aliases are the connected component over redirect and canonical-link edges. Without a rule of its own a url is
    allowed if any alias is allowed by a rule (allow takes precedence), blocked if any is blocked, else allowed. The
    urls at both ends of an edge are judged as they stand, listed as a page or not. Null and malformed urls match no rule,
    have no alias and are allowed. Repeated rows stay repeated; other columns are not read; an empty table gives no rows.
    """
    u = F.col(url)
    out = pages.select(F.col(id_col).alias(id_col), host_of(u).alias("host"), path_of(u).alias("path"), node_of(u).alias("node"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumn("rule", rule).withColumn("own", verdict)
    edges = materialize(equivalence_edges(pages, url, html, redirects), "edges")
    groups = materialize(connected_components(edges), "aliases")
    judged = lambda c: matching_rule(host_of(c), path_of(c), rules)[1].alias("own")
    votes = edges.select(F.col("src").alias("node"), judged(F.col("src_url"))).union(edges.select("dst", judged(F.col("dst_url")))).union(out.select("node", "own"))
    votes = votes.where("own IS NOT NULL").groupBy("node").agg(F.min("own").alias("own"))  # allow sorts before block
    decided = votes.join(groups, "node").groupBy("component").agg(F.min("own").alias("said"))
    # a component may hold a third of all nodes, a url a third of all rows; rows without a host meet nothing
    said = salted_join(groups, decided, ["component"], ["node"]).select("node", "said")
    named = salted_join(out.where("node IS NOT NULL"), said, ["node"], [id_col], "left")
    out = named.unionByName(out.where("node IS NULL").withColumn("said", F.lit(None).cast("string")))
    return out.select(id_col, "host", "path", "rule", F.coalesce("own", "said", F.lit("allow")).alias("verdict"), (F.col("own").isNull() & F.col("said").isNotNull()).alias("inherited"))
