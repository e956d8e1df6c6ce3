"""Language signals: keyword counts, site signals, social links, names, news."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import SALTS, salted_join

#: Social platforms by host, and beginnings of paths that are no profile.
SOCIAL = {"facebook.com": "facebook", "fb.com": "facebook", "instagram.com": "instagram", "linkedin.com": "linkedin", "youtube.com": "youtube", "youtu.be": "youtube", "x.com": "x", "twitter.com": "x", "tiktok.com": "tiktok"}
NO_PROFILE = ("sharer", "share", "sharearticle", "sharing", "dialog", "intent", "plugins", "embed", "home", "login", "cws/share")
COMPANY_ENDINGS = r"\b(inc|llc|ltd|co|corp|company|gmbh|limited|corporation)\b"


def for_matching(text: Column) -> Column:
    return F.lower(F.translate(text, "‘’", "''"))


def keyword_pattern(keyword: Column) -> Column:
    """Whole word or phrase with an optional s; white space inside is flexible."""
    quoted = F.regexp_replace(F.lower(keyword), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return F.concat(F.lit(r"(?<![a-z0-9])"), F.regexp_replace(quoted, r"\s+", r"[\\s\\p{Z}]+"), F.lit(r"s?(?![a-z0-9])"))


def _anchors(keyword: Column) -> Column:
    """Runs of letters and digits of which a text must have one as a whole to hold the keyword; an empty one if it has no such run."""
    first = F.regexp_extract(F.lower(keyword), "[a-z0-9]+", 0)
    ends = F.lower(keyword).endswith(first) & (F.length(first) > 0)  # an s may follow a keyword
    return F.when(ends, F.array(first, F.concat(first, F.lit("s")))).otherwise(F.array(first))


def keyword_hits(pages: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """Rows of pages x lexicon (category, kw_ord, keyword) with n, the matches of a keyword in the page; n > 0 only.

    A page's text is normalised and cut into words once; only keywords whose first word it has are joined to it and counted, so
    neither the plan nor the work on a page grows with keywords that it cannot hold. The lexicon is a word list: its size is a
    parameter's, not the corpus's, and only the list of its first words travels as one row. Null texts have no hits; keywords
    without a letter or digit are counted in every page; repeated keywords come each.
    """
    words = lexicon.select("category", "kw_ord", "keyword", keyword_pattern(F.col("keyword")).alias("_pattern"), F.explode(_anchors(F.col("keyword"))).alias("_anchor"))
    listed = words.agg(F.collect_set("_anchor").alias("_known"))
    p = pages.withColumn("_t", for_matching(F.col(text)))
    found = F.array_intersect(F.array_append(F.regexp_extract_all("_t", F.lit("[a-z0-9]+"), F.lit(0)), F.lit("")), "_known")
    rest = [c for c in pages.columns if c != text]
    asked = p.crossJoin(F.broadcast(listed)).select(*rest, "_t", F.explode(found).alias("_anchor")).join(words, "_anchor")
    # each keyword of a row once, though two of its anchors may occur: the one with an s counts only if the other is absent
    both = F.endswith(F.col("_anchor"), F.lit("s")) & F.regexp_like("_t", F.concat(F.lit("(?<![a-z0-9])"), F.expr("left(_anchor, length(_anchor) - 1)"), F.lit("(?![a-z0-9])"))) & (F.regexp_extract(F.lower("keyword"), "[a-z0-9]+", 0) != F.col("_anchor"))
    n = F.when(~both, F.regexp_count("_t", F.col("_pattern"))).otherwise(0)
    # an outer generator: before an inner one the optimizer puts a filter that counts every keyword a second time
    rows = asked.select(*rest, "category", "kw_ord", "keyword", F.inline_outer(F.filter(F.array(F.struct(n.alias("n"))), lambda h: h["n"] > 0)))
    return rows.where("n IS NOT NULL")


def site_signals(hits: DataFrame) -> DataFrame:
    """(site, category, keywords, first_page, confidence): a keyword counts once, at its first page; three are shown.

    hits: site, page_ord, category, kw_ord, keyword.
    """
    first = hits.groupBy("site", "category", "kw_ord", "keyword").agg(F.min("page_ord").alias("page_ord"))
    g = first.groupBy("site", "category").agg(F.sort_array(F.collect_list(F.struct("page_ord", "kw_ord", "keyword"))).alias("h"))
    return g.select("site", "category", F.array_join(F.transform(F.slice("h", 1, 3), lambda x: x["keyword"]), ", ").alias("keywords"), F.size("h").alias("n_keywords"), F.col("h")[0]["page_ord"].alias("first_page"), F.when(F.size("h") > 1, "medium").otherwise("low").alias("confidence"))


def social_platform(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/?#:]+)", 1)), r"^www\.", "")
    path = F.lower(F.regexp_extract(url, r"^(?i:https?)://[^/?#]+([^?#]*)", 1))
    out = F.lit(None).cast("string")
    for h, name in SOCIAL.items():
        out = F.when((host == h) | host.endswith("." + h), name).otherwise(out)
    return F.when(~path.isin("", "/") & ~path.rlike(f"^/({'|'.join(NO_PROFILE)})([/.?]|$)"), out)


@F.pandas_udf(T.StringType())
def _fold(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without combining marks."""
    import unicodedata

    for s in names:
        yield s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def normalize_name(name: Column, endings: bool = True) -> Column:
    """Folded lower-case letters and digits; without company endings, or with them for titles."""
    out = F.regexp_replace(F.replace(F.regexp_replace(F.lower(_fold(name)), r"['\"`‘’“”]", ""), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " ")
    out = F.regexp_replace(out, COMPANY_ENDINGS, " ") if endings else out
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def attribute_articles(articles: DataFrame, entities: DataFrame, salts: int = SALTS) -> DataFrame:
    """(market_id, article, entity): the entity whose whole name the title holds; of several the longest, if it holds all.

    articles: market_id, article, title_norm; entities: market_id, entity, name_norm (names that are unique and long
    enough). A title's distinct words and pairs of neighbours meet the names' heads, their first two words or their only one,
    as narrow rows that are dealt over ``salts`` tasks a head; only what met a name goes back to its title and is compared as
    a whole. Titles and markets that are null are attributed to nobody.
    """
    e = entities.select("market_id", F.substring_index("name_norm", " ", 2).alias("head"), "entity", "name_norm")
    ws = F.filter(F.split("title_norm", " "), lambda w: w != "")
    pairs = F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    heads = articles.select("market_id", "article", F.explode(F.array_distinct(F.concat(ws, pairs))).alias("head"))
    met = salted_join(heads, e, ["market_id", "head"], ["article"], salts=salts).drop("head")
    titles = articles.select("market_id", "article", F.concat(F.lit(" "), F.col("title_norm"), F.lit(" ")).alias("_t"))
    hit = met.join(titles, ["market_id", "article"]).where(F.contains("_t", F.concat(F.lit(" "), F.col("name_norm"), F.lit(" "))))
    g = hit.groupBy("market_id", "article").agg(F.max(F.struct(F.length("name_norm").alias("n"), F.col("name_norm").alias("best"), F.col("entity"))).alias("b"), F.collect_set("name_norm").alias("all"))
    ok = F.forall("all", lambda x: F.contains(F.concat(F.lit(" "), F.col("b.best"), F.lit(" ")), F.concat(F.lit(" "), x, F.lit(" "))))
    return g.where(ok).select("market_id", "article", F.col("b.entity").alias("entity"))


def eligible_entities(entities: DataFrame) -> DataFrame:
    """Names of four letters or more that one entity of the market has."""
    n = F.count("*").over(Window.partitionBy("market_id", "name_norm"))
    return entities.withColumn("_n", n).where((F.col("_n") == 1) & (F.length(F.replace(F.col("name_norm"), F.lit(" "), F.lit(""))) >= 4)).drop("_n")


def entity_news(attributed: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` articles of each entity; a url counts once in a market, where it came first.

    attributed: market_id, entity, url, ord. A url that the cap drops isn't offered to another entity.
    """
    first = attributed.withColumn("_u", F.row_number().over(Window.partitionBy("market_id", "url").orderBy("ord"))).where("_u = 1")
    place = F.row_number().over(Window.partitionBy("market_id", "entity").orderBy("ord"))
    return first.withColumn("place", place).where(F.col("place") <= most).drop("_u")


def news_coverage(records: DataFrame) -> DataFrame:
    """(market_id, news_counted): every scored record was searched."""
    return records.where("scored").groupBy("market_id").agg(F.bool_and("searched").alias("news_counted"))


def first_social_links(links: DataFrame, key: str) -> DataFrame:
    """(key, platform, href): the first link of each platform by ord."""
    p = links.withColumn("platform", social_platform(F.col("href"))).where("platform IS NOT NULL")
    return p.groupBy(key, "platform").agg(F.min_by("href", "ord").alias("href"))


def error_severity(events: DataFrame, user_codes: Sequence[str] = ("validation", "not_found", "ambiguous", "rate_limited")) -> DataFrame:
    user = F.coalesce(F.col("code").isin(*user_codes), F.lit(False)) | F.coalesce(F.col("status").between(400, 499), F.lit(False))
    return events.withColumn("severity", F.when(user, "warn").otherwise("error"))
