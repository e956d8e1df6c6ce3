"""Null-aware scores: null means not observed, and never counts as zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, half_up

#: Categories in order, with their largest scores.
CATEGORIES = (("seo", 25), ("conversion", 25), ("trust", 20), ("content", 20), ("technical", 10))
#: Checklist elements (key, category, points, covering element) in order.
ELEMENTS = (
    ("title", "seo", 5, None),
    ("meta_description", "seo", 5, None),
    ("h1", "seo", 5, None),
    ("word_count", "seo", 5, None),
    ("cta", "conversion", 8, None),
    ("contact_details", "conversion", 7, None),
    ("contact_path", "conversion", 5, None),
    ("offer_page", "conversion", 5, "services_page"),
    ("testimonials", "trust", 8, None),
    ("trust_language", "trust", 4, None),
    ("about_page", "trust", 4, None),
    ("gallery", "trust", 4, None),
    ("services_page", "content", 8, None),
    ("blog", "content", 4, None),
    ("headings", "content", 4, None),
    ("viewport", "technical", 3, None),
    ("speed", "technical", 3, None),
    ("page_size", "technical", 2, None),
    ("https", "technical", 2, None),
)
#: Weights of the final score and of the presence inputs.
FINAL_WEIGHTS = (0.6, 0.2, 0.15, 0.05)
PRESENCE_WEIGHTS = (30.0, 20.0, 20.0, 20.0, 10.0)


def momentum_score(momentum: Column, offer: Column, hiring: Column, social: Column, news: Column, count_news: Column, available: Column) -> Column:
    language = F.least(F.lit(55), 15 * momentum + 8 * offer + 10 * hiring) + F.least(F.lit(20), 4 * social)
    with_news = language + F.least(F.lit(25), 10 * F.coalesce(news, F.lit(0)))
    return F.when(available, F.when(count_news, half_up(with_news * F.lit(100.0) / F.lit(100.0))).otherwise(half_up(language * F.lit(100.0) / F.lit(75.0))))


def risk_score(signals: Column, available: Column) -> Column:
    return F.when(available, F.least(F.lit(100), 20 * signals))


def change_score(signals: Column, available: Column) -> Column:
    return F.when(available, F.least(F.lit(100), 25 * signals))


def final_score(website: Column, local: Column, momentum: Column, risk: Column) -> Column:
    w = [F.lit(x) for x in FINAL_WEIGHTS]
    return half_up(w[0] * website + w[1] * local + w[2] * momentum + w[3] * (F.lit(100) - risk))


def local_presence(*inputs: Column) -> Column:
    """Weighted share of the observed inputs: four flags and a fraction, in the order of PRESENCE_WEIGHTS."""
    values = [finite(c.cast("double")) if k < 4 else F.greatest(F.lit(0.0), F.least(F.lit(1.0), finite(c))) for k, c in enumerate(inputs)]
    values[4] = F.when(finite(inputs[4]).isNotNull(), values[4])
    got = sum((F.coalesce(F.lit(w) * v, F.lit(0.0)) for w, v in zip(PRESENCE_WEIGHTS, values, strict=True)), F.lit(0.0))
    of = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, v in zip(PRESENCE_WEIGHTS, values, strict=True)), F.lit(0.0))
    return half_up(F.lit(100.0) * got / F.nullif(of, F.lit(0.0)))


def category_match(tags: Column, pairs: Column, business_type: Column) -> Column:
    """Null without tags or pairs; 0 if no pair fits (values split at ``;``); 1 if a word of the type is in a value; else 0.5."""
    values = F.transform(F.map_values(tags), F.lower)
    fits = F.exists(pairs, lambda p: F.array_contains(F.transform(F.split(F.lower(F.coalesce(F.try_element_at(tags, p["key"]), F.lit(""))), ";"), lambda v: F.trim(v)), F.lower(p["value"])))
    words = F.filter(F.split(F.lower(business_type), r"[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    said = F.exists(words, lambda w: F.array_join(values, " ").contains(w))
    return F.when(tags.isNotNull() & (F.size(pairs) > 0), F.when(~fits, 0.0).when(said, 1.0).otherwise(0.5))


def position_status(rank: Column, gap: Column) -> Column:
    return F.when(rank.isNull() | gap.isNull(), None).when(rank == 1, "leading").when(gap >= 0, "competitive").when(gap >= -15, "recoverable").otherwise("low_visibility")


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "leading").when(score >= 65, "competitive").when(score >= 45, "recoverable").when(score.isNotNull(), "low_visibility")


def is_scored(available: Column, final: Column, chain: Column) -> Column:
    return F.coalesce(available & final.isNotNull() & ~chain, F.lit(False))


def audit_outcome(chain: Column, scored: Column, website: Column, attempted: Column, reason: Column) -> Column:
    """chain, scored, no_website, not_attempted, or failed with its reason: the first that holds."""
    return F.when(chain, "chain").when(scored, "scored").when(website.isNull(), "no_website").when(~attempted, "not_attempted").otherwise(F.concat(F.lit("failed:"), F.coalesce(reason, F.lit("unknown"))))


def website_score(audits: DataFrame) -> DataFrame:
    """Adds seo, conversion, trust, content, technical and website_score to rows of audit fields.

    Fields: title, meta_description, h1_count, word_count, business_type, market, body_text, cta_count, has_phone,
    has_email, has_contact, has_booking, has_services, has_pricing, has_testimonials, has_trust, has_about,
    has_gallery, has_blog, heading_count, has_viewport, fetch_ms, html_bytes, is_https.
    """
    city = F.lower(F.trim(F.substring_index("market", ",", 1)))
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("meta_description", F.lit("")), F.coalesce("body_text", F.lit(""))))
    in_city = (F.length(city) > 0) & hay.contains(city)
    pts = lambda n, c: F.when(c, n).otherwise(0)
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    parts = {
        "seo": [pts(5, filled("title")), pts(5, filled("meta_description")), pts(5, F.col("h1_count") > 0), pts(5, F.col("word_count") >= 300), pts(5, hay.contains(F.lower("business_type")) | in_city)],
        "conversion": [pts(8, F.col("cta_count") >= 2), pts(7, F.expr("has_phone or has_email")), pts(5, F.expr("has_contact or has_booking")), pts(5, F.expr("has_services or has_pricing"))],
        "trust": [pts(8, F.col("has_testimonials")), pts(4, F.col("has_trust")), pts(4, F.col("has_about")), pts(4, F.col("has_gallery"))],
        "content": [pts(8, F.col("has_services")), pts(4, F.col("has_blog")), pts(4, F.col("heading_count") >= 3), pts(4, in_city)],
        "technical": [pts(3, F.col("has_viewport")), pts(3, F.col("fetch_ms") < 2500), pts(2, F.col("html_bytes") < 1024 * 1024), pts(2, F.col("is_https"))],
    }
    out = audits.withColumns({c: F.least(F.lit(most), sum(parts[c], F.lit(0))).cast("int") for c, most in CATEGORIES})
    return out.withColumn("website_score", sum((F.col(c) for c, _ in CATEGORIES), F.lit(0)).cast("int"))


def element_matrix(rows: DataFrame, id_cols: tuple[str, ...]) -> DataFrame:
    """(ids, ord, key, category, points, covered_by, observed): a row an element; the element's column is its tri-state."""
    items = [F.struct(F.lit(k).alias("ord"), F.lit(key).alias("key"), F.lit(cat).alias("category"), F.lit(points).alias("points"), F.lit(cover).cast("string").alias("covered_by"), F.col(key).alias("observed")) for k, (key, cat, points, cover) in enumerate(ELEMENTS)]
    return rows.select(*id_cols, F.inline(F.array(*items)))
