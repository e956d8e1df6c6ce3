"""Local-presence inputs from directory rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category_match(tags: Column, resolved: Column, business_type: Column) -> Column:
    """1 if a tag is among the resolved (key, value) pairs and a word of the type occurs in the tags' values, 0.5 if only the
    tag is, 0 if not; null where tags or resolved pairs are unknown. Tag values may hold several, split at semicolons."""
    values = lambda k: F.transform(F.split(F.coalesce(F.try_element_at(tags, k), F.lit("")), ";"), lambda v: F.lower(F.trim(v)))
    hit = F.exists(resolved, lambda p: F.array_contains(values(p["key"]), F.lower(p["value"])) & (p["value"] != ""))
    text = F.regexp_replace(F.lower(F.array_join(F.map_values(tags), " ")), "[_;:]+", " ")
    words = F.filter(F.split(F.lower(business_type), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    named = F.exists(words, lambda w: F.contains(text, w))
    return F.when(tags.isNotNull() & (F.size(resolved) > 0), F.when(~hit, 0.0).when(F.coalesce(named, F.lit(False)), 1.0).otherwise(0.5))


def presence_inputs(rows: DataFrame) -> DataFrame:
    """Adds p_website, p_listing, p_contact, p_match and p_complete.

    rows: website, phone, address, lat, lon, tags (map), resolved (array of key, value), business_type, audit_contact (null: not
    observed), has_listing and is_user. Competitors are listed; of a user without a listing only the website and what the
    audit saw of contact details are known, the rest is null and leaves the score.
    """
    c = F.col
    placed = c("lat").isNotNull() & c("lon").isNotNull()
    known = ~c("is_user") | c("has_listing")
    fields = [c("website").isNotNull() & (c("website") != ""), c("phone").isNotNull() & (c("phone") != ""), c("address").isNotNull() & (c("address") != ""), placed]
    site, phone, address, _ = (F.coalesce(x, F.lit(False)) for x in fields)
    n = sum((F.coalesce(x, F.lit(False)).cast("int") for x in fields), F.lit(0))
    contact = F.when(known, phone | F.coalesce(c("audit_contact"), F.lit(False))).otherwise(c("audit_contact"))
    made = {"p_website": site | c("is_user"), "p_contact": contact, "p_listing": F.when(known, address | placed), "p_match": F.when(known, category_match(c("tags"), c("resolved"), c("business_type"))), "p_complete": F.when(known, n / 4.0)}
    return rows.withColumns(made)
