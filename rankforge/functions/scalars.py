"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: What counts as an e-mail address and as a phone number in a text.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"


def half_up(c: Column, places: int = 0) -> Column:
    """Rounds halves towards plus infinity (``round`` would take -2.5 to -3)."""
    scale = float(10**places)
    out = F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
    return out.cast("bigint") if places == 0 else out


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def sanitize(c: Column) -> Column:
    """No angle brackets, backticks, braces or control characters (tabs and line ends too); white space collapsed and trimmed."""
    bare = F.regexp_replace(c, r"[<>`{}\x00-\x1F\x7F]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)[\s\x{FEFF}]+", " "))


def redact_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, "[email]")


def truncate_words(c: Column, n: int) -> Column:
    """The first n words and an ellipsis, or the trimmed text if it has no more."""
    words = F.split(F.trim(c), r"\s+")
    return F.when(F.size(words) > n, F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("…"))).otherwise(F.trim(c))


def csv_safe(c: Column) -> Column:
    """A leading apostrophe before what a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^\s*[\t\r=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
