"""Fetched pages: content types, caps and character sets."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a page that are read, and bytes in which a meta tag may name the character set.
PAGE_CAP, META_BYTES = 1_572_864, 2048
_META = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)


def is_html(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).rlike(r"^\s*(text/html|application/xhtml\+xml)\s*(;|$)"), F.lit(False))


def _decoded(body: bytes | None, content_type: str | None) -> str | None:
    if body is None:
        return None
    named = _META.search((content_type or "").encode("ascii", "ignore")) or _META.search(body[:META_BYTES])
    try:
        name = codecs.lookup(named[1].decode()).name if named else "utf-8"
    except LookupError:
        name = "utf-8"
    return bytes(body).decode(name, "replace")


@F.pandas_udf(T.StringType())
def decode_page(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Text by the header's character set, else the meta tag's, else UTF-8."""
    for body, kind in batches:
        yield pd.Series([_decoded(b, k) for b, k in zip(body, kind, strict=True)])


def read_pages(fetched: DataFrame) -> DataFrame:
    """(page_id, url, html, html_bytes, failure): a declared length over the cap fails, a longer body is cut and kept.

    fetched: page_id, url, content BINARY, content_type, declared_length.
    """
    failure = F.when(~is_html(F.col("content_type")), "not_html").when(F.col("declared_length") > PAGE_CAP, "too_large")
    out = fetched.withColumn("failure", failure).withColumn("html_bytes", F.octet_length("content"))
    body = F.when(F.col("failure").isNull(), F.substring("content", 1, PAGE_CAP))
    return out.select("page_id", "url", decode_page(body, F.col("content_type")).alias("html"), "html_bytes", "failure")
