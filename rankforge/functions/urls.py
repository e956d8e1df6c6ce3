"""URL columns: canonical forms, hosts, site identity, screening."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of two labels, and second labels under which two-letter domains register a third.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "com.br", "co.jp", "co.in", "com.mx")
GENERIC_SECOND = ("com", "co", "org", "net", "gov", "edu", "ac", "or", "ne", "go", "gob", "gv", "mil", "nom", "ltd", "plc", "sch", "biz", "info")
#: Hosts shared by many sites.
SHARED_HOSTS = (
    "facebook.com", "fb.com", "fb.me", "instagram.com", "twitter.com", "x.com", "tiktok.com", "linkedin.com", "youtube.com", "yelp.com",
    "google.com", "goo.gl", "g.page", "sites.google.com", "business.site", "wixsite.com", "wix.com", "square.site", "squareup.com",
    "squarespace.com", "linktr.ee", "linktree.com", "wordpress.com", "blogspot.com", "weebly.com", "godaddysites.com", "carrd.co",
    "myshopify.com", "github.io", "netlify.app", "vercel.app", "nextdoor.com", "yellowpages.com", "tripadvisor.com", "doordash.com",
    "ubereats.com", "grubhub.com", "toasttab.com", "opentable.com", "resy.com", "vagaro.com", "booksy.com", "mindbodyonline.com",
    "schedulicity.com", "setmore.com", "ueniweb.com", "site123.me", "jimdosite.com", "webnode.com",
)
#: IPv4 networks that are not public.
BLOCKED_V4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")
BLOCKED_NAMES = ("localhost", "local", "internal", "lan", "home", "test", "invalid")
URL_TYPE = (
    T.StructType().add("scheme", T.StringType()).add("host", T.StringType()).add("port", T.IntegerType()).add("path", T.StringType())
    .add("query", T.StringType()).add("fragment", T.StringType()).add("credentials", T.BooleanType()).add("ipv4", T.LongType()).add("ipv6_blocked", T.BooleanType())
)


def _ipv4(host: str) -> int | None:
    """The address that a URL parser reads from one to four decimal, octal or hexadecimal numbers."""
    parts = host.split(".")
    if not 1 <= len(parts) <= 4:
        return None
    try:
        n = [int(p, 16) if p[:2].lower() == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in parts]
    except ValueError:
        return None
    if any(x < 0 for x in n) or any(x > 255 for x in n[:-1]) or n[-1] >= 256 ** (5 - len(n)):
        return None
    return sum(x << (8 * (3 - k)) for k, x in enumerate(n[:-1])) + n[-1]


def _parse(url: str | None) -> tuple:
    try:
        raw = (url or "").strip()
        u = urlsplit(raw if "://" in raw else f"https://{raw}")
        host = (u.hostname or "").rstrip(".")
        if u.scheme.lower() not in ("http", "https") or not host:
            return (None,) * 9
        if not host.isascii():
            host = host.encode("idna").decode()
        v6 = ":" in host and not ipaddress.ip_address(host.split("%")[0]).is_global
        return u.scheme.lower(), host, u.port, u.path or "/", u.query, u.fragment, u.username is not None or u.password is not None, _ipv4(host), v6
    except ValueError:
        return (None,) * 9


@F.pandas_udf(URL_TYPE)
def url_parts(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Scheme (https if none), host, port and the rest of http(s) urls; all null for others."""
    names = URL_TYPE.names
    for s in urls:
        yield pd.DataFrame([_parse(u) for u in s], columns=names).astype({"port": "Int32", "ipv4": "Int64"})


def normalize_url(parts: Column) -> Column:
    """A url again from its parts; null for credentials."""
    port = F.when(parts["port"].isNull() | ((parts["scheme"] == "https") & (parts["port"] == 443)) | ((parts["scheme"] == "http") & (parts["port"] == 80)), "").otherwise(F.concat(F.lit(":"), parts["port"].cast("string")))
    query = F.when(parts["query"] != "", F.concat(F.lit("?"), parts["query"])).otherwise("")
    frag = F.when(parts["fragment"] != "", F.concat(F.lit("#"), parts["fragment"])).otherwise("")
    return F.when(~parts["credentials"], F.concat(parts["scheme"], F.lit("://"), parts["host"], port, parts["path"], query, frag))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/?#:]+)", 1))


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """For citations: no fragment, host in lower case, one trailing slash of the path less (a bare root keeps its); else the trimmed lower case."""
    u = F.trim(url)
    m = r"^(?i)(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?"
    path = F.regexp_replace(F.regexp_extract(u, m, 3), r"/$", "")
    whole = F.concat(F.lower(F.regexp_extract(u, m, 1)), F.lit("://"), F.lower(F.regexp_extract(u, m, 2)), F.when(path == "", "/").otherwise(path), F.regexp_extract(u, m, 4))
    return F.when(u.rlike(m), whole).otherwise(F.lower(u))


def domain_root(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The last two labels, or three under a listed suffix or a two-letter domain with a generic second label."""
    labels = F.split(without_www(F.lower(host)), r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    listed = last(2).isin(*suffixes) if suffixes else F.lit(False)
    generic = F.element_at(labels, -1).rlike("^[a-z]{2}$") & F.get(labels, n - 2).isin(*GENERIC_SECOND)
    return F.when(n <= 2, F.array_join(labels, ".")).when(listed | generic, last(3)).otherwise(last(2))


def is_shared_host(host: Column, shared: Sequence[str] = SHARED_HOSTS) -> Column:
    """The host or a parent of it is listed: one lookup of its suffixes, however long the list."""
    labels = F.split(F.lower(host), r"\.")
    n = F.size(labels)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    return F.coalesce(F.arrays_overlap(ends, F.array(*[F.lit(s) for s in shared])), F.lit(False))


def site_identity(url: Column, shared: Sequence[str] = SHARED_HOSTS) -> Column:
    """The domain root of an own domain; on a shared host its tenant label, or host, path and the query's ``id``; a bare shared host has none."""
    own = without_www(host_of(url))
    rented = is_shared_host(own, shared)
    host = F.regexp_replace(own, r"^m\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^(?i:https?)://[^/?#]+([^?#]*)", 1), r"/+$", "")
    profile = F.regexp_extract(url, r"^[^#?]*\?(?:[^#]*&)?id=([^&#]+)", 1)
    page = F.when(path != "", F.concat(host, F.lower(path), F.when(profile != "", F.concat(F.lit("?id="), profile)).otherwise("")))
    return F.when(own == "", None).when(rented & host.isin(*shared), page).when(rented, host).otherwise(domain_root(own))


def describe_url(url: Column, most: int = 72) -> Column:
    """For display: host without www, decoded path and query, an ellipsis after ``most`` characters."""
    tail = F.regexp_replace(F.regexp_extract(url, r"^(?i:https?)://[^/?#]+([^#]*)", 1), r"^/$", "")
    plain = F.concat(without_www(host_of(url)), F.coalesce(F.try_url_decode(tail), tail))
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most - 1), F.lit("…"))).otherwise(plain)


def screen_reason(parts: Column) -> Column:
    """Why a url is not fetched, without a lookup of its name; null if nothing speaks against it."""
    nets = [ipaddress.ip_network(n) for n in BLOCKED_V4]
    v4 = F.lit(False)
    for n in nets:
        v4 = v4 | parts["ipv4"].between(int(n.network_address), int(n.broadcast_address))
    label = F.element_at(F.split(parts["host"], r"\."), -1)
    return F.when(parts["host"].isNull(), "scheme").when(parts["credentials"], "credentials").when(parts["port"].isNotNull() & ~parts["port"].isin(80, 443), "port").when(label.isin(*BLOCKED_NAMES), "name").when(F.coalesce(v4, F.lit(False)) | F.coalesce(parts["ipv6_blocked"], F.lit(False)), "address")


def template_url(template: str, value: Column) -> Column:
    """A citation url with the percent-encoded value (a space as %20) at ``{}``."""
    head, tail = template.split("{}")
    return F.concat(F.lit(head), F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit(tail))
