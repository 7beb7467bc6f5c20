"""URL expressions on built-in functions: canonical form, host, public-address checks, scope."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: query parameters that only track visitors.
TRACKING = r"^(?:utm_(?:source|medium|campaign|term|content|id)|fbclid|gclid|dclid|msclkid|mc_.*)$"

# Fixed value: first parts of IPv4 addresses that are not on the public Internet.
PRIVATE_V4 = (
    r"^(?:0|10|127)\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.0\.|^192\.168\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^(?:22[4-9]|2[3-5]\d)\."
)

# Fixed value: IPv6 prefixes that are not on the public Internet.
PRIVATE_V6 = r"^(?:::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:|2001:0?db8:|2001:0{0,3}:)"

_V4 = r"^\d{1,3}(?:\.\d{1,3}){3}$"


def scheme(url: Column) -> Column:
    """Scheme in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host(url: Column) -> Column:
    """Host in lower case without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)", 1))


def canonicalize(url: Column) -> Column:
    """Scheme and host in lower case, default port, user, fragment and tracking parameters removed, path at least ``/``."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:@]*):(\d+)", 1)
    kind = scheme(url)
    standard = ((kind == "https") & (port == "443")) | ((kind == "http") & (port == "80"))
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.element_at(F.split(p, "="), 1)).rlike(TRACKING)), "&")
    return F.concat(
        kind,
        F.lit("://"),
        host(url),
        F.when((port == "") | standard, "").otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", "/").otherwise(path),
        F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)),
    )


def is_public_address(address: Column) -> Column:
    """Whether an IP address (v4, v6, or v4 written into v6 as ``::ffff:a.b.c.d`` or ``::a.b.c.d``) is on the public Internet."""
    mapped = F.regexp_replace(F.lower(address), r"^::(?:ffff:)?(?=\d+\.)", "")
    in_range = F.forall(F.split(mapped, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    return F.when(mapped.rlike(_V4), in_range & ~mapped.rlike(PRIVATE_V4)).otherwise(mapped.contains(":") & ~mapped.rlike(PRIVATE_V6))


def is_public_url(url: Column) -> Column:
    """Whether a URL is http(s), carries no user, and its host could be reached from anywhere."""
    name = host(url)
    bare = F.regexp_replace(name, r"^\[|\]$", "")
    address = bare.rlike(_V4) | bare.contains(":")
    local = (name == "localhost") | name.rlike(r"\.(?:localhost|local|internal)$") | (name == "")
    plain = ~url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*@")
    return scheme(url).isin("http", "https") & plain & ~local & F.when(address, is_public_address(bare)).otherwise(F.lit(True))


def in_scope(url: Column, allowed_hosts: Column) -> Column:
    """Whether a URL is public and its host is one of the allowed ones."""
    return is_public_url(url) & F.array_contains(allowed_hosts, host(url))


def canonical_outcome(candidate: Column, allowed_hosts: Column) -> Column:
    """``none`` without a declared canonical URL, ``accepted`` if it is in scope, else ``rejected``."""
    return F.when(candidate.isNull() | (candidate == ""), "none").when(in_scope(candidate, allowed_hosts), "accepted").otherwise("rejected")


def is_web_address(entry: Column) -> Column:
    """Whether what a reader typed names a page rather than a search."""
    return F.trim(entry).rlike(r"^(?:https?://\S+|localhost(?::\d+)?(?:/\S*)?|(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}(?::\d+)?(?:[/?#]\S*)?)$")


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, reference: pd.Series) -> pd.Series:
    """``reference`` resolved against ``base``; null if either is null or can't be read."""

    def one(b: str | None, r: str | None) -> str | None:
        if b is None or r is None:
            return None
        try:
            return urljoin(b, r.strip())
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, reference)], dtype=object)
