"""Expressions for crawling: failure classes, back-off, Retry-After, URL policy, robots rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DELAY_MS = 120_000


def failure_type(message: Column) -> Column:
    """Class of a failure: http_429, http_5xx, dns, connection, timeout, else unknown; null stays null.

    A status counts only as the whole message; error codes go before words, as a message may name both.
    """
    low = F.lower(F.trim(message))
    return (
        F.when(message.isNull(), F.lit(None).cast("string"))
        .when(low.rlike(r"^http 429$"), "http_429")
        .when(low.rlike(r"^http 5\d\d$"), "http_5xx")
        .when(low.rlike(r"\b(?:enotfound|eai_again|enodata)\b"), "dns")
        .when(low.rlike(r"\b(?:econnrefused|econnreset|econnaborted|epipe|enetunreach|ehostunreach)\b"), "connection")
        .when(low.rlike(r"\b(?:timeout|timed out|operation was aborted|no answer in time)\b"), "timeout")
        .when(low.rlike(r"\bgetaddrinfo\b"), "dns")
        .when(low.rlike(r"\bsocket (?:closed|hang up)"), "connection")
        .otherwise("unknown")
    )


def retryable(kind: Column) -> Column:
    """Whether a class of failures is worth another attempt."""
    return kind.isin("http_429", "http_5xx", "dns", "timeout", "connection")


def backoff_ms(attempts: Column, retry_after: Column) -> Column:
    """Doubling from one second, at least what the server asked for, two minutes at most."""
    double = F.pow(F.lit(2.0), F.least(F.greatest(attempts, F.lit(1)), F.lit(20)) - 1) * 1000
    return F.least(F.greatest(double.cast("long"), F.coalesce(retry_after, F.lit(0)).cast("long")), F.lit(MOST_DELAY_MS).cast("long"))


def retry_after_ms(value: Column, now_ms: Column) -> Column:
    """A Retry-After header, in seconds or as an HTTP date, as milliseconds from now between 0 and two minutes; null if it is neither."""
    seconds = F.trim(value).try_cast("double") * 1000
    date = F.regexp_extract(value, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    at = F.unix_millis(F.try_to_timestamp(F.when(date != "", date), F.lit("d MMM yyyy HH:mm:ss"))) - now_ms
    wait = F.coalesce(seconds, at.cast("double"))
    return F.when(wait.isNotNull(), F.least(F.greatest(wait, F.lit(0.0)), F.lit(float(MOST_DELAY_MS))).cast("long"))


def glob(pattern: Column) -> Column:
    """An anchored regular expression for a glob in which ``*`` stands for anything; every other character is literal."""
    return F.concat(F.lit("(?i)^"), F.regexp_replace(F.regexp_replace(pattern, r"([.+^${}()|\[\]\\?])", r"\\$1"), r"\*", ".*"), F.lit("$"))


def skip_reason(url: Column, depth: Column, max_depth: Column, include: Column, exclude: Column) -> Column:
    """Why a URL is left out by a policy: depth, exclude_pattern, include_pattern, or null if it is let in."""
    hit = lambda patterns: F.coalesce(F.exists(patterns, lambda p: F.regexp_like(url, glob(p))), F.lit(False))
    return (
        F.when(max_depth.isNotNull() & (depth > max_depth), "depth")
        .when(hit(exclude), "exclude_pattern")
        .when((F.coalesce(F.size(include), F.lit(0)) > 0) & ~hit(include), "include_pattern")
    )


def content_type_allowed(content_type: Column, allowed: Column) -> Column:
    """Whether the media type, without parameters, is in the list."""
    return F.array_contains(allowed, F.lower(F.trim(F.element_at(F.split(content_type, ";"), 1))))


def robots_sitemaps(text: Column) -> Column:
    """Sitemap URLs named by a robots file, comments left out, each once, in order."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda line: F.trim(F.regexp_replace(line, "#.*$", "")))
    named = F.filter(lines, lambda line: line.rlike(r"(?i)^sitemap\s*:\s*\S"))
    return F.array_distinct(F.transform(named, lambda line: F.regexp_extract(line, r"(?i)^sitemap\s*:\s*(\S+)", 1)))


def sitemap_locations(xml: Column, most: int = 5000) -> Column:
    """Locations of a sitemap or sitemap index, each once, in order."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc\b[^>]*>\s*(.*?)\s*</loc\s*>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))), 1, most)


def zero_filled(status: Column, values: Sequence[str]) -> list[Column]:
    """One count per value, 0 for those that don't occur."""
    return [F.count(F.when(status == v, 1)).alias(v) for v in values]
