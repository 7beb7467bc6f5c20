"""Fetched pages to documents: size caps, extraction, robots directives, sitemaps."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.functions import crawl as cr
from corvina.functions import text as tx
from corvina.functions import urls as ur

#: Bytes of a body at most: robots files, sitemaps, documents.
MOST_ROBOTS, MOST_SITEMAP, MOST_DOCUMENT = 512 * 1024, 2 * 1024 * 1024, 2 * 1024 * 1024

MOST_TEXT, MOST_LINKS = 100_000, 300


def within_cap(pages: DataFrame, body: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(pages whose body is within ``most`` bytes, the others); a null body is within."""
    small = F.coalesce(F.octet_length(F.col(body)), F.lit(0)) <= most
    return pages.where(small), pages.where(~small)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _resolved(base: pd.Series, targets: pd.Series) -> pd.Series:
    """Links resolved against their page's address, dot segments removed; what can't be read is left out."""

    def one(b: str | None, links: Sequence[str] | None) -> list[str]:
        out = []
        for link in links if links is not None and b is not None else ():
            if link is None:
                continue
            try:
                out.append(urljoin(b, link.strip()))
            except ValueError:
                continue
        return out

    return pd.Series([one(b, t) for b, t in zip(base, targets)], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """(url, title, text, links, headings, canonical_url, noindex, nofollow, text_hash) of (url, html, x_robots_tag).

    Links are absolute, canonical, public, each once, in order, the first ``MOST_LINKS`` of those.  Null HTML counts as empty.
    """
    html, base = F.coalesce("html", F.lit("")), F.col("url")
    directives = tx.robots_directives(html, F.col("x_robots_tag"))
    found = F.transform(_resolved(base, tx.links(html)), lambda u: ur.canonicalize(u))
    declared = F.nullif(tx.canonical_link(html), F.lit(""))
    out = pages.select(
        "url",
        tx.title_of(html, ur.host(base)).alias("title"),
        F.substring(tx.plain_text(html), 1, MOST_TEXT).alias("text"),
        F.slice(F.array_distinct(F.filter(found, lambda u: ur.is_public_url(u))), 1, MOST_LINKS).alias("links"),
        tx.headings(html).alias("headings"),
        F.when(declared.isNotNull(), ur.canonicalize(F.element_at(_resolved(base, F.array(declared)), 1))).alias("canonical_url"),
        tx.noindex(directives).alias("noindex"),
        tx.nofollow(directives).alias("nofollow"),
    )
    return out.withColumn("text_hash", F.sha2("text", 256))


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """(source_url, position, url, is_index) from (url, xml): public locations in canonical form, each once."""
    found = F.transform(cr.sitemap_locations(F.col("xml")), lambda u: ur.canonicalize(u))
    rows = sitemaps.select(F.col("url").alias("source_url"), F.col("xml").rlike(r"(?i)<sitemapindex\b").alias("is_index"), F.posexplode(F.array_distinct(found)).alias("position", "url"))
    return rows.where(ur.is_public_url(F.col("url"))).select("source_url", "position", "url", "is_index")


#: Sitemaps read for a crawl at most, and the depth of indexes that are followed (the roots have depth 0).
MOST_SITEMAPS, SITEMAP_DEPTH = 100, 3


def sitemap_roots(seeds: DataFrame, robots: DataFrame) -> DataFrame:
    """(url) of the sitemaps a crawl of (origin) starts from: ``/sitemap.xml`` and those named by the robots file (origin, text)."""
    named = robots.select("origin", F.explode(cr.robots_sitemaps(F.col("text"))).alias("raw"))
    named = named.join(seeds.select("origin").distinct(), "origin").select(F.element_at(_resolved(F.concat("origin", F.lit("/")), F.array("raw")), 1).alias("url"))
    return seeds.select(F.concat("origin", F.lit("/sitemap.xml")).alias("url")).unionByName(named).where("url IS NOT NULL").distinct()


def sitemap_levels(sitemaps: DataFrame, roots: DataFrame, most_depth: int = SITEMAP_DEPTH, most_documents: int = MOST_SITEMAPS, hosts: Sequence[str] | None = None) -> DataFrame:
    """(url) of the pages named by sitemaps reached from ``roots`` (url) through sitemap indexes of depth 0 to ``most_depth``.

    Breadth first, in the order of discovery (by address within a level), every sitemap once, ``most_documents`` of them
    in all: that is the crawl's own limit.  ``hosts`` restricts what is followed and returned to these hosts.
    """
    entries = sitemap_entries(sitemaps)
    if hosts is not None:
        entries = entries.where(ur.host(F.col("url")).isin(*hosts))
    # Bounded: at most ``most_documents`` addresses are known here.
    level, seen, out = sorted(r.url for r in roots.select("url").distinct().orderBy("url").limit(most_documents).collect()), [], None
    for depth in range(most_depth + 1):
        level = [u for u in level if u not in seen][: most_documents - len(seen)]
        if not level:
            break
        seen += level
        read = entries.where(F.col("source_url").isin(*level))
        pages = read.where("NOT is_index").select("url")
        out = pages if out is None else out.unionByName(pages)
        if depth < most_depth:
            level = [r.url for r in read.where("is_index").select("url").distinct().orderBy("url").limit(most_documents + len(seen)).collect()]
    return out.distinct() if out is not None else entries.select("url").limit(0)
