"""What the queries on pages share: the site of a URL, and document_search joined to the ids of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.session import sent_if_small, spread

def site(url: Column) -> Column:
    """Host of a URL in lower case, without a leading ``www.`` and without the port; null for a null or hostless URL."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:@]+)", 1)
    return F.when(host != "", host)


def texts_by_url(search: DataFrame) -> DataFrame:
    """(url, title, text), one row per URL: rows that occur twice are taken once, a URL with several texts has its greatest.

    The URLs that occur twice are found by reading the addresses alone; only their rows are shuffled, all others pass
    straight through.  Null URLs have no row.
    """
    rows = spread(search.where(F.col("url").isNotNull()).select("url", "title", "text"), "url")
    several = sent_if_small(rows.groupBy("url").agg(F.count("*").alias("n")).where("n > 1").select("url"), "urls")
    once = rows.join(several, "url", "left_anti")
    twice = rows.join(several, "url", "left_semi").groupBy("url").agg(F.max(F.struct("text", "title")).alias("row"))
    return once.unionByName(twice.select("url", "row.title", "row.text"))
