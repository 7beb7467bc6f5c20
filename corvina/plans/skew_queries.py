"""Problem 6: per-key results over tables in which a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators.skew import heavy_keys, tree_aggregate, tree_count_distinct
from corvina.session import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Hosts and link targets that hold at least 2 percent of their table's rows."""
    hosts = heavy_keys(table(spark, d, "frontier"), "host", 0.02).select(F.lit("frontier.host").alias("field"), "key_value")
    targets = heavy_keys(table(spark, d, "document_links"), "target_url", 0.02).select(F.lit("document_links.target_url").alias("field"), "key_value")
    return hosts.unionByName(targets)


def p6_host_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows, attempts and failures per host; a null host is a key of its own, null attempts count as none."""
    return tree_aggregate(
        table(spark, d, "frontier"),
        ["host"],
        {
            "entries": ("sum", F.lit(1).cast("long")),
            "attempts": ("sum", F.coalesce(F.col("attempts"), F.lit(0).cast("long"))),
            "failures": ("sum", F.coalesce((F.col("state") == "failed").cast("long"), F.lit(0).cast("long"))),
        },
    )


def p6_target_sources(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sources per link target; a null target is a key of its own."""
    return tree_count_distinct(table(spark, d, "document_links"), "target_url", "source_url", "sources")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p6_found, p6_host_counts, p6_target_sources)}

ORACLE: dict[str, str] = {
    "p6_found": """
        SELECT 'frontier.host' AS field, host AS key_value FROM frontier WHERE host IS NOT NULL GROUP BY host
        HAVING count(*) >= 0.02 * (SELECT count(*) FROM frontier)
        UNION ALL
        SELECT 'document_links.target_url', target_url FROM document_links WHERE target_url IS NOT NULL GROUP BY target_url
        HAVING count(*) >= 0.02 * (SELECT count(*) FROM document_links)
    """,
    "p6_host_counts": """
        SELECT host, count(*) AS entries, CAST(sum(coalesce(attempts, 0)) AS BIGINT) AS attempts,
               count(*) FILTER (state = 'failed') AS failures
        FROM frontier GROUP BY host
    """,
    "p6_target_sources": "SELECT target_url, count(DISTINCT source_url) AS sources FROM document_links GROUP BY target_url",
}
