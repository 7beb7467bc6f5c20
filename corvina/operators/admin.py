"""Operations: metrics, retention, blocked domains, deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.functions import crawl as cr
from corvina.functions.urls import host
from corvina.operators.frontier import STATES, STATUSES
from corvina.operators.skew import heavy_light_join
from corvina.session import MOST_SENT, sent_if_small, stage


def job_summary(jobs: DataFrame) -> DataFrame:
    """One row: jobs by status, zero-filled, and in all."""
    return jobs.agg(*cr.zero_filled(F.col("status"), STATUSES), F.count("*").alias("total"))


def metrics(documents: DataFrame, jobs: DataFrame, frontier: DataFrame) -> DataFrame:
    """One row: documents, jobs by status, frontier by state, entries retried, failures."""
    a = documents.agg(F.count("*").alias("documents"), F.coalesce(F.round(F.avg("quality_score"), 6), F.lit(0.0)).alias("mean_quality"))
    b = jobs.agg(F.count("*").alias("jobs"), *[c.alias(f"jobs_{s}") for c, s in zip(cr.zero_filled(F.col("status"), STATUSES), STATUSES)])
    c = frontier.agg(F.count("*").alias("entries"), *[x.alias(f"entries_{s}") for x, s in zip(cr.zero_filled(F.col("state"), STATES), STATES)], F.count(F.when((F.col("state") == "queued") & (F.col("attempts") > 0), 1)).alias("retrying"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def counted(documents: DataFrame, column: str) -> DataFrame:
    """(value, documents) by a column, null as ``unknown``."""
    return documents.groupBy(F.coalesce(column, F.lit("unknown")).alias("value")).agg(F.count("*").alias("documents"))


def expired_jobs(jobs: DataFrame, cutoff: str) -> DataFrame:
    """Finished jobs last changed before a cutoff."""
    return jobs.where(F.col("status").isin("complete", "failed", "cancelled") & (F.col("updated_at") < cutoff))


def retention_preview(documents: DataFrame, jobs: DataFrame, frontier: DataFrame, cutoff: str) -> DataFrame:
    """One row: how many jobs, frontier entries of theirs, and documents a sweep up to a cutoff would delete."""
    old = expired_jobs(jobs, cutoff)
    entries = frontier.join(old.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return old.agg(F.count("*").alias("jobs")).crossJoin(entries.agg(F.count("*").alias("entries"))).crossJoin(documents.where(F.col("indexed_at") < cutoff).agg(F.count("*").alias("documents")))


def sweep(documents: DataFrame, links: DataFrame, jobs: DataFrame, frontier: DataFrame, cutoff: str) -> dict[str, DataFrame]:
    """The tables after a sweep."""
    old = expired_jobs(jobs, cutoff).select("id")
    gone = documents.where(F.col("indexed_at") < cutoff).select("url")
    return {
        "jobs": jobs.join(old, "id", "left_anti"),
        "frontier": frontier.join(old.withColumnRenamed("id", "job_id"), "job_id", "left_anti"),
        "documents": documents.join(gone, "url", "left_anti"),
        "links": without_links(links, gone),
    }


def without_links(links: DataFrame, urls: DataFrame) -> DataFrame:
    """Links that neither start nor end at any of ``urls``.

    The addresses that go are joined by broadcast where they are few enough by count.  Otherwise the links are joined by
    shuffle, those to a target that holds many of them apart (``heavy_light_join``).
    """
    gone = sent_if_small(urls.select(F.col("url").alias("target_url")).where("target_url IS NOT NULL").distinct(), "gone")
    kept = links.select("source_url", "target_url").join(gone.withColumnRenamed("target_url", "source_url"), "source_url", "left_anti")
    if gone.isEmpty() or gone.count() <= MOST_SENT:
        return kept.join(gone, "target_url", "left_anti").select("source_url", "target_url")
    kept = stage(kept, "links")
    weights = kept.groupBy("target_url").agg(F.count("*").alias("weight")).join(gone.withColumn("gone", F.lit(True)), "target_url", "left")
    marked = heavy_light_join(kept, weights, "target_url", "weight", kept.count(), how="left")
    return marked.where("gone IS NULL").select("source_url", "target_url")


def block_domains(documents: DataFrame, links: DataFrame, jobs: DataFrame, frontier: DataFrame, blocks: DataFrame) -> dict[str, DataFrame]:
    """The tables after blocking domains: their documents, links and frontier entries go, active jobs seeded there are cancelled."""
    names = blocks.select(F.lower("domain").alias("site")).distinct()
    gone = documents.select("url", host(F.col("url")).alias("site")).join(names, "site", "left_semi").select("url")
    hit = jobs.select("id", host(F.col("seed_url")).alias("site")).join(names, "site", "left_semi").select("id", F.lit(True).alias("hit"))
    cancelled = F.coalesce("hit", F.lit(False)) & F.col("status").isin("queued", "running", "paused")
    return {
        "documents": documents.join(gone, "url", "left_anti"),
        "links": without_links(links, gone),
        "frontier": frontier.withColumn("site", F.lower("host")).join(names, "site", "left_anti").drop("site"),
        "jobs": jobs.join(hit, "id", "left").withColumn("status", F.when(cancelled, "cancelled").otherwise(F.col("status"))).drop("hit"),
    }


def delete_domain(documents: DataFrame, links: DataFrame, domain: str) -> tuple[DataFrame, DataFrame]:
    """Documents and links without the https pages of a domain."""
    root = f"https://{domain}"
    mine = (F.col("url") == root) | F.col("url").startswith(root + "/")
    return documents.where(~mine), without_links(links, documents.where(mine).select("url"))


def skip_histogram(jobs: DataFrame) -> DataFrame:
    """(reason, pages) over the skip_reasons maps of all jobs."""
    return jobs.select(F.explode("skip_reasons").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("pages"))
