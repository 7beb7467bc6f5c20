"""The personal side: notes and tags, collections kept as event logs, merges, and the link graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def toggled(events: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """(key, ts) of what a log of toggles leaves switched on, newest first, at most ``most``; an odd number of toggles is on."""
    on = events.groupBy(key).agg(F.count("*").alias("n"), F.max("ts").alias("ts")).where("n % 2 = 1").select(key, "ts")
    ordered = on.orderBy(F.desc("ts"), key)
    return ordered.limit(most) if most else ordered


def moved_to_front(events: DataFrame, owner: str, key: str, most: int) -> DataFrame:
    """(owner, key, ts) of each owner's last ``most`` different keys by their latest visit."""
    last = events.groupBy(owner, key).agg(F.max("ts").alias("ts"))
    order = Window.partitionBy(owner).orderBy(F.desc("ts"), key)
    return last.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select(owner, key, "ts")


def merged(sources: list[DataFrame], key: str, most: int) -> DataFrame:
    """First row of every key over sources (each with ``key`` and ``pos``) in their order, then by position; at most ``most``, in that order."""
    ranked = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct("source_no", "pos")).alias("row")).select("row.*")
    return first.orderBy("source_no", "pos", key).limit(most).drop("source_no")


def import_notes(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Notes of a batch that aren't there yet by (source_url, quote, body), each once."""
    keys = ["source_url", "quote", "body"]
    known = existing.select(*[F.coalesce(k, F.lit("")).alias(f"known_{k}") for k in keys]).distinct()
    match = reduce(lambda a, b: a & b, [F.coalesce(F.col(k), F.lit("")) == F.col(f"known_{k}") for k in keys])
    return batch.join(known, match, "left_anti").dropDuplicates(keys)


def with_tags(notes: DataFrame, tags: DataFrame, most: int = 12) -> DataFrame:
    """Notes with their tags: lower case, trimmed, each once, sorted, at most ``most``; none gives an empty array."""
    clean = tags.select("note_id", F.lower(F.trim("tag")).alias("tag")).where("tag <> ''")
    held = clean.groupBy(F.col("note_id").alias("id")).agg(F.slice(F.sort_array(F.collect_set("tag")), 1, most).alias("tags"))
    return notes.join(held, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def unified(document_hits: DataFrame, note_hits: DataFrame, most: int = 50) -> DataFrame:
    """(kind, key, rank) of document hits, then note hits, each (key, score, at), best first, at most ``most`` of a kind."""
    order = Window.orderBy(F.desc("score"), F.desc("at"), "key")

    def best(rows: DataFrame, kind: str, number: int) -> DataFrame:
        top = rows.orderBy(F.desc("score"), F.desc("at"), "key").limit(most)  # at most ``most`` rows meet in one place
        return top.select(F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), "key", F.row_number().over(order).alias("rank"))

    return best(document_hits, "document", 0).unionByName(best(note_hits, "note", 1)).orderBy("kind_no", "rank").drop("kind_no")


def graph(documents: DataFrame, links: DataFrame, most: int = 100, edges_each: int = 12) -> DataFrame:
    """(url, title, indexed_at, targets): the newest documents with the first links of each; none gives an empty array."""
    nodes = documents.select("url", "title", "indexed_at").orderBy(F.desc("indexed_at"), "url").limit(most)
    edges = links.join(F.broadcast(nodes.select(F.col("url").alias("source_url"))), "source_url", "left_semi").where("target_url IS NOT NULL AND target_url <> source_url")
    held = edges.groupBy(F.col("source_url").alias("url")).agg(F.slice(F.sort_array(F.collect_set("target_url")), 1, edges_each).alias("targets"))
    return nodes.join(held, "url", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))


def visible_edges(nodes: DataFrame, current: str | None = None, most: int = 45) -> DataFrame:
    """(source_url, target_url) of a graph's edges between its nodes, or from the current page; at most ``most``."""
    edges = nodes.select(F.col("url").alias("source_url"), F.explode("targets").alias("target_url"))
    inside = edges.join(nodes.select(F.col("url").alias("target_url")), "target_url", "left_semi").select("source_url", "target_url")
    if current is not None:
        inside = inside.unionByName(edges.where(F.col("source_url") == current)).distinct()
    return inside.orderBy("source_url", "target_url").limit(most)
