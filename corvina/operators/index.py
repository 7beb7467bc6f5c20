"""Building and keeping the index: duplicates, upserts, links, compaction."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.operators import search

#: Links of a page that are indexed.
MOST_LINKS = 100


def content_hash(text: Column, most: int = 100_000) -> Column:
    """SHA-256 of a text as far as it is indexed."""
    return F.sha2(F.substring(text, 1, most), 256)


def first_of_copies(documents: DataFrame) -> DataFrame:
    """(text_hash, url, copies) of the first document (by time, then url) of every text; null hashes are left out.

    An aggregate with map-side combining, no window: a text copied a million times is still one small state.
    """
    first = F.min(F.struct("indexed_at", "url"))
    return documents.where(F.col("text_hash").isNotNull()).groupBy("text_hash").agg(first.alias("first"), F.count("*").alias("copies")).select("text_hash", F.col("first.url").alias("url"), "copies")


def duplicates(documents: DataFrame) -> DataFrame:
    """(url, duplicate_of) of every document whose text an earlier one has."""
    first = first_of_copies(documents).select("text_hash", F.col("url").alias("duplicate_of"))
    return documents.select("url", "text_hash").join(first, "text_hash").where("url <> duplicate_of").select("url", "duplicate_of")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of every key by ``order``, through max_by: keyed upsert as union and latest."""
    rest = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(rest, F.struct(*order)).alias("row")).select("row.*")


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``changes`` added, or put in place of those with the same keys.  Of several changes with the same keys any one is kept."""
    return existing.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes.dropDuplicates(keys), allowMissingColumns=True)


def index_batch(documents: DataFrame, links: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and links after indexing ``batch`` (url, canonical_url, title, text, text_hash, indexed_at, outbound_links, ...).

    A page is kept under its canonical URL.  One whose text another page already has, earlier in the index or else first
    in the batch, is a duplicate: any former version of it goes, with its links in both directions.  Others replace
    their former version.  Links to the page itself and repeated ones are left out, MOST_LINKS kept.
    """
    keyed = batch.withColumn("url", F.coalesce("canonical_url", "url"))
    keyed = latest(keyed, ["url"], F.col("indexed_at"), F.col("text_hash"))
    known = documents.groupBy("text_hash").agg(F.min(F.struct("indexed_at", "url")).alias("k")).select("text_hash", F.col("k.url").alias("known_url"))
    joined = keyed.join(known, "text_hash", "left")
    in_batch = joined.where("known_url IS NULL").groupBy("text_hash").agg(F.min(F.struct("indexed_at", "url")).alias("b")).select("text_hash", F.col("b.url").alias("batch_url"))
    joined = joined.join(in_batch, "text_hash", "left").withColumn("keeper", F.coalesce("known_url", "batch_url"))
    fresh = joined.where("keeper = url").drop("known_url", "batch_url", "keeper")
    touched = joined.select("url").distinct()
    lost = joined.where("keeper <> url").select("url").distinct()
    kept = documents.join(touched, "url", "left_anti")
    out = fresh.select("url", F.explode(F.slice(F.array_distinct(F.filter("outbound_links", lambda t: t != F.col("url"))), 1, MOST_LINKS)).alias("target_url"))
    old = links.join(touched.withColumnRenamed("url", "source_url"), "source_url", "left_anti").join(lost.withColumnRenamed("url", "target_url"), "target_url", "left_anti")
    return kept.unionByName(fresh.select(*[c for c in documents.columns if c in fresh.columns]), allowMissingColumns=True), old.unionByName(out.withColumnRenamed("url", "source_url"))


def first_links(links: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct links of each source, by target; counted from partial top lists, not by sorting a hot source in one task."""
    edges = links.where("source_url IS NOT NULL AND target_url IS NOT NULL AND source_url <> target_url").distinct()
    salted = Window.partitionBy("source_url", F.pmod(F.xxhash64("target_url"), F.lit(16))).orderBy("target_url")
    partial = edges.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= most)
    whole = Window.partitionBy("source_url").orderBy("target_url")
    return partial.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= most).select("source_url", "target_url")


#: Tokens of a file of the stored postings, about, and the least it is worth giving a core a file of its own for.
FILE_TOKENS, LEAST_TOKENS = 4_000_000, 100_000


@dataclass(frozen=True)
class Stored:
    """A stored index: postings and n-grams in folders by the token's first character, corpus statistics, link authority."""

    spark: SparkSession
    path: str

    def _read(self, name: str, schema: str) -> DataFrame:
        """A part of the index, which has no files if it is empty."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def postings(self) -> DataFrame:
        """One row per occurrence, as ``search.hits`` takes them: it brings a document's positions together itself."""
        return self._read("postings", "token string, url string, field string, pos int, length int, lead int").withColumn("positions", F.array("pos")).drop("pos")

    @property
    def grams(self) -> DataFrame:
        return self._read("grams", "token string, url string, lead int")

    @property
    def statistics(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/statistics")

    @property
    def authority(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/authority")


def _by_token(rows: DataFrame, files: int, path: str) -> None:
    """Rows in ``files`` ranges of (folder, token, url), each sorted: a token of any frequency may fill several files, a rare one shares its own."""
    held = rows.withColumn("lead", search.lead(F.col("token")))
    held.repartitionByRange(files, "lead", "token", "url").sortWithinPartitions("lead", "token", "url").write.partitionBy("lead").mode("overwrite").parquet(path)


def build(documents: DataFrame, links: DataFrame, quality: DataFrame, path: str, file_tokens: int = FILE_TOKENS) -> Stored:
    """Write the index of (url, title, text) below ``path``; ``links`` and ``quality`` (url, quality_score) give the authority.

    Occurrences are shuffled once, to their place in the order of tokens.
    A query's tokens prune folders by their first character and row groups by their sorted tokens, also for a prefix.
    The number of files follows the number of tokens, and hot tokens are split over files.
    """
    spark = documents.sparkSession
    search.corpus_stats(search.document_lengths(documents)).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
    row = spark.read.parquet(f"{path}/statistics").first()
    tokens = (row.n or 0) * (row.avgdl or 0.0)
    # Ranges of about ``file_tokens``; a small index has as many as there are cores, so that none sorts it alone.
    files = max(1, math.ceil(tokens / file_tokens), min(spark.sparkContext.defaultParallelism, math.ceil(tokens / LEAST_TOKENS)))
    _by_token(search.occurrences(documents), files, f"{path}/postings")
    _by_token(search.ngram_postings(documents), files, f"{path}/grams")
    search.authority(links, quality).write.mode("overwrite").parquet(f"{path}/authority")
    return Stored(spark, path)


def out_degree(links: DataFrame) -> DataFrame:
    """(source_url, outbound) over distinct links."""
    return links.where("source_url IS NOT NULL AND target_url IS NOT NULL").distinct().groupBy("source_url").agg(F.count("*").alias("outbound"))
