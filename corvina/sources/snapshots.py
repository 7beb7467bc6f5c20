"""Snapshots of the tables: writing, listing, verifying, comparing, pruning.  Backups of notes as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of the layout that is written; a newer one is refused.
SCHEMA_VERSION = 1


def write(tables: dict[str, DataFrame], path: str, name: str) -> DataFrame:
    """Write each table as Parquet under ``path/name`` with a manifest (table_name, row_count, schema_version); returns the manifest.

    Counts are taken from what was written, so the snapshot describes itself.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/{table}")
        rows.append((table, spark.read.parquet(f"{path}/{name}/{table}").count(), SCHEMA_VERSION))
    manifest = spark.createDataFrame(rows, "table_name string, row_count long, schema_version int")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/{name}/_manifest")
    return manifest


def verify(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(table_name, row_count, found, is_valid): the manifest against what is there and a version that can be read."""
    manifest = spark.read.schema("table_name string, row_count long, schema_version int").json(f"{path}/{name}/_manifest")
    found = [(r.table_name, spark.read.parquet(f"{path}/{name}/{r.table_name}").count()) for r in manifest.collect()]
    counted = spark.createDataFrame(found, "table_name string, found long")
    valid = (F.col("row_count") == F.col("found")) & (F.col("schema_version") <= SCHEMA_VERSION)
    return manifest.join(counted, "table_name", "left").select("table_name", "row_count", "found", F.coalesce(valid, F.lit(False)).alias("is_valid"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks and the other way round, with ``side``; empty if both hold the same rows as often."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the snapshots below ``path``, newest first, then by name descending."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return []
    found = [(s.getModificationTime(), s.getPath().getName()) for s in system.listStatus(hadoop) if s.isDirectory()]
    return [n for _, n in sorted(found, reverse=True)]


def prune(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Delete all but the newest ``keep`` snapshots; returns the names that went."""
    gone = names(spark, path)[max(0, keep) :]
    for name in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return gone


def export_notes(notes: DataFrame, path: str) -> None:
    """Notes as JSON lines."""
    notes.write.mode("overwrite").json(path)


def read_notes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Notes from JSON lines; lines that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
