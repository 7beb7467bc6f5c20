"""Session helpers: reading tables, shipping the package to executors, cutting lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``directory``."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make the package importable by Python workers on other machines.

    In local mode workers share the driver's import path and nothing is done.  On a cluster the sources (well under
    1 MB) are zipped and added once per application.
    """
    context = spark.sparkContext
    if context.master.startswith("local[") or context.master == "local" or getattr(context, "_corvina_shipped", False):
        return
    handle, archive = tempfile.mkstemp(suffix=".zip", prefix="corvina-")
    os.close(handle)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(archive)
    context._corvina_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: that of ``spark.checkpoint.dir``.

    Only a local master, whose executors are threads of the driver, may do without: it gets a temporary folder.  On a
    cluster a folder of one machine would be missing on the others, so this raises.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(context, "_corvina_folder", None)
        if folder is None:
            folder = context._corvina_folder = "file://" + tempfile.mkdtemp(prefix="corvina-shared-")
    return folder


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the driver's Python ends."""
    jvm, configuration = spark._jvm, spark._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(configuration).delete(where, True)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(drop)


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut, and what reads it twice computes it once.

    The files are deleted when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corvina-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a staged table that are sent to all workers at most; a larger one is joined by shuffle, with the same result.
MOST_SENT = 200_000


def sent_if_small(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """``df`` staged, and marked for a broadcast join only if its rows, counted, number at most ``most`` (``MOST_SENT``)."""
    staged = stage(df, name)
    return F.broadcast(staged) if staged.count() <= (MOST_SENT if most is None else most) else staged


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores by a hash of ``keys``, if its files are so few that half of the cores or more would be idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() * 2 <= cores else df


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
