"""Aggregation and joins that stay balanced when a few keys hold most rows.

``tree_aggregate`` is a multi-level tree: rows are cut into fixed-size input chunks, each chunk is reduced where it is
read, and the partial states of a key are merged in rounds of bounded fan-in.  The number of rounds follows the number
of chunks, so no reducer ever merges more than ``fan_in`` states of one key in a round, however large the input.
``heavy_light_join`` joins rows with a keyed table in two ways: keys above a share of all rows (their number is bounded
by that share) are broadcast, the rest are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one input chunk, and states of a key merged by one reducer in a round.
CHUNK_ROWS = 65_536
FAN_IN = 32

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def _free(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each with underscores added until it clashes with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def chunk_grid(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[int, int]:
    """(partitions, chunks of the largest one) of ``df``: a job that reads no column of a table."""
    sizes = df.select(F.spark_partition_id().alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    row = sizes.agg(F.max("part").alias("part"), F.max("n").alias("n")).first()
    return (row.part + 1, -(-row.n // chunk_rows)) if row.part is not None else (1, 1)


def tree_rounds(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, tuple[str, Column]],
    *,
    chunk_rows: int = CHUNK_ROWS,
    fan_in: int = FAN_IN,
    grid: tuple[int, int] | None = None,
) -> list[tuple[DataFrame, str]]:
    """The states after every round, each with the name of the column that numbers a key's states.

    Chunks are numbered by partition, then place, so that those which are merged first come from the same partition and
    are combined before they are shuffled.  A round merges the states whose numbers agree when divided by ``fan_in``:
    an interval of ``fan_in`` numbers, so never more states than that.
    """
    (node,) = _free(df.select(*keys).withColumns({name: F.lit(0) for name in measures}), "node")
    parts, slots = chunk_grid(df, chunk_rows) if grid is None else grid
    row_id = F.monotonically_increasing_id()
    slot = F.floor(row_id.bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(chunk_rows)).cast("long")
    number = F.shiftright(row_id, 33) * F.lit(slots) + F.least(slot, F.lit(slots - 1))
    merge = [_MERGE[how](F.col(name)).alias(name) for name, (how, _) in measures.items()]
    state = df.select(*[F.col(k) for k in keys], *[value.alias(name) for name, (_, value) in measures.items()], number.alias(node))
    out, left = [], parts * slots
    while True:
        left = -(-left // fan_in)
        # The last round takes whatever is left of a key.
        next_ = F.floor(F.col(node) / F.lit(fan_in)).cast("long") if left > 1 else F.lit(0).cast("long")
        state = state.withColumn(node, next_).groupBy(*keys, node).agg(*merge)
        out.append((state, node))
        if left <= 1:
            return out


def tree_aggregate(df: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[str, Column]], **options) -> DataFrame:
    """Per-key ``measures`` (name -> (``sum`` | ``min`` | ``max``, expression)), merged in a tree (see ``tree_rounds``).

    A null key is a key of its own, as in GROUP BY; an empty table gives no rows; measures over nulls only are null.
    The number of rounds is the logarithm of the number of chunks to the base ``fan_in``.  Chunk numbers depend only on
    a row's place in its partition, so a task that is run again builds the same states.
    """
    state, node = tree_rounds(df, keys, measures, **options)[-1]
    return state.drop(node)


def tree_count_distinct(df: DataFrame, key: str, value: str, name: str, **options) -> DataFrame:
    """``key`` and the exact number of its distinct non-null ``value``s.

    Pairs are made distinct first (spread over the cluster by key and value together, so a heavy key is not one task's
    work), then counted by ``tree_aggregate``, one chunk per partition of that shuffle.  A key whose values are all null
    counts 0.
    """
    pairs = df.select(F.col(key), F.col(value)).distinct()
    grid = (int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return tree_aggregate(pairs, [key], {name: ("sum", F.col(value).isNotNull().cast("long"))}, **({"grid": grid} | options))


def heavy_keys(df: DataFrame, key: str, share: float, **options) -> DataFrame:
    """The non-null values of ``key`` that hold at least ``share`` of all rows of ``df``, as a string ``key_value``.

    At most ``1 / share`` rows.  The total counts every row, null keys too; it is one aggregate over the per-key
    counts, so the table is read once.  An empty table gives no rows.
    """
    counts = tree_aggregate(df, [key], {"key_rows": ("sum", F.lit(1).cast("long"))}, **options)
    total = counts.agg(F.sum("key_rows").alias("all_rows"))
    return (
        counts.where(F.col(key).isNotNull())
        .crossJoin(F.broadcast(total))  # one row
        .where(F.col("key_rows") >= F.col("all_rows") * F.lit(share))
        .select(F.col(key).cast("string").alias("key_value"))
    )


def heavy_light_join(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int, *, most_heavy: int = 8192, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed`` (one row per ``key``; ``weight`` is the number of ``rows`` having it).

    Keys with ``weight * most_heavy > total`` are joined by broadcast: as the weights sum to ``total`` there are fewer
    than ``most_heavy`` of them, whatever the data.  All other keys hold at most ``total / most_heavy`` rows each and
    are joined by shuffle, so no partition can receive a hot key.  ``how`` is ``inner`` or ``left``.  Null keys match
    nothing.
    """
    heavy = keyed.where(F.col(weight) * most_heavy > F.lit(total))
    marked = rows.join(F.broadcast(heavy), key, "left")
    first = marked.where(F.col(weight).isNotNull())
    rest = marked.where(F.col(weight).isNull()).select(*rows.columns)
    light = keyed.where(F.col(weight) * most_heavy <= F.lit(total))
    return first.unionByName(rest.join(light, key, how).select(*first.columns))
