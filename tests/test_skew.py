from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvina.operators.skew import chunk_grid, heavy_keys, heavy_light_join, tree_aggregate, tree_count_distinct, tree_rounds
from tests.conftest import rows


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.sampled_from(["a", "b", None, ""]), st.one_of(st.none(), st.integers(-5, 5))), max_size=40))
def test_tree_equals_group_by(spark, data):
    df = spark.createDataFrame(data, "k string, v long").repartition(3)
    got = rows(tree_aggregate(df, ["k"], {"n": ("sum", F.lit(1)), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}, chunk_rows=3, fan_in=2))
    want = rows(df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    assert got == want


def test_skewed_key_is_exact_and_clashing_names_are_kept_apart(spark):
    data = [("hot", i % 7) for i in range(900)] + [(f"k{i}", 1) for i in range(100)] + [(None, 3)]
    df = spark.createDataFrame(data, "k string, chunk_part int").withColumn("chunk_slot", F.lit(1)).repartition(4)
    assert dict(rows(tree_aggregate(df, ["k"], {"n": ("sum", F.lit(1))}, chunk_rows=50))) == Counter(k for k, _ in data)
    distinct = defaultdict(set)
    for k, v in data:
        distinct[k].add(v)
    assert dict(rows(tree_count_distinct(df, "k", "chunk_part", "n"))) == {k: len(v) for k, v in distinct.items()}
    assert rows(heavy_keys(df, "k", 0.02)) == [("hot",)]


@pytest.mark.parametrize(("parts", "fan_in"), [(4, 32), (1, 16), (7, 10)])
def test_no_reducer_gets_more_than_fan_in_states(spark, parts, fan_in):
    """10,000 chunks of one key in a few partitions: every round merges at most ``fan_in`` of its states."""
    df = spark.range(0, 30_000, 1, parts).select(F.lit("hot").alias("k"), F.col("id").alias("node"))
    count = {"n": ("sum", F.lit(1).cast("long"))}
    assert chunk_grid(df, 3)[0] * chunk_grid(df, 3)[1] >= 10_000
    rounds = tree_rounds(df, ["k"], count, chunk_rows=3, fan_in=fan_in)
    assert len(rounds) == next(n for n in range(1, 9) if fan_in**n >= chunk_grid(df, 3)[0] * chunk_grid(df, 3)[1])
    received = [10_000]
    for state, name in rounds:
        received.append(state.select(name).count())
        assert state.agg(F.sum("n")).first()[0] == 30_000
    assert received[-1] == 1 and all(a <= b * fan_in for a, b in zip(received[:-1], received[1:]))
    for (before, old), (after, new) in zip(rounds[:-1], rounds[1:]):
        merged = before.groupBy("k", F.floor(F.col(old) / fan_in)).count().agg(F.max("count")).first()[0]
        assert merged <= fan_in


def test_empty_and_null_only(spark):
    empty = spark.createDataFrame([], "k string, v long")
    assert rows(tree_aggregate(empty, ["k"], {"n": ("sum", F.col("v"))})) == []
    assert rows(heavy_keys(empty, "k", 0.02)) == []
    nulls = spark.createDataFrame([(None, None), (None, None)], "k string, v long")
    assert rows(tree_count_distinct(nulls, "k", "v", "n")) == [(None, 0)]
    assert rows(heavy_keys(nulls, "k", 0.02)) == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_light_join_loses_nothing(spark, how):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("rare", 1), ("absent", 2), (None, 3)], "k string, i int")
    right = spark.createDataFrame([("hot", 50, "H"), ("rare", 1, "R"), ("unused", 0, "U")], "k string, w long, label string")
    got = rows(heavy_light_join(left, right, "k", "w", 54, most_heavy=8, how=how), "k", "i", "label")
    assert got == rows(left.join(right, "k", how), "k", "i", "label")
