from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestream.operators import balance as B


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key, a tenth on null, the rest on few rows each."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 500 + 100)
    return spark.range(6000).select(key.cast("long").alias("k"), F.col("id").alias("v"), F.lit("x").alias("rows"), F.lit(1).alias("_rows"), F.lit(2).alias("_task")).cache()


def test_tasks_are_even(spark, skewed):
    p = B.plan(skewed, "k", tasks=8)
    assert max(p.loads) < 1.2 * sum(p.loads) / 8 and p.rows == 6000
    sizes = [r["count"] for r in B.fragments(skewed, p).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 6000 and max(sizes) < 1.3 * 750


def test_results_equal_a_plain_aggregate(skewed):
    got = B.balanced_results(skewed, "k", {"a": F.count("*"), "b": F.count_distinct("v"), "c": F.max("v")}, {"n": F.sum("a"), "d": F.sum("b"), "m": F.max("c")}, ["v"], tasks=8)
    want = skewed.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("v").alias("d"), F.max("v").alias("m"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_equals_a_plain_join(spark, skewed, how):
    right = spark.createDataFrame([(7, "hot", 1), (7, "twice", 2), (103, "few", 3), (None, "never", 4), (999999, "absent", 5)], "k long, name string, rows int")
    got = B.balanced_join(skewed, right, "k", how, tasks=8)
    want = skewed.join(right.drop("rows"), "k", how).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_only_the_rows_move_once(skewed):
    plan = B.balanced_results(skewed, "k", {"a": F.count("*")}, {"n": F.sum("a")}, tasks=8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Exchange ") == 2  # to the tasks, and the partial rows by key


def test_empty_tables(spark, skewed):
    none = skewed.limit(0)
    assert B.balanced_results(none, "k", {"a": F.count("*")}, {"n": F.sum("a")}).count() == 0
    assert B.heavy_keys(none, "k", 0.1).count() == 0
    assert B.balanced_join(none, skewed, "k").count() == 0
    assert B.balanced_join(skewed, none.select("k"), "k", "left").count() == 6000


def test_heavy_keys_count_nulls_in_the_total_only(spark):
    df = spark.createDataFrame([(1,)] * 5 + [(None,)] * 4 + [(2,)], "k long")
    assert [(r.k, r.rows) for r in B.heavy_keys(df, "k", 0.5).collect()] == [(1, 5)]
    assert B.heavy_keys(df, "k", 0.51).count() == 0


def test_only_two_kinds_of_join(skewed):
    with pytest.raises(ValueError):
        B.balanced_join(skewed, skewed, "k", "full")
