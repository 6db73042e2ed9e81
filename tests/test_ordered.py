from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestream.operators import ordered as O


def test_ranked_is_a_global_order_whatever_the_ties(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("v"), F.lit(1).alias("__x"))
    rows = O.ranked(df, [F.col("v").desc(), F.col("id").asc()]).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, 1001))
    assert [(r.v, r.id) for r in rows] == sorted(((r.v, r.id) for r in rows), key=lambda x: (-x[0], x[1]))
    assert set(rows[0].asDict()) == {"id", "v", "__x", "position"}


def test_running_counts_per_group_with_null_groups_and_ties(spark):
    data = [("a", 1.0), ("a", 1.0), ("a", 2.0), (None, 5.0), (None, 5.0), ("b", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {(r.g, r.v): (r.n, r.before, r.upto, r.total) for r in O.cumulative_frequencies(df, ["g"], "v").collect()}
    assert got == {("a", 1.0): (2, 0, 2, 3), ("a", 2.0): (1, 2, 3, 3), (None, 5.0): (2, 0, 2, 2)}
    down = {(r.g, r.v): r.before for r in O.cumulative_frequencies(df, ["g"], "v", descending=True).collect()}
    assert down == {("a", 2.0): 0, ("a", 1.0): 1, (None, 5.0): 0}


def test_interpolated_equals_numpy_over_many_partitions(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=3000), 2)
    df = spark.createDataFrame([("hot" if i % 3 else "cold", float(v)) for i, v in enumerate(x)], "g string, v double")
    got = {r.g: r for r in O.interpolated(df, ["g"], "v", {"a": 0.0, "m": 0.5, "z": 0.99}).collect()}
    for g in ("hot", "cold"):
        own = np.array([v for i, v in enumerate(x) if (i % 3 != 0) == (g == "hot")])
        assert np.allclose([got[g].a, got[g].m, got[g].z], np.quantile(own, [0, 0.5, 0.99]))
    assert O.interpolated(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def test_small_marks_only_what_is_small(spark):
    plan = lambda most: spark.range(10).join(O.small(spark.range(50), most), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(50) and "broadcast" not in plan(49)


def test_a_side_is_broadcast_only_if_few_and_narrow(spark, monkeypatch):
    def broadcast(df, *a):
        return "ResolvedHint (strategy=broadcast)" in O.small(df, *a)._jdf.queryExecution().analyzed().toString()

    df = spark.range(100).withColumn("s", F.repeat(F.lit("x"), 50)).withColumn("l", F.array("id"))
    assert broadcast(df) and not broadcast(df, 99) and broadcast(df, 100) and broadcast(df, 100, F.size("l")) and not broadcast(df, 99, F.size("l"))
    assert broadcast(df.limit(0)) and broadcast(df.where("id < 0"), 10, F.size("l"))
    monkeypatch.setattr(O, "MOST_BYTES", 100 * (3 * 8 + 50 + 8))
    assert broadcast(df)
    monkeypatch.setattr(O, "MOST_BYTES", 100 * (3 * 8 + 50 + 8) - 1)
    assert not broadcast(df)
