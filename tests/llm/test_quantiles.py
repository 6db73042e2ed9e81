from __future__ import annotations

import numpy as np
import pytest

from lodestream.llm import quantiles as Q

POINTS = {"lo": 0.0, "mid": 0.5, "high": 0.93, "top": 1.0}
SCHEMA = "g string, day int, v double, n int, total string"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    rows = [("hot", int(d), float(np.round(v, 1)), 1, "x") for d, v in zip(rng.integers(0, 20, 6000), rng.normal(0, 5, 6000), strict=True)]
    rows += [("few", 1, 3.0, 1, "x"), (None, 1, 1.0, 1, "x"), (None, 2, 2.0, 1, "x")]
    return rows + [("hot", 1, None, 1, "x"), ("few", 1, float("nan"), 1, "x"), ("few", 2, float("inf"), 1, "x"), ("none", 1, None, 1, "x")]


def finite(data, g):
    return np.array([r[2] for r in data if r[0] == g and r[2] is not None and np.isfinite(r[2])])


def test_exact_quantiles(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.g: r for r in Q.quantiles(df, ["g"], "v", POINTS).collect()}
    assert set(got) == {"hot", "few", None}
    for g, r in got.items():
        own = finite(data, g)
        assert r.readings == len(own)
        assert np.allclose([r[n] for n in POINTS], np.quantile(own, list(POINTS.values())))


@pytest.mark.parametrize("error", [0.001, 0.02, 0.2])
def test_merged_days_keep_the_rank_error(spark, data, error):
    df = spark.createDataFrame(data, SCHEMA)
    days = Q.summary(df, ["g", "day"], "v", error).cache()
    sizes = {(r.g, r.day): r["count"] for r in days.groupBy("g", "day").count().collect()}
    assert max(sizes.values()) <= 2 + 2 / error
    parts = days.where("day < 10").union(days.where("day >= 10"))
    for r in Q.merged_quantiles(parts, ["g"], POINTS).collect():
        own = np.sort(finite(data, r.g))
        assert r.readings == len(own)
        for name, q in POINTS.items():
            lowest, highest = np.searchsorted(own, r[name], "left"), np.searchsorted(own, r[name], "right")
            assert lowest - error * len(own) - 1 <= q * len(own) <= highest + error * len(own) + 1
            assert r[name] in own


def test_empty_tables(spark, data):
    none = spark.createDataFrame(data, SCHEMA).limit(0)
    assert Q.quantiles(none, ["g"], "v", POINTS).count() == 0
    assert Q.merged_quantiles(Q.summary(none, ["g"], "v", 0.1), ["g"], POINTS).count() == 0


def test_melted_keeps_the_field_names(spark):
    df = spark.createDataFrame([(1, 2.0, 5), (2, float("nan"), None)], "g int, a double, b int")
    assert sorted(tuple(r) for r in Q.melted(df, ["g"], ["a", "b"]).collect()) == [("a", 1, 2.0), ("b", 1, 5.0)]
