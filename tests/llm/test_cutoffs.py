from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestream.llm import cutoffs as C

SCHEMA = "id long, src string, s double, cutoff double, n int, _s string, total string"


def table(spark, rows):
    return spark.createDataFrame([(i, src, s, 0.0, 1, "x", "t") for i, (src, s) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [("hot", round(rng.random(), 2)) for _ in range(600)] + [("few", round(rng.random(), 1)) for _ in range(7)]
    return out + [("ties", 0.5)] * 40 + [("ties", 0.25)] * 10 + [(None, 0.9), ("hot", None), ("hot", float("nan")), ("few", float("inf")), ("lone", 0.1)]


def finite(rows, src):
    return sorted((s for k, s in rows if k == src and s is not None and s == s and s != float("inf")), reverse=True)


TARGETS = [("hot", 0.1), ("few", 0.3), ("ties", 0.2), ("absent", 0.5), (None, 0.5)]


def test_cutoff_is_the_highest_that_keeps_enough(spark, rows):
    df, goal = table(spark, rows), spark.createDataFrame(TARGETS, "src string, f double")
    cuts = C.cutoffs(df, goal, "src", "s", "f").cache()
    by = {r.src: r for r in cuts.collect()}
    assert set(by) == {"hot", "few", "ties", "absent", "lone"}
    for src, f in TARGETS[:3]:
        s = finite(rows, src)
        want = max(v for v in s if sum(x >= v for x in s) / len(s) >= f)
        assert (by[src].cutoff, by[src].kept, by[src].total) == (want, sum(x >= want for x in s), len(s))
    assert (by["absent"].cutoff, by["absent"].total, by["absent"].share) == (None, 0, None)
    assert (by["lone"].cutoff, by["lone"].kept, by["lone"].total) == (None, 0, 1)
    kept = C.kept(df, cuts, "src", "s")
    assert kept.columns == df.columns
    assert {r.src: r["count"] for r in kept.groupBy("src").count().collect()} == {s: by[s].kept for s, _ in TARGETS[:3]}


def test_closest_may_stay_below_the_target(spark, rows):
    df, goal = table(spark, rows), spark.createDataFrame(TARGETS, "src string, f double")
    by = {r.src: r for r in C.cutoffs(df, goal, "src", "s", "f", closest=True).collect()}
    for src, f in TARGETS[:3]:
        s = finite(rows, src)
        want = min(set(s), key=lambda v: (abs(sum(x >= v for x in s) / len(s) - f), -v))
        assert by[src].cutoff == want
    assert by["lone"].cutoff is None


def test_empty_tables(spark, rows):
    df, goal = table(spark, rows), spark.createDataFrame(TARGETS, "src string, f double")
    cuts = C.cutoffs(df.limit(0), goal, "src", "s", "f")
    assert {(r.cutoff, r.kept) for r in cuts.collect()} == {(None, 0)}
    assert C.kept(df, cuts, "src", "s").count() == 0
    assert C.cutoffs(df, goal.limit(0), "src", "s", "f").where(F.col("cutoff").isNotNull()).count() == 0
