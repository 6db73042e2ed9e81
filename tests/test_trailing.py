from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.operators import trailing as R

START = dt.date(2025, 1, 1)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 31), st.integers(0, 31))
def test_cover_is_exact_and_short(a, b):
    nodes, got = R.cover(a, b), []
    for n in nodes:
        width = 1 << (5 - n.bit_length() + 1)
        first = n * width - 32
        got += range(first, first + width)
    assert sorted(got) == list(range(a, b + 1)) and len(nodes) <= 10


def brute(rows, periods):
    """rows: entity, day, value, once each."""
    out = {}
    for e in {r[0] for r in rows}:
        days = [r[1] for r in rows if r[0] == e]
        d = min(days)
        while d <= max(days):
            for p in periods:
                good = [v for k, x, v in rows if k == e and d - dt.timedelta(p - 1) <= x <= d and v is not None and v >= 0]
                out[e, d, p] = (float(sum(good)), len(good))
            d += dt.timedelta(1)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for e in (1, 2, None):
        for d in sorted(rng.sample(range(200), 40)) + [400]:  # a gap of several shards before the last
            for _ in range(rng.randint(1, 3)):
                out.append((e, START + dt.timedelta(d), rng.choice([None, -5, 0, 1, 2, 7])))
    return out


def frame(spark, rows):
    data = [(i, *r, "x", 1.0) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, e long, d date, v long, shard string, first double")
    return df.unionByName(df.limit(20))  # repeats


def answers(df):
    return {(r.e, r.day, p): (r[f"v_total_{p}"], r[f"v_readings_{p}"]) for r in df.collect() for p in (1, 7, 30)}


def test_totals_equal_brute_force_with_gaps_repeats_and_nulls(spark, rows):
    got = R.trailing_totals(frame(spark, rows), "e", "d", ["v"], [1, 7, 30], "id")
    assert answers(got) == brute(rows, (1, 7, 30))
    one = got.where("v_readings_7 = 0").select("v_mean_7", "v_day_mean_7").distinct().collect()
    assert [tuple(r) for r in one] == [(None, 0.0)]


def test_corrections_change_one_path_and_give_the_new_totals(spark, rows):
    forest = R.trees(R.leaves(frame(spark, rows), "e", "d", ["v"], "id"), "e", "d", ["v"])
    forest = forest.cache()
    late = [(1, rows[0][1], 10), (2, START + dt.timedelta(300), 4), (9, START, 3)]  # an old day, a new shard, a new entity
    change = spark.createDataFrame([(e, d, float(v), 1) for e, d, v in late], "e long, d date, s_v double, c_v long")
    new = R.corrected(forest, change, "e", "d", ["v"])
    assert answers(R.trailing(new, "e", ["v"], [1, 7, 30])) == brute(rows + late, (1, 7, 30))
    old = {(r.e, r.shard): r.s_v for r in forest.collect()}
    moved = {k: [i for i, (a, b) in enumerate(zip(old[k], v, strict=True)) if a != b] for k, v in ((((r.e, r.shard)), r.s_v) for r in new.collect()) if k in old}
    assert sorted(len(v) for v in moved.values() if v) == [6]
    assert answers(R.trailing(R.corrected(forest, change.limit(0), "e", "d", ["v"]), "e", ["v"], [7, 1, 30])) == brute(rows, (1, 7, 30))


def test_empty_and_undated_rows(spark, rows):
    none = frame(spark, rows).limit(0)
    assert R.trailing_totals(none, "e", "d", ["v"], [7], "id").count() == 0
    undated = frame(spark, rows).withColumn("d", F.lit(None).cast("date"))
    assert R.trailing_totals(undated, "e", "d", ["v"], [7]).count() == 0
    with pytest.raises(ValueError):
        R.trailing(R.trees(R.leaves(none, "e", "d", ["v"]), "e", "d", ["v"]), "e", ["v"], [33])


def test_values_that_are_no_numbers_are_no_readings(spark):
    df = spark.createDataFrame([(1, START, float("nan")), (1, START, float("inf")), (1, START, 2.5), (1, START, None)], "e long, d date, v double")
    r = R.trailing_totals(df, "e", "d", ["v"], [7]).first()
    assert (r.v_total_7, r.v_readings_7) == (2.5, 1)
