from __future__ import annotations

import numpy as np
import pytest

from lodestream.llm import ranking as K

COLS = ["a", "b", "c"]
SCHEMA = "id long, a double, b double, c double, position string, missing string"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    x = np.stack([rng.normal(size=500), 1e6 * rng.pareto(1.2, 500), rng.random(500)], 1)
    x[:5] = [9, 1e12, 2]  # leads everywhere
    x[5] = [-9, 1e15, 0.5]  # only the largest range
    rows = [[i, *map(float, r), "p", "m"] for i, r in enumerate(x)]
    rows[10][1], rows[11][2], rows[12][3] = None, float("nan"), float("inf")
    return rows


def brute(data, limits=(0.02, 0.98)):
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in data], float)
    x[~np.isfinite(x)] = np.nan
    lo, mid, hi = (np.nanquantile(x, q, axis=0) for q in (limits[0], 0.5, limits[1]))
    y = np.clip(np.where(np.isnan(x), mid, x), lo, hi)
    norm = np.sqrt((y**2).sum(0))
    up, down = (np.sqrt((((e - y) / norm) ** 2).sum(1)) for e in (hi, lo))
    return down / (up + down)


def test_closeness_equals_numpy(spark, data):
    got = {r.id: r for r in K.ranking(spark.createDataFrame([tuple(r) for r in data], SCHEMA), "id", COLS).collect()}
    want = brute(data)
    assert np.allclose([got[i].closeness for i in range(len(data))], want)
    assert sorted(r.position for r in got.values()) == list(range(1, 501))
    order = sorted(got.values(), key=lambda r: r.position)
    assert all((-p.closeness, p.id) <= (-q.closeness, q.id) for p, q in zip(order, order[1:], strict=False))
    assert {r.id for r in order[:5]} == set(range(5)) and all(r.closeness == 1.0 for r in order[:5])
    assert got[5].position > 10 and [got[i].missing for i in (9, 10, 11, 12)] == [0, 1, 1, 1]


def test_the_unit_of_a_score_does_not_matter(spark, data):
    df = spark.createDataFrame([tuple(r) for r in data], SCHEMA)
    scaled = df.withColumn("b", df.b * 1e-4).withColumn("c", df.c * 5e3)
    one, other = ({r.id: r.closeness for r in K.closeness(x, COLS).collect()} for x in (df, scaled))
    assert np.allclose([one[i] for i in sorted(one)], [other[i] for i in sorted(one)], atol=1e-9)


def test_weights_shift_the_ranking(spark, data):
    df = spark.createDataFrame([tuple(r) for r in data], SCHEMA)
    only = K.closeness(df, COLS, weights={"a": 1.0, "b": 0.0, "c": 0.0}).orderBy("closeness").collect()
    values = [r.a if r.a is not None and np.isfinite(r.a) else None for r in only]
    kept = [v for v in values if v is not None]
    assert all(p <= q + 1e-9 or q >= np.quantile([v for v in kept], 0.97) or p <= np.quantile(kept, 0.03) for p, q in zip(kept, kept[1:], strict=False))


def test_constant_empty_and_null_columns(spark, data):
    df = spark.createDataFrame([(1, 5.0, None, 1.0, "", ""), (2, 5.0, None, 1.0, "", "")], SCHEMA)
    assert {r.closeness for r in K.closeness(df, COLS).collect()} == {0.5}
    assert K.ranking(df.limit(0), "id", COLS).count() == 0
