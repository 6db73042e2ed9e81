from __future__ import annotations

import pytest

from lodestream.llm import mixing as M

SCHEMA = "id long, source string, size long, rate string, total int"


@pytest.mark.parametrize(("rate", "cap"), [(0.01, 1), (0.5, 1), (0.5, 4), (1.7, 2), (2.9, 3), (3.0, 8)])
def test_the_capped_mean_is_the_rate(rate, cap):
    cdf = M.capped_poisson(rate, cap)
    assert len(cdf) == cap and cdf == sorted(cdf)
    assert abs(cap - sum(cdf) - rate) < 1e-6


def test_rates_at_the_ends():
    assert M.capped_poisson(4.0, 4) == [0.0] * 4 and M.capped_poisson(9.0, 2) == [0.0, 0.0]
    assert M.capped_poisson(0.0, 3) == [1.0] * 3


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " Big " if i % 2 else "BIG", 10) for i in range(4000)] + [(5000 + i, "small", 10) for i in range(300)] + [(9000, None, 50), (9001, "  ", 50), (9002, "other", 60), (9003, "small", None)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


WEIGHTS = [("big", 0.5, 1), ("Small", 0.3, 2), ("absent", 0.2, 3)]


def test_shares_caps_and_order(spark, docs):
    mixture, report = M.mixed(docs, spark.createDataFrame(WEIGHTS, "source string, target_weight double, max_repeats int"), "id", "source", "size", seed=3)
    by = {r.source: r for r in report.collect()}
    assert set(by) == {"big", "small", "absent"} and by["big"].total == 43060
    assert (by["big"].reachable, by["small"].reachable, by["absent"].reachable) == (True, False, False)
    assert by["small"]["size"] == 6000 and by["absent"].documents == 0 and by["absent"].target_share is None
    assert abs(by["big"].target_share - 0.625) < 1e-9 and abs(by["big"].actual_share - 0.625) <= by["big"].tolerance < 0.12
    assert abs(sum(r.actual_share for r in by.values()) - 1) < 1e-9
    rows = mixture.collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.id, []).append(r.repeat)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in seen.values())
    assert max(len(v) for k, v in seen.items() if k < 5000) == 1 and {len(v) for k, v in seen.items() if k >= 5000} == {2}
    assert not {9000, 9001, 9002} & set(seen) and sorted(r.position for r in rows) == list(range(1, len(rows) + 1))
    first = [r.source for r in sorted(rows, key=lambda r: r.position)[:1000]]
    assert 0.1 < first.count("small") / 1000 < 0.4  # shuffled
    again, _ = M.mixed(docs, spark.createDataFrame(WEIGHTS, "source string, target_weight double, max_repeats int"), "id", "source", "size", seed=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_reachable_sources_reach_their_share_of_the_mixture(spark):
    many = {"a": 3000, "b": 1500, "c": 900, "d": 60}
    df = spark.createDataFrame([(i, s, 5 + i % 40, "x", 1) for i, s in enumerate(s for s, n in many.items() for _ in range(n))], SCHEMA)
    weights = [("a", 0.2, 2), ("b", 0.3, 2), ("c", 0.4, 4), ("d", 0.1, 3)]
    table = spark.createDataFrame(weights, "source string, target_weight double, max_repeats int")
    by = {r.source: r for r in M.mixed(df, table, "id", "source", "size")[1].collect()}
    assert [by[s].reachable for s in "abcd"] == [True, True, True, False]
    for s in "abc":
        assert abs(by[s].actual_share - by[s].target_share) <= by[s].tolerance < 0.12
        assert by[s].rate <= by[s].max_repeats
    assert by["d"]["size"] == 3 * by["d"].own
    whole = {r.source: r for r in M.mixed(df, table, "id", "source", "size", shrink=False)[1].collect()}
    assert abs(whole["c"]["size"] / whole["c"].total - 0.4) < 0.04 and whole["c"]["size"] > by["c"]["size"]


def test_the_spread_of_the_repeats():
    steps = M.capped_poisson(1.3, 3)
    chances = [a - b for a, b in zip([*steps, 1.0], [0.0, *steps], strict=True)]
    mean = sum(k * p for k, p in enumerate(chances))
    assert abs(M.spread(steps) - sum(p * (k - mean) ** 2 for k, p in enumerate(chances))) < 1e-9 and M.spread([0.0, 0.0]) == 0


def test_empty_tables(spark, docs):
    weights = spark.createDataFrame(WEIGHTS, "source string, target_weight double, max_repeats int")
    mixture, report = M.mixed(docs.limit(0), weights, "id", "source", "size")
    assert mixture.count() == 0 and {r["size"] for r in report.collect()} == {0}
    mixture, report = M.mixed(docs, weights.limit(0), "id", "source", "size")
    assert mixture.count() == 0 and report.count() == 0
