from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import packing as P


def best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= s]
        if fit:
            gaps[min(fit, key=lambda i: gaps[i])] -= s
        else:
            gaps.append(capacity - s)
    return gaps


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=60), st.lists(st.integers(0, 60), max_size=4))
def test_brackets_within_and_across_ranges_equal_one_stack(opens, edges):
    stack, want = [], set()
    for i, o in enumerate(opens):
        if o:
            stack.append(i)
        elif stack:
            want.add((stack.pop(), i))
    bounds = [0, *sorted(min(e, len(opens)) for e in edges), len(opens)]
    got, left, counts = set(), {}, []
    for part, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        x = np.array(opens[lo:hi], bool)
        a, b = P.brackets(x)
        got |= {(lo + int(i), lo + int(j)) for i, j in zip(a, b, strict=True)}
        used = set(a.tolist()) | set(b.tolist())
        documents = [lo + i for i in range(hi - lo) if i not in used and not x[i]]
        places = [lo + i for i in range(hi - lo) if i not in used and x[i]]
        left[part] = documents, places
        counts.append((part, len(documents), len(places)))
    meets, many = P._across(counts)
    across = {(left[of][1][total - r], left[part][0][r]) for part, lo, hi, of, total in meets for r in range(lo, hi)}
    assert len(across) == many and got | across == want


SCHEMA = "id long, size long, container string, _size int, position int"


def packed(spark, sizes, capacity=100):
    df = spark.createDataFrame([(i, s, "x", 1, 2) for i, s in enumerate(sizes)], SCHEMA)
    return P.packed(df, "id", "size", capacity)


def test_documents_are_whole_unless_too_large(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(0, 60, 800)] + [100, 101, 250, 1000, None, 0] + [50] * 300
    rows = packed(spark, sizes).collect()
    by, load = defaultdict(list), Counter()
    for r in rows:
        by[r.id].append(r)
        load[r.container] += r["size"]
    assert max(load.values()) <= 100 and set(by) == set(range(len(sizes)))
    for i, s in enumerate(sizes):
        s = s or 0
        assert sum(r["size"] for r in by[i]) == s and len(by[i]) == max(1, -(-s // 100))
        assert sorted(r["size"] for r in by[i])[1:] == [100] * (len(by[i]) - 1)
    total = sum(s or 0 for s in sizes)
    assert len([v for v in load.values() if v]) <= 1.03 * total / 100 + 1
    full = P.containers(packed(spark, sizes), 100).collect()
    assert all(r.used + r.unused == 100 for r in full) and sum(r.used for r in full) == total


@pytest.mark.parametrize(("low", "high", "many"), [(1, 100, 600), (30, 55, 500), (1, 4, 900), (51, 100, 60), (26, 50, 300), (100, 100, 7)])
def test_about_as_few_containers_as_best_fit_decreasing(spark, low, high, many):
    sizes = np.random.default_rng(low + high).integers(low, high + 1, many).tolist()
    rows = packed(spark, sizes).collect()
    load = Counter()
    for r in rows:
        load[r.container] += r["size"]
    assert len(rows) == many and max(load.values()) <= 100
    assert len(load) <= 1.04 * len(best_fit(sizes, 100)) + 1


def test_a_third_of_one_size_and_a_large_capacity(spark):
    sizes = [333_333] * 300 + [250_000] * 200 + list(range(1, 401))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, size long")
    load = Counter()
    for r in P.packed(df, "id", "size", 1_000_000).collect():
        load[r.container] += r["size"]
    assert sum(load.values()) == sum(sizes) and max(load.values()) <= 1_000_000 and len(load) <= 152


def test_empty_and_zero(spark):
    assert packed(spark, []).count() == 0
    assert [(r.container, r["size"]) for r in packed(spark, [0, None]).collect()] == [(0, 0), (0, 0)]
    with pytest.raises(ValueError):
        packed(spark, [1], 0)
