from __future__ import annotations

import random

import numpy as np
import pytest

from lodestream.llm import spans as S

LEAST = 200
SCHEMA = "id long, text string, doc string, t1 int, first int"


def words(rng, n, alphabet="abcdefghij éß漢😀 \n"):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    common, edge, near, boiler = words(rng, 700), words(rng, LEAST), words(rng, LEAST - 1), words(rng, 150)
    out = [words(rng, 900) for _ in range(12)]
    out += [words(rng, 300) + common + words(rng, 50), common[100:600] + words(rng, 10), words(rng, 5) + common[350:] + words(rng, 800)]
    out += [edge, words(rng, 77) + edge, words(rng, 40) + edge + words(rng, 400)]
    out += [words(rng, 60) + near + words(rng, 60), near, words(rng, 9) + near]
    out += [words(rng, 300) + boiler + words(rng, 300) for _ in range(30)]
    twice = words(rng, 250)
    out += [twice + words(rng, 100) + twice]  # repeated inside one text only
    out += ["=" * 500, "x" + "=" * 300, "ab" * 200, "c" + "ab" * 150]  # periodic texts
    out += ["", None, "short", "short"]
    out += [common] * 3 + [words(rng, 20) + common.upper()]
    return out


def brute(texts):
    grams: dict = {}
    for i, t in enumerate(texts):
        for s in range(len(t or "") - LEAST + 1):
            grams.setdefault(t[s : s + LEAST], set()).add(i)
    pairs, cover = set(), {i: set() for i in range(len(texts))}
    for g in grams.values():
        pairs |= {(a, b) for a in g for b in g if a < b}
    for i, t in enumerate(texts):
        for s in range(len(t or "") - LEAST + 1):
            if len(grams[t[s : s + LEAST]]) > 1:
                cover[i] |= set(range(s, s + LEAST))
    return pairs, {i: len(c) for i, c in cover.items()}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("window", [8, 64, 84])
def test_pairs_equal_brute_force(spark, texts, window):
    got = [(r.a, r.b) for r in S.shared_pairs(frame(spark, texts), "id", "text", LEAST, window).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts)[0]


def test_parts_equal_brute_force(spark, texts):
    rows = {r.id: r for r in S.shared_parts(frame(spark, texts), "id", "text", LEAST).collect()}
    assert {i: r.shared_chars for i, r in rows.items()} == brute(texts)[1]
    assert all(r.n_chars == len(texts[i] or "") and 0 <= r.shared <= 1 for i, r in rows.items())
    same = [i for i, t in enumerate(texts) if t == texts[-2]]
    assert {rows[i]["class"] for i in same} == {same[0]} and {rows[i].copies for i in same} == {3}


def test_members_link_what_pairs_link(spark, texts):
    rows = S.span_members(frame(spark, texts), "id", "text", LEAST).collect()
    spans: dict = {}
    for r in rows:
        assert texts[r["class"]][r.at : r.at + LEAST] == texts[r.span][r.span_at : r.span_at + LEAST]
        spans.setdefault((r.span, r.span_at), set()).add(r["class"])
    first = {t: i for i, t in reversed(list(enumerate(texts))) if t is not None}
    want = {(first[texts[a]], first[texts[b]]) for a, b in brute(texts)[0] if texts[a] != texts[b]}
    got = {(a, b) for m in spans.values() for a in m for b in m if a < b}
    assert got == {(min(p), max(p)) for p in want}


@pytest.mark.parametrize("many", [100, 200])
def test_a_header_on_many_texts_has_a_member_a_text(spark, many):
    rng = random.Random(many)
    header = words(rng, 300)
    rows = S.span_members(frame(spark, [header + words(rng, 250) for _ in range(many)]), "id", "text", LEAST)
    assert rows.count() == many and rows.select("span", "span_at").distinct().count() == 1


def test_characters_decide_where_digests_collide(spark, texts):
    few = texts[:20]  # 8 bits: nearly every window collides with one of another text
    pairs, parts = brute(few)
    assert {(r.a, r.b) for r in S.shared_pairs(frame(spark, few), "id", "text", LEAST, bits=8).collect()} == pairs
    assert {r.id: r.shared_chars for r in S.shared_parts(frame(spark, few), "id", "text", LEAST, bits=8).collect()} == parts


def test_texts_longer_than_a_piece(spark, monkeypatch):
    rng = random.Random(9)
    common = words(rng, 260)
    long_ = words(rng, 3 * S.PIECE // 2, "abcdefgh")
    at = S.PIECE - 130  # over the edge of a piece
    a, b = long_[:at] + common + long_[at:], words(rng, 500) + common + words(rng, 500)
    got = [(r.a, r.b) for r in S.shared_pairs(frame(spark, [a, b, words(rng, 900)]), "id", "text", LEAST).collect()]
    assert got == [(0, 1)]
    part = {r.id: r.shared_chars for r in S.shared_parts(frame(spark, [a, b]), "id", "text", LEAST).collect()}
    assert 260 <= part[0] == part[1] <= 270


def test_empty_table_and_nulls(spark, texts):
    assert S.shared_pairs(frame(spark, texts).limit(0), "id", "text", LEAST).count() == 0
    assert S.shared_parts(frame(spark, texts).limit(0), "id", "text", LEAST).count() == 0
    nulls = spark.createDataFrame([(None, "x" * 300, "", 1, 1), (1, "x" * 300, "", 1, 1), (2, None, "", 1, 1)], SCHEMA)
    assert S.shared_pairs(nulls, "id", "text", LEAST).count() == 0
    assert {r.id: r.shared_chars for r in S.shared_parts(nulls, "id", "text", LEAST).collect()} == {1: 0, 2: 0}


def test_cuts_resist_insertions():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 110, 5000).astype(np.uint32)
    moved = np.concatenate([text[:1000], rng.integers(97, 110, 37).astype(np.uint32), text[1000:]])

    def at(x):
        return set(S.cuts(x, np.arange(len(x)), np.full(len(x), len(x))).tolist())

    with np.errstate(over="ignore"):
        a, b = at(text), at(moved)
    late = {p for p in a if p > 1200}
    assert {p + 37 for p in late} <= b and len(late) > 50


def test_a_window_too_large_is_refused():
    with pytest.raises(ValueError):
        S.reach(200, 85)
    assert S.reach(200, 64) == 42
