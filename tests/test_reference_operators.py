"""Worked numbers, properties and negative cases of the reference's own operators."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators import evaluation as E
from lodestream.operators import hourly as H
from lodestream.operators import outliers, sampling
from lodestream.operators import severity as S
from lodestream.operators import vocabulary as V
from lodestream.plans import learned, words
from lodestream.streaming import jobs


def labels(spark, counts):
    return spark.createDataFrame([(y,) for y, n in counts.items() for _ in range(n)], "y int")


@pytest.mark.parametrize(("counts", "want"), [({1: 9, 0: 5}, 0.9403), ({1: 5, 0: 5}, 1.0), ({1: 7}, 0.0), ({1: 99, 0: 1}, 0.0808)])
def test_entropy(spark, counts, want):
    assert round(E.entropy(labels(spark, counts), "y").first().entropy, 4) == want


def test_gain_of_a_perfect_a_useless_and_a_null_feature(spark):
    df = spark.createDataFrame([(i % 2, str(i % 2), "same", None if i % 2 else "v") for i in range(20)], "y int, a string, b string, c string")
    gains = {r.feature: r.gain for r in E.information_gain(df, "y", ["a", "b", "c"]).collect()}
    assert {k: round(v, 9) for k, v in gains.items()} == {"a": 1.0, "b": 0.0, "c": 1.0}
    assert E.best_split(E.information_gain(df, "y", ["b", "a", "c"])).first().feature == "a"


def test_auc_of_random_and_inverted_scores(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(4000)], "y int, s double")
    auc = E.areas(E.curve(df, "y", "s")).first().auc
    back = E.areas(E.curve(df.withColumn("s", -F.col("s")), "y", "s")).first().auc
    assert abs(auc - 0.5) < 0.03 and abs(auc + back - 1) < 1e-9
    best = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1)], "y int, s double")
    assert tuple(E.areas(E.curve(best, "y", "s")).first()) == (1.0, 1.0)
    assert E.areas(E.curve(best.limit(0), "y", "s")).first().auc is None


def test_the_incremental_update_equals_the_window(spark):
    rng, xs = np.random.default_rng(0), None
    xs = rng.integers(0, 50, 40).tolist()
    n, mean, std = 0, 0.0, 0.0
    for i, x in enumerate(xs[:8]):
        hist = spark.createDataFrame([(1, 1, mean, std, n)], "app_id long, device_id long, prev_mean_v double, prev_std_v double, prev_count_v long")
        r = H.incremental(spark.createDataFrame([(1, 1, x)], "app_id long, device_id long, v long"), hist, "v").first()
        assert (r.expanding_mean_v, r.expanding_std_v) == (mean, std)
        n, mean, std = r.prev_count_v, r.prev_mean_v, r.prev_std_v
        assert n == i + 1 and math.isclose(mean, np.mean(xs[: i + 1])) and math.isclose(std, np.std(xs[: i + 1]), abs_tol=1e-9)


def test_a_new_device_starts_from_zero(spark):
    hist = spark.createDataFrame([], "app_id long, device_id long, prev_mean_v double, prev_std_v double, prev_count_v long")
    r = H.incremental(spark.createDataFrame([(1, 1, 7)], "app_id long, device_id long, v long"), hist, "v").first()
    assert (r.expanding_mean_v, r.prev_mean_v, r.prev_std_v, r.prev_count_v) == (0.0, 7.0, 0.0, 1)


def test_severity_stays_between_0_and_1_and_grows_with_z(spark):
    rows = [(float(z), 1, 1, 1) for z in range(0, 30)] + [(None, None, None, None), (float("nan"), 0, 0, 0), (float("-inf"), 1, 0, 1)]
    df = spark.createDataFrame(rows, "SL_z_score double, anomaly int, shortSessionAnomaly int, ZerobytesUsagenAnomaly int")
    for m in S.SQUASH:
        c = S.Config(columns={"SL": "SL_z_score"}, weights={"SL": 3.0}, method=m)
        got = [r.Severity_final for r in S.severity(df, c).collect()]
        assert all(0 <= v <= 1 for v in got) and got[:30] == sorted(got[:30])
        assert got[31] == (0.425 if m == "logistic" else 0.0)


def test_severity_settings_are_checked(spark):
    df = spark.createDataFrame([(1.0,)], "SL_z_score double")
    with pytest.raises(ValueError):
        S.severity(df, S.Config(columns={"SL": "SL_z_score"}, weights={"ZB": 1.0}))
    with pytest.raises(ValueError):
        S.components(df, S.Config(columns={"SL": "SL_z_score"}, methods={"SL": "cube"}))
    with pytest.raises(ValueError):
        S.Config.of({"colour": 1})
    assert S.Config.of({"low": 0.2, "high": 0.5}, low=0.1).low == 0.1
    assert S.severity(df.limit(0)).count() == 0


def test_batch_severity_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "s double")
    value = lambda *a, **k: S.batch_severity(df, "s", *a, **k).first().severity
    assert value() == 5.5 and value("topk", k=3) == 9.0 and value("topk", k=99) == 5.5 and value("threshold", threshold=99) == 0.0
    assert S.batch_severity(df.limit(0), "s").first().severity == 0.0
    with pytest.raises(ValueError):
        value("threshold")


def test_bags_and_what_is_out_of_them_cover_all_rows(spark):
    bags = sampling.bags(spark.range(3000), "id", 4).cache()
    assert bags.count() == 12000
    for r in bags.groupBy("learner").agg(F.sum("draws").alias("d"), F.avg((F.col("draws") == 0).cast("int")).alias("o")).collect():
        assert abs(r.d - 3000) < 200 and abs(r.o - math.exp(-1)) < 0.03
    parts = sampling.split(spark.range(3000), "id", {"a": 6, "b": 2, "c": 2}).groupBy("part").count().collect()
    assert sum(r["count"] for r in parts) == 3000 and abs({r.part: r["count"] for r in parts}["a"] - 1800) < 120
    assert sampling.columns("abcdef", 3, 1) == sampling.columns("abcdef", 3, 1) and len(sampling.columns("abcdef", 3)) == 3


def test_draws_go_as_far_as_the_hash(spark, monkeypatch):
    monkeypatch.setattr(sampling, "uniform", lambda seed, *keys: F.col("u"))
    df = spark.createDataFrame([(1, 0.3), (2, 0.5), (3, 0.99999), (4, 1 - 2.0**-32)], "id int, u double")
    assert {r.id: r.draws for r in sampling.bags(df, "id", 1).collect()} == {1: 0, 2: 1, 3: 8, 4: 12}


def test_lof_equals_brute_force_and_finds_the_lonely_point(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (80, 3)), [[9.0, 9.0, 9.0]]])
    model = outliers.LocalOutlierFactor(x, 10)
    z = (x - x.mean(0)) / x.std(0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1)[:, :10]
    kd = np.sort(d, 1)[:, 9]
    lrd = 1 / np.maximum(kd[near], np.take_along_axis(d, near, 1)).mean(1)
    assert np.allclose(model.own, lrd[near].mean(1) / lrd) and model.own.argmax() == 80
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    rows = outliers.lof_scores(df, "id", "v", 10, sample=10_000).orderBy(F.col("lof").desc()).collect()
    assert len(rows) == 81 and rows[0].id == 80
    assert outliers.lof_scores(df.limit(0), "id", "v").count() == 0


def test_lof_searches_all_rows_and_leaves_each_itself_out(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (2700, 3)), rng.normal(9, 0.1, (30, 3))])  # above the 2,048 rows that once were the most
    want = outliers.LocalOutlierFactor(x, 20).own
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = {r.id: r.lof for r in outliers.lof_scores(df, "id", "v").collect()}
    assert len(got) == len(x) and np.allclose([got[i] for i in range(len(x))], want)
    assert [r.lof for r in outliers.lof_scores(df.limit(1), "id", "v").collect()] == [1.0]


def test_tree_queries_run_over_the_settings_of_the_reference(spark, folder, monkeypatch):
    assert sorted(r.depth for r in learned.tree_depth_sweep(spark, folder).collect()) == list(range(1, 20))
    made, forest, boosted = [], learned.models.forest, learned.models.boosted
    monkeypatch.setattr(learned.models, "forest", lambda train, *a: made.append((train, forest(train, *a))) or made[-1][1])
    monkeypatch.setattr(learned.models, "boosted", lambda train, *a: made.append((train, boosted(train, *a))) or made[-1][1])
    for query in (learned.rf_classifier, learned.feature_importance, learned.gbt_classifier):
        query(spark, folder)
    assert [(m.getNumTrees, m.getOrDefault("maxDepth")) for _, m in made] == [(100, 8), (100, 8), (10, 3)]
    assert {tuple(r) for r in made[0][0].select("y", "w").distinct().collect()} == {(0.0, 0.1), (1.0, 3.0)}


def test_forest_scores_rank_a_planted_outlier_first(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(999, 40.0, -40.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = outliers.forest_scores(df, "id", ["a", "b"], sample=1000).orderBy(F.col("score").desc()).collect()
    assert got[0].id == 999 and all(0 < r.score <= 1 for r in got) and len(got) == 401


TEXTS = ["Füße – naïve_1 x² 3½ don't stop!", "", "a\x1cb c\x85d 漢字。😀", "é Ã¼ «q»  \t\n…", None, "x" * 5000 + " " + "y"]


def test_tokens_are_those_of_pythons_expression(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    got = {r.id: (r.w, r.n) for r in df.select("id", X.tokens(F.col("t")).alias("w"), X.token_count(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(TEXTS):
        want = None if t is None else re.findall(r"\w+|[^\w\s]", t)
        assert got[i] == (want, len(want or []))


def test_tokens_of_the_documents(spark, folder):
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("text", X.token_count(F.col("text")).alias("n")).collect():
        assert r.n == len(re.findall(r"\w+|[^\w\s]", r.text or ""))


def test_encode_and_decode(spark):
    df = spark.createDataFrame([(1, "ab ba"), (2, ""), (3, "abz")], "id int, t string")
    vocab = V.frequent(df.where("id < 3"), "id", X.characters(F.col("t")), 10)
    assert [(r.id, r.token) for r in vocab.orderBy("id").collect()] == [(4, "a"), (5, "b"), (6, " ")]
    ids = V.encoded(df, "id", X.characters(F.col("t")), vocab)
    assert {r.id: r.ids for r in ids.collect()} == {1: [1, 4, 5, 6, 5, 4, 2], 2: [1, 2], 3: [1, 4, 5, 3, 2]}
    assert {r.id: "".join(r.tokens) for r in V.decoded(ids, "id", "ids", vocab).collect()} == {1: "ab ba", 2: "", 3: "ab"}
    with pytest.raises(ValueError):
        V.splitter("morse")


def test_char_vocab_has_all_characters(spark, tmp_path):
    text = "".join(chr(0x4E00 + i) for i in range(300))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.token for r in words.char_vocab(spark, str(tmp_path)).collect()} == set(text)


def test_the_job_hour_after_hour_equals_everything_at_once(spark):
    from datetime import datetime, timedelta

    from lodestream.scratch import written

    rng, rows = random.Random(6), []
    start = datetime(2025, 1, 6, 22)
    for h in range(5):
        for dev in range(6):
            for k in range(rng.choice([0, 1, 3, 9])):
                at = start + timedelta(hours=h, minutes=rng.randrange(60))
                zero = rng.random() < 0.6
                rows.append((1 + dev % 2, dev or None, at, 0 if zero else 10, 0, "start", rng.choice([None, 20.0, 500.0 * rng.random()]), f"s{h}{dev}{k // 2}", at.year, at.month, at.day, at.hour))
    schema = "app_id long, device_id long, event_date timestamp_ntz, input_bytes long, output_bytes long, record_type string, session_time double, session_id string, year int, month int, day int, hour int"
    events = spark.createDataFrame(rows, schema)
    limits = lambda df: df.sparkSession.createDataFrame([(50.0, -50.0)], "high double, low double")
    stats = ", ".join(f"prev_mean_{c} double, prev_std_{c} double, prev_count_{c} long" for c in H.COLUMNS)
    history = spark.createDataFrame([], f"app_id long, device_id long, date string, hour string, {stats}")
    last_n = spark.createDataFrame([], "app_id long, device_id long, day date, hr int, max_zero_bytes_Count long")
    got = []
    for h in range(5):
        out, history, last_n = H.job(events, history, last_n, start + timedelta(hours=h + 1, minutes=7), limits)
        got += out.collect()
        history, last_n = written(history), written(last_n)
    whole = H.zero_usage(H.expanding(H.hourly(events), H.COLUMNS)).crossJoin(limits(events))
    whole = whole.withColumns({"AnomalySessionCount": H.two_sided("session_count"), "sessionTimeAnomalyBasedOnHistory": F.coalesce(H.asymmetric("session_time", F.col("high"), F.col("low")), F.lit(0))})
    want = {(str(r.day), r.hr, r.app_id, r.device_id): r for r in whole.where("device_id IS NOT NULL").collect()}
    mine = {(r.date, int(r.hour), r.app_id, r.device_id): r for r in got if r.device_id is not None}
    assert set(mine) == set(want) and len(got) > len(mine) and len(mine) > 15
    names = ["session_count", "max_shortLength", "session_time", "AvgSessionLengthTime", "max_zero_bytes_Count", "AnomalySessionCount", "sessionTimeAnomalyBasedOnHistory", "ZerobytesUsagenAnomaly", "rolling_mean_zero_bytes_Count", *[f"expanding_mean_{c}" for c in H.COLUMNS]]
    for k, r in mine.items():
        assert [None if r[n] is None else round(r[n], 7) for n in names] == [None if want[k][n] is None else round(want[k][n], 7) for n in names]
    assert H.job_hour("2025-03-05 00:10:00") == datetime(2025, 3, 4, 23) and H.job_hour().minute == 0
    assert H.job_hour() < datetime.now(H.UTC).replace(tzinfo=None)


def test_windows_of_the_stream(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, [4, 5, 6, 7])], "id int, ids array<int>")
    rows = V.windows(df, "id", "ids", 3).orderBy("window").collect()
    assert [(r.window, r.x, r.y) for r in rows] == [(0, [1, 2, 3], [2, 3, 4]), (1, [4, 5, 6], [5, 6, 7])]


def test_cleaning_leaves_no_references(spark):
    raw = "The Book of Ruth\nRuth 1:1 Now it came to pass\n12:3 and so (John 3:16) on.\nCHAPTER 4\n\n\n\nEnd  of   it  \n"
    r = spark.createDataFrame([(raw,)], "t string").select(X.tidy(X.removed(F.col("t"))).alias("t")).first().t
    assert re.search(r"\d+:\d+", r) is None and "Ruth" not in r and "CHAPTER" not in r and "  " not in r and "Now it came to pass" in r
    left = spark.createDataFrame([(r,)], "t string").select(X.residuals(F.col("t"), "references").alias("a"), X.residuals(F.col("t"), "headings").alias("b")).first()
    assert tuple(left) == (0, 0)


def test_reflow_keeps_all_words_and_the_width(spark):
    rng = random.Random(3)
    t = " ".join(rng.choice(["word", "said", "long,winded", "behold", "end.", "x"]) for _ in range(400))
    out = spark.createDataFrame([(t,), (None,)], "t string").select(X.reflowed(X.marked(F.col("t"))).alias("o")).collect()
    assert out[1].o is None and out[0].o.split() == t.split()
    assert all(len(line) <= 100 or re.fullmatch(r"[^.!?;:]+[.!?;:]?", line) for line in out[0].o.splitlines())


def test_reflow_sets_off_a_phrase_too_long_for_a_line(spark):
    long, mid = "a" * 104, "b" * 70
    cases = {f"{long}": f"\n{long}\n", f"{mid} <SPLIT> {long}": f"{mid}\n{long}\n", f"said x <SPLIT> {long} <SPLIT> {mid}\n\n \n\nend.": f"said x\n\n{long}\n{mid}\n\nend.\n", "": "\n", f"{long}.": f"{long}.\n"}
    out = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.reflowed(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in out} == cases
    with pytest.raises(ValueError):
        X.reflowed(F.col("t"), 200)


def _replayed(symbols, merges):
    for a, b in merges:
        done, i = [], 0
        while i < len(symbols):
            hit = symbols[i : i + 2] == [a, b]
            done.append(a + b if hit else symbols[i])
            i += 1 + hit
        symbols = done
    return symbols


def test_merges_equal_a_plain_replay(spark):
    rng = random.Random(5)
    merges = [("a", "b"), ("ab", "a"), ("b", "b"), ("a", "a"), ("aa", "b</w>"), ("bb", "ab")]
    words = [[rng.choice("ab") for _ in range(rng.randint(1, 12))] + ["b</w>"] for _ in range(60)]
    out = spark.createDataFrame([(w,) for w in words], "s array<string>").select("s", X.merged(F.col("s"), merges).alias("m")).collect()
    assert all(r.m == _replayed(r.s, merges) for r in out)


def test_given_tokenizer_round_trip_nulls_and_lower_case(spark):
    from pathlib import Path

    from lodestream.plans.words import BPE

    given = Path(BPE).read_text(encoding="utf-8")
    df = spark.createDataFrame([(1, "Größe <|endoftext|>\r\n x"), (2, ""), (3, None), (4, "ABC " * 5000)], "id long, t string")
    ids = V.given_encoded(df, "id", "t", given)
    back = {r.id: r.text for r in V.given_decoded(ids, "id", "ids", given).collect()}
    assert back == {r.id: r.t for r in df.collect()}
    low = {r.id: r.text for r in V.given_decoded(V.given_encoded(df, "id", "t", given, lowercase=True), "id", "ids", given).collect()}
    assert low[4] == "abc " * 5000
    assert [r.x for r in spark.createDataFrame([("Ab Ab",)], "t string").select(V.splitter("word", lowercase=True)(F.col("t")).alias("x")).collect()] == [["ab", "ab"]]


def test_vocabulary_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([(4, "a"), (5, "b")], "id int, token string")
    V.save(df, str(tmp_path / "v"), "word", {"vocab_size": 6})
    back, about = V.load(spark, str(tmp_path / "v"))
    assert sorted(map(tuple, back.collect())) == [(4, "a"), (5, "b")] and about == {"name": "word", "config": {"vocab_size": 6}}


def test_merges_are_greedy_from_the_left(spark):
    df = spark.createDataFrame([(list("aaab"),), ([],), (None,)], "s array<string>")
    assert [r.m for r in df.select(X.merged(F.col("s"), [("a", "a"), ("aa", "a")]).alias("m")).collect()] == [["aaa", "b"], [], None]


def test_detokenized_words(spark):
    r = spark.createDataFrame([("Hello , big world !",)], "t string").select(X.joined(X.tokens(F.col("t"))).alias("o")).first()
    assert r.o == "Hello,big world!"


def test_a_stream_in_several_batches_equals_the_batch_result(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/session_events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    rows = jobs.table_of(jobs.statistics(jobs.deduplicated(stream, "4000 hours")))
    last = rows.groupBy("device_id", "salt").agg(F.max_by(F.struct("n", "mean", "m2"), "_batch").alias("x")).select("device_id", "salt", "x.*")
    assert rows.select("_batch").distinct().count() >= 4
    want = H.once(events).where("device_id IS NOT NULL AND session_time IS NOT NULL").groupBy("device_id").agg(F.count("*").alias("n"), F.avg("session_time").alias("m"), F.stddev_pop("session_time").alias("s"))
    got = {r.device_id: (r.n, r["mean"], r["std"]) for r in jobs.combined(last).collect()}
    for r in want.collect():
        assert got[r.device_id][0] == r.n and math.isclose(got[r.device_id][1], r.m, rel_tol=1e-9) and math.isclose(got[r.device_id][2], r.s, rel_tol=1e-7, abs_tol=1e-7)
