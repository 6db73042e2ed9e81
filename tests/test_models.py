"""Tree models, outlier models and experiments: held-out scores, properties and brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import experiments, models, outliers, sampling
from lodestream.scratch import root, written
from lodestream.sources import registry
from lodestream.streaming import jobs


@pytest.fixture(scope="module")
def parts(spark):
    """y = 1 where a > 0.6 and b < 0.5; c is noise; some inputs are no numbers."""
    rng = np.random.default_rng(1)
    x = rng.random((1500, 3))
    rows = [(i, float(a), float(b), float(c), int(a > 0.6 and b < 0.5)) for i, (a, b, c) in enumerate(x)]
    rows[0] = (0, None, float("nan"), float("inf"), None)
    df = written(models.assembled(spark.createDataFrame(rows, "id long, a double, b double, c double, y int"), "id", ["a", "b", "c"], "y", {0: 0.5, 1: 1.0}), "m")
    return df.where("id < 1000"), df.where("id >= 1000")


def test_rows_without_a_label_are_left_out_and_classes_weigh(parts):
    train, _ = parts
    assert train.count() == 999 and {(r.y, r.w) for r in train.select("y", "w").distinct().collect()} == {(0.0, 0.5), (1.0, 1.0)}


def test_models_find_the_rule(parts):
    train, test = parts
    for model in (models.tree(train, 3), models.forest(train, 4, 10), models.boosted(train, 5)):
        assert models.judged(model, test).first().f1 > 0.9
    assert models.confused(models.extra_trees(train, "id", trees=20)(test)).first().f1 > 0.85
    assert models.confused(models.extra_trees(train.limit(0), "id", trees=2)(test)).first().tp == 0


def test_the_sweep_has_a_row_a_depth_and_importance_sees_noise(spark, parts):
    train, test = parts
    rows = models.depth_sweep(train, test, [1, 2, 3]).collect()
    assert [r.depth for r in rows] == [1, 2, 3] and rows[2].f1 > rows[0].f1
    found = [(r.feature, r.importance) for r in models.importances(models.forest(train, 4, 10), ["a", "b", "c"], train).collect()]
    assert found[2][0] == "c" and abs(sum(v for _, v in found) - 1) < 1e-6 and found == sorted(found, key=lambda x: -x[1])


def test_out_of_bag_rows_are_judged_by_others(parts):
    train, _ = parts
    r = models.out_of_bag_scores(train, "id", 3, 3).first()
    held = sampling.out_of_bag(sampling.bags(train.select("id"), "id", 3)).select("id").distinct().count()
    assert r["rows"] == held and r.accuracy > 0.9


def test_searches_draw_the_same_and_refuse_unknown_names(parts):
    train, test = parts
    space = {"depth": [1, 3], "gain": [0.0, 0.01]}
    a = models.random_search(train, test, space, 6).collect()
    assert a == models.random_search(train, test, space, 6).collect() and len(a) == 6
    assert max(r.f1 for r in a) == next(r.f1 for r in a if r.best)
    forest = models.random_search(train, test, {"trees": [3], "columns": ["all"], "share": [0.75]}, 2).collect()
    assert len(forest) == 2 and forest[0].f1 > 0.8
    with pytest.raises(ValueError, match="unknown"):
        models.random_search(train, test, {"jobs": [1]})


def _grouped(spark, groups, per):
    return spark.range(groups * per).select("id", (F.col("id") % groups).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("x"), F.when(F.col("id") % 97 != 0, F.col("id") % 7 * 1.0).alias("y"))


def test_many_groups_have_their_own_models(spark):
    df = written(_grouped(spark, 20_000, 3), "many")
    out = outliers.group_scores(df, "id", "g", ["x", "y"], trees=2)
    r = out.agg(F.count("*").alias("n"), F.count_distinct("g").alias("g"), F.min("score").alias("a"), F.max("score").alias("b")).first()
    assert (r.n, r.g) == (60_000, 20_000) and 0 < r.a <= r.b <= 1


def test_a_hot_group_is_cut_into_parts_and_scores_alike(spark, monkeypatch):
    df = written(_grouped(spark, 1, 3000).unionByName(_grouped(spark, 5, 8).withColumns({"id": F.col("id") + 10_000, "g": F.col("g") + 1})), "hot")
    df = df.unionByName(df.limit(1).withColumns({"id": F.lit(-1).cast("long"), "g": F.lit(None).cast("long")}), True).unionByName(df.limit(1).withColumns({"id": F.lit(-2).cast("long"), "g": F.lit(99).cast("long")}))
    fitted = written(outliers.group_models(df, "id", "g", ["x", "y"], trees=5), "fitted")
    whole = {r.id: r.score for r in outliers.model_scores(df, fitted, "id", "g", ["x", "y"]).collect()}
    monkeypatch.setattr(outliers, "PART_ROWS", 100)
    assert whole == {r.id: r.score for r in outliers.model_scores(df, fitted, "id", "g", ["x", "y"]).collect()}
    assert len(whole) == 3040 and not {-1, -2} & set(whole)  # no group, a group of one row


def test_the_registry_gives_the_latest_model_of_each_group(spark):
    path = f"{root(spark)}/registry"
    make = lambda rows: spark.createDataFrame(rows, "g long, model binary")
    registry.register(make([(1, b"a"), (2, b"a")]), path, "r1")
    registry.register(make([(1, b"b")]), path, "r2")
    assert {(r.g, bytes(r.model), r.run) for r in registry.current(spark, path, "g").collect()} == {(1, b"b", "r2"), (2, b"a", "r1")}
    assert {bytes(r.model) for r in registry.current(spark, path, "g", "r1").collect()} == {b"a"}
    registry.register(make([(1, b"c")]), path, "r2")  # again
    assert {(r.g, bytes(r.model)) for r in registry.current(spark, path, "g").collect()} == {(1, b"c"), (2, b"a")}


def test_components_rebuild_a_flat_cloud(spark):
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 6))
    flat[7] += rng.normal(size=6) * 5
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(flat)] + [(900, None)], "id long, v array<double>")
    got = {r.id: r.error for r in outliers.pca_errors(df, "id", "v", 3).collect()}
    centred = flat - flat.mean(0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:3]
    want = ((flat - flat @ axes.T @ axes) ** 2).mean(1)
    assert set(got) == set(range(200)) and np.allclose([got[i] for i in range(200)], want, atol=1e-6)


@pytest.mark.parametrize(("algo", "params"), [("isolation_forest", {"trees": 20}), ("lof", {"k": 5}), ("autoencoder", {"k": 1})])
def test_an_experiment_is_kept_as_a_run(spark, algo, params):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 2))
    data[5] = [40, -40]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(data)], "id long, a double, b double")
    path = f"{root(spark)}/experiments-{algo}"
    metrics = experiments.run(df, "id", ["a", "b"], {"algo": algo, "params": params, "metrics": {"severity": {"method": "topk", "args": {"k": 3}}}}, path, "one")
    assert metrics["rows"] == 300 and metrics["severe"] == 3 and metrics["lowest"] <= metrics["mean"] <= metrics["severity"] <= metrics["highest"]
    assert {r.metric: r.value for r in experiments.stored(spark, path, "one").collect()} == metrics
    assert experiments.stored(spark, path, "one", "scores").count() == 300 and experiments.stored(spark, path, "one", "profile").count() == 2
    if algo != "autoencoder":
        assert 5 in [r.id for r in experiments.stored(spark, path, "one", "top").collect()]


def test_rules_of_an_experiment(spark):
    scores = spark.createDataFrame([(i, float(i)) for i in range(101)], "id long, score double")
    assert experiments.severe(scores, "id", "percentile", {"p": 90}).count() == 11 and experiments.severe(scores, "id", "threshold", {"threshold": 98}).count() == 3
    with pytest.raises(ValueError):
        experiments.severe(scores, "id", "best", {})
    with pytest.raises(ValueError):
        experiments.run(scores, "id", ["score"], {"algo": "svm", "metrics": {"severity": {"method": "topk"}}}, "x", "y")


def test_a_search_for_a_forest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(v), int(i < 5)) for i, v in enumerate(np.r_[rng.normal(50, 1, 5), rng.normal(0, 1, 300)])]
    found = outliers.forest_search(spark.createDataFrame(rows, "id long, x double, y int"), "id", ["x"], "y", {"trees": [5, 20], "sample": [64]}, 4).collect()
    assert len(found) == 4 and max(r.hits for r in found) >= 0.8 and all(r.best == (r.hits == max(x.hits for x in found)) for r in found)


def test_exact_draws_with_replacement(spark):
    df = spark.createDataFrame([(i % 40, "x") for i in range(120)], "id long, s string")
    out = sampling.exact_bags(df, "id", 3).collect()
    assert len(out) == 360 and all(sum(r.draws for r in out if r.learner == k) == 120 for k in range(3))
    left = sum(r.draws == 0 for r in out) / 360
    assert 0.25 < left < 0.5
    assert sum(r.draws for r in sampling.exact_bags(df, "id", 2, 50).collect()) == 100 and sampling.exact_bags(df.limit(0), "id", 2).count() == 0


def test_a_stream_keeps_the_last_values_and_scores_with_registered_models(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, i // 3, float(rng.integers(0, 4)), float(rng.random())) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g long, t long, x double, z double")
    for part in range(4):  # a file a batch, in the order of time
        df.where(f"id >= {part * 30} AND id < {part * 30 + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    got = {r.id: r.rolling for r in jobs.table_of(jobs.rolling(stream, "id", "g", "t", "x"), "append").collect()}
    for i, g, t, _, _ in rows:
        last = [r[3] for r in rows if r[1] == g and t - 8 < r[2] <= t and r[3]]
        assert abs(got[i] - (sum(last) / len(last) if last else 0.0)) < 1e-9
    path = f"{root(spark)}/streamed-models"
    registry.register(outliers.group_models(df, "id", "g", ["x", "z"], trees=5), path)
    score = lambda batch: outliers.model_scores(batch, registry.current(spark, path, "g"), "id", "g", ["x", "z"])
    want = {r.id: r.score for r in score(df).collect()}
    assert len(want) == 120 and {r.id: r.score for r in jobs.scored(stream, score).collect()} == want


def test_a_stream_is_sent_with_retries(spark, tmp_path):
    taken = tmp_path / "taken"
    taken.mkdir()

    def send(records):
        """Refuses the second half of each larger batch."""
        keep = max(1, len(records) // 2)
        for k, v in records[:keep]:
            (taken / f"{abs(hash((k, v)))}").write_text(v)
        return list(range(keep, len(records)))

    spark.range(40).withColumns({"app": F.lit(1), "device": F.col("id") % 4}).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, app int, device long").parquet(str(tmp_path / "in"))
    jobs.sent(stream, "app", "device", send, streams=2, batch=4, wait=0.001)
    import json

    assert sorted(json.loads(f.read_text())["id"] for f in taken.iterdir()) == list(range(40))
