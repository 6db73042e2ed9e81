"""Queries of outlier scores, tree models and streams. Models have no SQL; they are tested by properties and held-out scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions.clean import day, hour, once
from lodestream.operators import experiments, models, outliers, sampling
from lodestream.operators.hourly import nudged
from lodestream.operators.severity import COLUMNS, severity
from lodestream.plans.hours import EVENTS, LAST_AT, r6
from lodestream.plans.hours import _place as place
from lodestream.plans.registry import Registry, table
from lodestream.plans.scores import SEVERITY
from lodestream.scratch import written
from lodestream.sources import registry
from lodestream.streaming import jobs

REGISTRY = Registry()
add = REGISTRY.add

SIGNALS = list(COLUMNS.values())
# The twelve inputs of the per-app models.
INPUTS = [
    "session_count", "expanding_mean_session_count", "AnomalySessionCount", "max_shortLength", "expanding_mean_max_shortLength", "shortSessionAnomaly", "session_time", "expanding_mean_session_time",
    "sessionTimeAnomalyBasedOnHistory", "max_zero_bytes_Count", "rolling_mean_zero_bytes_Count", "ZerobytesUsagenAnomaly",
]
WEIGHTS, FOREST_WEIGHTS = {0: 0.1, 1: 1.0}, {0: 0.1, 1: 3.0}


@add("iforest_scores")
def iforest_scores(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.forest_scores(written(once(table(spark, folder, "severity_scores"), "score_id"), "scores"), "score_id", SIGNALS)


def _inputs(spark: SparkSession, folder: str) -> DataFrame:
    return written(once(table(spark, folder, "hourly_features").select("feature_id", "app_id", *INPUTS), "feature_id"), "inputs")


@add("per_app_scores")
def per_app_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Models fitted per app, registered, looked up and brought to their rows."""
    rows, path = _inputs(spark, folder), place(spark, "models")
    registry.register(outliers.group_models(rows, "feature_id", "app_id", INPUTS), path)
    return outliers.model_scores(rows, registry.current(spark, path, "app_id"), "feature_id", "app_id", INPUTS)


@add("model_sweep")
def model_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty-five random settings of the isolation forest, judged by how well the scores find the flagged hours."""
    rows = written(once(table(spark, folder, "severity_scores").select("score_id", "anomaly", *SIGNALS), "score_id"), "scores")
    return outliers.forest_search(rows, "score_id", SIGNALS, "anomaly", {"trees": [50, 100, 200], "sample": [64, 128, 256]}, 25)


@add("experiment_run")
def experiment_run(spark: SparkSession, folder: str) -> DataFrame:
    """Fit, score, profile, top records and metrics of one configuration, kept as a run; what comes out is the run as stored."""
    rows = written(once(table(spark, folder, "severity_scores"), "score_id"), "scores")
    path = place(spark, "experiment")
    experiments.run(rows, "score_id", SIGNALS, {"algo": "isolation_forest", "params": {"trees": 100, "sample": 256}, "metrics": {"severity": {"method": "topk", "args": {"k": 50}}}}, path, "first")
    return experiments.stored(spark, path, "first")


@add("lof_scores")
def lof_scores(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.lof_scores(table(spark, folder, "embeddings"), "vec_id", "embedding")


@add("reconstruction_error")
def reconstruction_error(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.pca_errors(table(spark, folder, "embeddings"), "vec_id", "embedding")


def _parts(spark: SparkSession, folder: str, weights: dict[int, float] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    rows = once(table(spark, folder, "severity_scores").select("score_id", "anomaly", *SIGNALS), "score_id")
    rows = written(models.assembled(sampling.split(rows, "score_id", {"train": 0.6, "validation": 0.2, "test": 0.2}), "score_id", SIGNALS, "anomaly", weights).join(sampling.split(rows.select("score_id"), "score_id", {"train": 0.6, "validation": 0.2, "test": 0.2}), "score_id"), "parts")
    return rows.where("part = 'train'"), rows.where("part = 'validation'")


@add("decision_tree")
def decision_tree(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _parts(spark, folder)
    return models.judged(models.tree(train, 2), test)


@add("tree_depth_sweep")
def tree_depth_sweep(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _parts(spark, folder)
    return models.depth_sweep(train, test, range(1, 20))


@add("rf_classifier")
def rf_classifier(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _parts(spark, folder, FOREST_WEIGHTS)
    return models.judged(models.forest(train), test)


@add("feature_importance")
def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    train, _ = _parts(spark, folder, FOREST_WEIGHTS)
    return models.importances(models.forest(train), SIGNALS, train)


@add("extra_trees")
def extra_trees(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _parts(spark, folder, FOREST_WEIGHTS)
    return models.confused(models.extra_trees(train, "score_id")(test))


@add("forest_search")
def forest_search(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _parts(spark, folder, FOREST_WEIGHTS)
    return models.random_search(train, test, {"trees": [10, 30], "share": [0.5, 0.75, 1.0], "columns": ["sqrt", "all"], "depth": [4, 8], "leaf": [1, 10], "gain": [0.0, 0.001]}, 5)


@add("gbt_classifier")
def gbt_classifier(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _parts(spark, folder)
    return models.judged(models.boosted(train), test)


@add("parameter_search")
def parameter_search(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _parts(spark, folder)
    return models.random_search(train, test, {"depth": range(1, 11), "leaf": [1, 5, 20], "bins": [32, 64]}, 25)


@add("oob_score")
def oob_score(spark: SparkSession, folder: str) -> DataFrame:
    train, _ = _parts(spark, folder)
    return models.out_of_bag_scores(train, "score_id")


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/session_events.parquet"
    return jobs.deduplicated(jobs.opened(spark, path, spark.read.parquet(path)))


@add("stream_hourly_counts", f"WITH {EVENTS} SELECT app_id, date_trunc('hour', event_date) AS at, count(*) AS events, CAST(sum(coalesce(input_bytes + output_bytes, 0)) AS BIGINT) AS usage FROM ev GROUP BY ALL")
def stream_hourly_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All files as one stream, in update mode; the last state of each hour is the result."""
    rows = jobs.table_of(jobs.hourly(_stream(spark, folder)))
    last = Window.partitionBy("app_id", "window").orderBy(F.col("_batch").desc())  # a row per micro-batch
    rows = rows.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    return rows.select("app_id", F.col("window.start").cast("timestamp_ntz").alias("at"), "events", "usage")


@add("stream_device_stats", f"WITH {EVENTS} SELECT device_id, count(session_time) AS n, {r6('avg(session_time)')} AS mean, {r6('stddev_pop(session_time)')} AS std FROM ev WHERE device_id IS NOT NULL GROUP BY device_id HAVING count(session_time) > 0")
def stream_device_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = jobs.table_of(jobs.statistics(_stream(spark, folder)))
    last = Window.partitionBy("device_id", "salt").orderBy(F.col("_batch").desc())  # a row per micro-batch
    out = jobs.combined(rows.withColumn("_r", F.row_number().over(last)).where("_r = 1"))
    return out.select("device_id", "n", nudged(F.col("mean")).alias("mean"), nudged(F.col("std")).alias("std"))


@add(
    "stream_rolling",
    f"""WITH o AS (SELECT DISTINCT ON (feature_id) feature_id, device_id, {LAST_AT} AS stamp, max_zero_bytes_Count AS x FROM hourly_features WHERE device_id IS NOT NULL)
    SELECT feature_id, {r6('coalesce(avg(nullif(x, 0)) OVER (PARTITION BY device_id ORDER BY stamp ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 0)')} AS rolling FROM o""",
)
def stream_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Each device's last seven values kept as the state of the stream."""
    path = f"{folder}/hourly_features.parquet"
    stream = jobs.opened(spark, path, spark.read.parquet(path)).select("feature_id", "device_id", (F.unix_date(day()) * 24 + hour()).cast("long").alias("t"), F.col("max_zero_bytes_Count").alias("x"))
    rows = jobs.table_of(jobs.rolling(stream, "feature_id", "device_id", "t", "x"), "append")
    return rows.select("feature_id", nudged(F.col("rolling")).alias("rolling"))


@add("stream_model_scores")
def stream_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Micro-batches scored with the registered models of their apps."""
    rows, path = _inputs(spark, folder), place(spark, "models")
    registry.register(outliers.group_models(rows, "feature_id", "app_id", INPUTS), path)
    stream = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rpartition("/")[0])
    return jobs.scored(stream, lambda batch: outliers.model_scores(batch, registry.current(spark, path, "app_id"), "feature_id", "app_id", INPUTS))


@add("stream_severity", f"SELECT score_id, {r6(SEVERITY)} AS severity FROM severity_scores")
def stream_severity(spark: SparkSession, folder: str) -> DataFrame:
    """Scoring of micro-batches: the batch function as it is, over a stream. Rows as stored, repeats included."""
    path = f"{folder}/severity_scores.parquet"
    stream = jobs.opened(spark, path, spark.read.parquet(path))
    return jobs.table_of(severity(stream, name="severity", label="label").select("score_id", nudged(F.col("severity")).alias("severity")), "append").drop("_batch")
