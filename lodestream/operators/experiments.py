"""One experiment from a configuration: fit, score, summarise, profile and the records that stand out, kept as a run.

A configuration is ``{algo, params, metrics: {severity: {method: topk | percentile | threshold, args}}}``. A run is a folder of tables: ``scores``,
``profile``, ``top`` and ``metrics``; runs with other names lie beside it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import outliers, severity
from lodestream.operators.ordered import interpolated
from lodestream.scratch import written


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("_v", F.array(*[outliers.number(c) for c in columns]))


#: How a configuration's ``algo`` scores: (rows, key, columns, params) to ``key, score``, higher more unusual. Principal components stand in for the autoencoder.
ALGORITHMS: dict[str, Callable[..., DataFrame]] = {
    "isolation_forest": lambda df, key, columns, **p: outliers.forest_scores(df, key, columns, **p),
    "lof": lambda df, key, columns, **p: outliers.lof_scores(_vectors(df, columns), key, "_v", **p).withColumnRenamed("lof", "score"),
    "autoencoder": lambda df, key, columns, **p: outliers.pca_errors(_vectors(df, columns), key, "_v", **p).withColumnRenamed("error", "score"),
}


def severe(scores: DataFrame, key: str, method: str, args: Mapping[str, float]) -> DataFrame:
    """The records that stand out: the ``k`` highest, those at or above the ``p``-th percentile, or at or above ``threshold``. Ties of the k-th go by key."""
    if method == "topk":
        return scores.orderBy(F.col("score").desc(), F.col(key)).limit(int(args["k"]))
    if method == "percentile":
        bound = interpolated(scores, [], "score", {"bound": float(args["p"]) / 100}).select("bound")
        return scores.crossJoin(F.broadcast(bound)).where("score >= bound").drop("bound")  # one row
    if method == "threshold":
        return scores.where(F.col("score") >= float(args["threshold"]))
    raise ValueError(f"unknown method {method!r}; there are topk, percentile, threshold")


def run(df: DataFrame, key: str, columns: Sequence[str], config: Mapping, path: str, name: str) -> dict[str, float]:
    """Runs ``config`` over all rows of ``df``, keeps the run below ``path`` and returns its metrics. Running a name again replaces it.

    Metrics: rows, lowest, mean and highest score, how many records stand out, and the severity of the batch by the same rule. An unknown ``algo`` or method is an error.
    """
    if config["algo"] not in ALGORITHMS:
        raise ValueError(f"unknown algo {config['algo']!r}; there are {sorted(ALGORITHMS)}")
    rule = config["metrics"]["severity"]
    scores = written(ALGORITHMS[config["algo"]](df, key, columns, **config.get("params", {})), "scores")
    top = written(severe(scores, key, rule["method"], rule.get("args", {})), "top")
    numbers = scores.agg(F.count("*").cast("double").alias("rows"), F.min("score").alias("lowest"), F.avg("score").alias("mean"), F.max("score").alias("highest"))
    batch = severity.batch_severity(scores, "score", rule["method"], **rule.get("args", {}))
    numbers = numbers.crossJoin(F.broadcast(batch)).crossJoin(F.broadcast(top.agg(F.count("*").cast("double").alias("severe"))))  # one row
    names = numbers.columns
    metrics = numbers.select(F.lit(json.dumps(config, sort_keys=True)).alias("config"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("config", "m.*")
    for part, table in {"scores": scores, "top": top, "profile": severity.profile(df, columns), "metrics": metrics}.items():
        table.write.mode("overwrite").parquet(f"{path}/run={name}/{part}")
    return {r["metric"]: r["value"] for r in metrics.collect()}  # a row a metric


def stored(spark: SparkSession, path: str, name: str, part: str = "metrics") -> DataFrame:
    """A table of a run: ``scores``, ``top``, ``profile`` or ``metrics``."""
    return spark.read.parquet(f"{path}/run={name}/{part}")
