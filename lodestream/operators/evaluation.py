"""Evaluation of classifiers and splits: entropy, gain, confusion, ROC and precision-recall curves, encodings, ensembles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.ordered import cumulative_frequencies


def _bits(n: Column, of: Column) -> Column:
    p = n / of
    return F.when(n > 0, -p * F.log2(p)).otherwise(0.0)


def entropy(df: DataFrame, label: str) -> DataFrame:
    """``n, entropy`` in bits of the non-null labels: 0 if pure; one row, null entropy without rows."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("n"))
    return counts.crossJoin(F.broadcast(total)).agg(F.max("n").alias("n"), F.sum(_bits(F.col("_n"), F.col("n"))).alias("entropy"))  # one row


def information_gain(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """``feature, parent, children, gain``: entropy of the labels, weighted entropy after splitting by each value of a feature, their difference.

    One pass for all features: values are counted as (feature, value, label). A null value is a value; rows without a label don't count.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features]))
    counts = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_y"), pairs.alias("p")).groupBy("p.feature", "p.value", "_y").agg(F.count("*").alias("_n"))
    sides = counts.groupBy("feature", "value").agg(F.sum("_n").alias("_side"))
    joined = counts.join(sides.withColumnsRenamed({"feature": "_f", "value": "_v"}), (F.col("feature") == F.col("_f")) & F.col("value").eqNullSafe(F.col("_v")))
    child = joined.groupBy("feature").agg(F.sum(F.col("_side") * _bits(F.col("_n"), F.col("_side"))).alias("_w"), F.sum("_n").alias("_total"))
    # Each label's term carries its side's weight: side * (n / side * log) summed over labels is side * entropy(side).
    labels = counts.groupBy("feature", "_y").agg(F.sum("_n").alias("_n"))
    totals = labels.groupBy(F.col("feature").alias("_f")).agg(F.sum("_n").alias("_total"))
    parent = labels.join(totals, F.col("feature") == F.col("_f")).groupBy("feature").agg(F.sum(_bits(F.col("_n"), F.col("_total"))).alias("parent"))
    out = child.join(parent, "feature").withColumn("children", F.col("_w") / F.col("_total"))
    return out.select("feature", "parent", "children", (F.col("parent") - F.col("children")).alias("gain"))


def best_split(gains: DataFrame) -> DataFrame:
    """The feature with the largest gain (the first by name of equal ones)."""
    return gains.agg(F.max(F.struct("gain", "feature")).alias("m")).join(gains, F.col("gain") == F.col("m.gain")).agg(F.min("feature").alias("feature"), F.max("gain").alias("gain"))


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: ``tp, fp, fn, tn`` and accuracy, precision, recall, f1 (null where undefined). Rows with a null in either are left out."""
    rows = df.select(truth.cast("int").alias("y"), guess.cast("int").alias("g")).where("y IS NOT NULL AND g IS NOT NULL")
    n = lambda y, g: F.count(F.when((F.col("y") == y) & (F.col("g") == g), 1))
    out = rows.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rate = lambda a, b: a / F.nullif(b.cast("double"), F.lit(0.0))
    return out.withColumns({"accuracy": rate(tp + tn, tp + tn + fp + fn), "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn)})


def curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """``score, tp, fp, positives, negatives`` for the threshold "at or above score" at every distinct score, ties together; ``tp_step, fp_step`` are those at the score itself.

    Records and positives are counted per score and summed up in one distributed sort, so a billion scores are no problem for one task.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)).select(F.col(score).alias("score"), F.col(label).cast("long").alias("_p"))
    found = cumulative_frequencies(rows, [], "score", descending=True, beside=["_p"])
    tp, positives = F.col("_p_upto"), F.col("_p_total")
    return found.select("score", tp.alias("tp"), (F.col("upto") - tp).alias("fp"), positives.alias("positives"), (F.col("total") - positives).alias("negatives"), F.col("_p").alias("tp_step"), (F.col("n") - F.col("_p")).alias("fp_step"))


def areas(points: DataFrame) -> DataFrame:
    """One row: ``auc`` (trapezoids from (0, 0)) and ``average_precision`` (steps in recall) of :func:`curve`.

    A trapezoid needs its step in tp and fp, which are the counts of its own score: no point looks at another one.
    """
    p, n = F.max("positives"), F.max("negatives")
    auc = F.sum(F.col("fp_step") * (2 * F.col("tp") - F.col("tp_step")) / 2.0)
    ap = F.sum(F.col("tp_step") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return points.agg((auc / F.nullif((p * n).cast("double"), F.lit(0.0))).alias("auc"), (ap / F.nullif(p.cast("double"), F.lit(0.0))).alias("average_precision"))


def target_encoding(train: DataFrame, df: DataFrame, category: str, label: str, name: str) -> DataFrame:
    """``df`` with the mean label of its category in ``train``; a category that ``train`` lacks gets the mean of all. Null is a category."""
    means = train.groupBy(F.col(category).alias("_c")).agg(F.avg(label).alias("_m"))
    whole = train.agg(F.avg(label).alias("_g"))
    out = df.join(means, F.col(category).eqNullSafe(F.col("_c")), "left").crossJoin(F.broadcast(whole))  # one row
    return out.withColumn(name, F.coalesce("_m", "_g")).drop("_c", "_m", "_g")


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, distinct, rows, kind``: constant (one value), key (all differ) or varying, exactly and in one pass over the values."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")
    counts = df.select(each).groupBy("x.column", "x.v").agg(F.count("*").alias("_n"))
    out = counts.groupBy("column").agg(F.count("v").alias("distinct"), F.sum("_n").alias("rows"))
    return out.withColumn("kind", F.when(F.col("distinct") <= 1, "constant").when(F.col("distinct") == F.col("rows"), "key").otherwise("varying"))


def votes(predictions: DataFrame, row: str, guess: str) -> DataFrame:
    """``row, learners, mean, median, majority`` of the learners' predictions (the smaller value of two equally frequent ones)."""
    counts = predictions.groupBy(row, guess).agg(F.count("*").alias("_n"))
    major = counts.groupBy(F.col(row).alias("_r")).agg(F.min_by(guess, F.struct(-F.col("_n"), F.col(guess))).alias("majority"))
    out = predictions.groupBy(row).agg(F.count("*").alias("learners"), F.avg(guess).alias("mean"), F.median(guess).alias("median"))  # a row's learners: as many as the ensemble has
    return out.join(major, F.col(row).eqNullSafe(F.col("_r"))).drop("_r")


def residuals(df: DataFrame, label: str) -> DataFrame:
    """The first stage of boosting: prediction = mean label; residual, gradient of the squared loss, and of the log loss."""
    mean = df.agg(F.avg(label).alias("f0"))
    rows = df.crossJoin(F.broadcast(mean))  # one row
    y = F.col(label)
    return rows.withColumns({"residual": y - F.col("f0"), "squared_gradient": 2 * (y - F.col("f0")), "log_gradient": y - 1 / (1 + F.exp(-F.col("f0")))})


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column as ``<c>_scaled`` = (x - mean) / population deviation, null where the deviation is 0."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    rows = df.crossJoin(F.broadcast(stats))  # one row
    return rows.withColumns({f"{c}_scaled": (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in columns}).drop(*[f"_{p}_{c}" for c in columns for p in "ms"])


def reconstruction_error(a: str, b: str) -> Column:
    """Mean squared difference of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)

