"""Tree models on Spark's ML library: single trees, forests, boosting, importances and out-of-bag scores."""

from __future__ import annotations

import json
import pickle
import random
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions.clean import number
from lodestream.operators import evaluation, sampling
from lodestream.session import tasks


def assembled(df: DataFrame, key: str, columns: Sequence[str], label: str, weights: Mapping[int, float] | None = None) -> DataFrame:
    """``key, x, y, w``: numbers (what is none is 0) as a vector, the label, and the weight of its class. Rows without a label are left out."""
    w = F.lit(1.0)
    for y, value in (weights or {}).items():
        w = F.when(F.col(label) == y, value).otherwise(w)
    rows = df.where(F.col(label).isNotNull()).select(key, *[number(c).alias(f"_{c}") for c in columns], F.col(label).cast("double").alias("y"), w.alias("w"))
    return VectorAssembler(inputCols=[f"_{c}" for c in columns], outputCol="x").transform(rows).select(key, "x", "y", "w")


def tree(train: DataFrame, depth: int):
    return DecisionTreeClassifier(featuresCol="x", labelCol="y", weightCol="w", maxDepth=depth, seed=42).fit(train)


def forest(train: DataFrame, depth: int = 8, trees: int = 100, share: float = 0.75, columns: str = "auto"):
    return RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", maxDepth=depth, numTrees=trees, subsamplingRate=share, featureSubsetStrategy=columns, seed=42).fit(train)


def boosted(train: DataFrame, rounds: int = 10, depth: int = 3):
    return GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", maxIter=rounds, maxDepth=depth, seed=42).fit(train)


def confused(predicted: DataFrame) -> DataFrame:
    """One row: confusion matrix and rates of rows with ``y`` and ``prediction``."""
    return evaluation.confusion(predicted, F.col("y"), F.col("prediction"))


def judged(model, test: DataFrame) -> DataFrame:
    """One row: confusion matrix and rates of a model on ``test``."""
    return confused(model.transform(test))


def depth_sweep(train: DataFrame, test: DataFrame, depths: Sequence[int]) -> DataFrame:
    """``depth`` and the rates of a tree of each depth: one row a depth."""
    out = None
    for d in depths:
        row = judged(tree(train, d), test).select(F.lit(d).alias("depth"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def importances(model, columns: Sequence[str], df: DataFrame) -> DataFrame:
    """``feature, importance``, the largest first; features that no tree uses have 0."""
    rows = [(c, float(model.featureImportances[i])) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: (-r[1], r[0])), "feature string, importance double")


def out_of_bag_scores(rows: DataFrame, key: str, learners: int = 3, depth: int = 4) -> DataFrame:
    """``rows, accuracy``: each learner is fitted on its own draws and judged, by majority, on the rows it hasn't drawn."""
    bags = sampling.bags(rows, key, learners)
    votes = None
    for i in range(learners):
        mine = bags.where(F.col("learner") == i)
        model = tree(mine.where("draws > 0").withColumn("w", F.col("w") * F.col("draws")), depth)
        part = model.transform(mine.where("draws = 0")).select(key, "y", "prediction")
        votes = part if votes is None else votes.unionByName(part)
    each = votes.groupBy(key).agg(F.max("y").alias("y"), F.when(F.avg("prediction") > 0.5, 1.0).otherwise(0.0).alias("g"))
    return each.agg(F.count("*").alias("rows"), F.avg(F.when(F.col("y") == F.col("g"), 1.0).otherwise(0.0)).alias("accuracy"))


#: The bound on the labelled rows that extra trees are fitted on (drawn by hash with ROWS / rows chance); every row is scored.
ROWS = 50_000


def _extra_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree as a heap: feature (-1 at a leaf), threshold and share of class 1 by node. A threshold is drawn, not searched."""
    rng = np.random.default_rng(seed)
    slots = 1 << (depth + 1)
    feature, cut, share = np.full(slots, -1), np.zeros(slots), np.zeros(slots)
    nodes = {1: np.arange(len(y))}
    many = max(1, int(np.sqrt(x.shape[1])))

    def impurity(rows: np.ndarray) -> float:
        total = w[rows].sum()
        p = (w[rows] * y[rows]).sum() / total if total else 0.0
        return total * 2 * p * (1 - p)

    for node in range(1, slots):
        rows = nodes.pop(node, None)
        if rows is None:
            continue
        total = w[rows].sum()
        share[node] = (w[rows] * y[rows]).sum() / total if total else 0.0
        if 2 * node >= slots or len(rows) < 2 * leaf or share[node] in (0.0, 1.0):
            continue
        low, high = x[rows].min(0), x[rows].max(0)
        open_ = np.flatnonzero(high > low)
        best, gain = None, 0.0
        for f in rng.permutation(open_)[:many]:
            at = rng.uniform(low[f], high[f])
            right = x[rows, f] >= at
            if min(right.sum(), (~right).sum()) < leaf:
                continue
            g = impurity(rows) - impurity(rows[right]) - impurity(rows[~right])
            if best is None or g > gain:
                best, gain = (f, at, right), g
        if best is not None:
            feature[node], cut[node] = best[:2]
            nodes[2 * node], nodes[2 * node + 1] = rows[~best[2]], rows[best[2]]
    return feature, cut, share


def extra_trees(train: DataFrame, key: str, depth: int = 8, trees: int = 100, leaf: int = 1, seed: int = 42):
    """Extremely randomised trees over :func:`assembled` rows: a function from such rows to them with ``prediction`` (1.0 where the mean share exceeds a half).

    They are fitted a tree a task on a bounded sample of the labelled rows (``ROWS``). Without rows all predictions are 0.
    """
    spark, n = train.sparkSession, max(1, train.count())
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / F.lit(float(1 << 53))
    sample = train.where(u * n < ROWS).orderBy(key).select(vector_to_array("x").alias("x"), "y", "w").toPandas()  # the documented bound
    if not len(sample):
        return lambda df: df.withColumn("prediction", F.lit(0.0))
    x, y, w = np.array(sample["x"].tolist(), float), sample["y"].to_numpy(float), sample["w"].to_numpy(float)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"tree": [pickle.dumps(_extra_tree(x, y, w, depth, leaf, seed + int(i))) for i in b["id"]]})

    grown = [pickle.loads(r["tree"]) for r in spark.range(trees).repartition(min(trees, tasks(spark))).mapInPandas(fit, "tree binary").collect()]  # a tree is at most 2 ** (depth + 1) nodes

    @F.pandas_udf("double")
    def predicted(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=float)
        rows = np.array(vectors.tolist(), float)
        total = np.zeros(len(rows))
        for feature, cut, share in grown:
            node = np.ones(len(rows), int)
            for _ in range(depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + (rows[np.arange(len(rows)), np.maximum(f, 0)] >= cut[node]), node)
            total += share[node]
        return pd.Series((total / len(grown) > 0.5).astype(float))

    return lambda df: df.withColumn("prediction", predicted(vector_to_array("x")))


#: Names that a search may draw: of a tree, and of a forest besides.
OF_TREES = {"depth": "maxDepth", "bins": "maxBins", "leaf": "minInstancesPerNode", "gain": "minInfoGain"}
OF_FORESTS = {"trees": "numTrees", "share": "subsamplingRate", "columns": "featureSubsetStrategy"}


def random_search(train: DataFrame, test: DataFrame, space: Mapping[str, Sequence], trials: int = 25, seed: int = 42) -> DataFrame:
    """``trial, params, f1, best``: seeded random draws from ``space``, judged on ``test``: a tree, or a forest if a name of forests is in it.

    Names: depth, bins, leaf (least rows), gain (least gain); trees, share (of rows a tree sees), columns (of a split). Equal draws are
    fitted once. The driver holds a row a trial.
    """
    rng = random.Random(seed)
    known = OF_TREES | OF_FORESTS
    if unknown := set(space) - set(known):
        raise ValueError(f"unknown parameters: {sorted(unknown)}; there are {sorted(known)}")
    kind = RandomForestClassifier if set(space) & set(OF_FORESTS) else DecisionTreeClassifier
    rows, seen = [], {}
    for trial in range(trials):
        drawn = {k: rng.choice(list(v)) for k, v in sorted(space.items())}
        key = json.dumps(drawn)
        if key not in seen:
            model = kind(featuresCol="x", labelCol="y", weightCol="w", seed=42, **{known[k]: v for k, v in drawn.items()})
            seen[key] = judged(model.fit(train), test).first()["f1"]
        rows.append((trial, key, seen[key]))
    best = max(r[2] or 0.0 for r in rows)
    return train.sparkSession.createDataFrame([(*r, (r[2] or 0.0) == best) for r in rows], "trial int, params string, f1 double, best boolean")
