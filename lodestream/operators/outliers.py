"""Outlier scores: isolation forest, local outlier factor and reconstruction error. Forests are fitted on bounded samples and applied to every row; LOF compares all rows with all."""

from __future__ import annotations

import json
import pickle
import random
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions.clean import finite, number
from lodestream.operators.evaluation import reconstruction_error
from lodestream.operators.forest import grown
from lodestream.operators.ordered import ranked, small
from lodestream.scratch import written
from lodestream.session import tasks

#: The bound on the rows that a model is fitted on (of one group, or of the whole table), and the rows of a group that one task scores.
SAMPLE, PART_ROWS = 256, 200_000
#: Rows of a block in the neighbour search; every block meets every other.
BLOCK = 1024


def _drawn(df: DataFrame, key: str, many: int, seed: int) -> DataFrame:
    """About ``many`` rows by hash of the key."""
    n = max(1, df.count())
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / F.lit(float(1 << 53))
    return df.where(u < many / n)


def _matrix(b: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1)


def forest_scores(df: DataFrame, key: str, columns: Sequence[str], sample: int = SAMPLE, trees: int = 100, seed: int = 42) -> DataFrame:
    """``key, score`` of one isolation forest over all rows. Values that are no finite numbers count as 0; too few rows score 0.5."""
    rows = df.select(key, *[number(c).alias(c) for c in columns])
    fit = _drawn(rows, key, sample, seed).orderBy(key).select(*columns).limit(2 * sample).collect()  # the documented bound
    forest = grown([np.array([tuple(r) for r in fit], float)], trees, sample, seed)[0] if len(fit) > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = forest.score(_matrix(b, columns)) if forest and len(b) else np.full(len(b), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(s)], names=[key, "score"])

    return rows.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, score double")


def forest_search(df: DataFrame, key: str, columns: Sequence[str], label: str, space: Mapping[str, Sequence[int]], trials: int = 25, seed: int = 42) -> DataFrame:
    """``trial, params, hits, best``: seeded random settings (``trees``, ``sample``) of :func:`forest_scores`; ``hits`` is the share of the rows with ``label`` 1
    among as many highest scores. Equal draws are fitted once; without a labelled row hits is null. The driver holds a row a trial."""
    rng = random.Random(seed)
    if unknown := set(space) - {"trees", "sample"}:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    flags = written(df.where(F.col(label) == 1).select(F.col(key).alias("_k")).distinct(), "flags")
    many = flags.count()
    rows, seen = [], {}
    for trial in range(trials):
        drawn = {k: rng.choice(list(v)) for k, v in sorted(space.items())}
        name = json.dumps(drawn)
        if name not in seen and many:
            top = forest_scores(df, key, columns, seed=seed, **drawn).orderBy(F.col("score").desc(), F.col(key)).limit(many)  # a report of the labelled rows' number
            seen[name] = top.join(flags, F.col(key) == F.col("_k"), "left_semi").count() / many
        rows.append((trial, name, seen.get(name)))
    best = max((r[2] for r in rows if r[2] is not None), default=None)
    return df.sparkSession.createDataFrame([(*r, r[2] is not None and r[2] == best) for r in rows], "trial int, params string, hits double, best boolean")


def _inputs(df: DataFrame, key: str, group: str, columns: Sequence[str]) -> DataFrame:
    """``key, group, _n`` (rows of the group) and finite inputs: missing ones take the group's mean, then 0. Rows without a group are left out."""
    value = {c: finite(F.col(c)) for c in columns}
    rows = df.where(F.col(group).isNotNull()).select(F.col(key), F.col(group), *[v.alias(c) for c, v in value.items()])
    stats = small(written(rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"_{c}") for c in columns]), "stats"), 10_000)
    return rows.join(stats, F.col(group) == F.col("_g")).select(key, group, "_n", *[F.coalesce(F.col(c), F.col(f"_{c}"), F.lit(0.0)).alias(c) for c in columns])


def group_models(df: DataFrame, key: str, group: str, columns: Sequence[str], sample: int = SAMPLE, trees: int = 50, seed: int = 42) -> DataFrame:
    """``group, model``: an isolation forest per group, fitted on about ``sample`` of its rows drawn by hash; a group of one row has none.

    The models stay a table: :func:`lodestream.sources.registry.register` keeps it, :func:`model_scores` brings each model to its rows.
    """
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / F.lit(float(1 << 53))
    kind = df.schema[group].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(key)[list(columns)].to_numpy(float)
        model = pickle.dumps(grown([x], trees, sample, seed)[0]) if len(x) > 1 else None
        return pd.DataFrame({group: [pdf[group].iloc[0]], "model": [model]})

    drawn = _inputs(df, key, group, columns).where(u * F.col("_n") < sample)
    return drawn.groupBy(group).applyInPandas(fit, f"`{group}` {kind}, model binary").where("model IS NOT NULL")


@lru_cache(maxsize=64)
def _loaded(model: bytes):
    """A model, kept in the worker process for the batches that follow."""
    return pickle.loads(model)


def model_scores(df: DataFrame, models: DataFrame, key: str, group: str, columns: Sequence[str], above: float = 0.5) -> DataFrame:
    """``key, group, score, anomaly`` of every row whose group has a model; the others are left out.

    A group's rows are cut by hash into parts of about ``PART_ROWS``, and a copy of its model goes to each part, ahead of its rows. So a group with a third of all
    rows is scored by many tasks, a task holds one model at a time, and no number of groups is too large.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = _inputs(df, key, group, columns)
    parts = F.ceil(F.col("_n") / PART_ROWS).cast("int")
    sizes = rows.groupBy(group).agg(F.first("_n").alias("_n"))
    heads = models.select(group, "model").join(sizes, group).select(F.lit(None).cast(kind[key]).alias(key), group, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), *[F.lit(0.0).alias(c) for c in columns], "model")
    body = rows.select(key, group, F.pmod(F.xxhash64(key), parts).cast("int").alias("_part"), *columns, F.lit(None).cast("binary").alias("model"))
    both = heads.unionByName(body).repartition(group, "_part").sortWithinPartitions(group, "_part", F.col("model").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, model = None, None
        for b in batches:
            g, part = b.column(group).to_numpy(zero_copy_only=False), b.column("_part").to_numpy()
            head, x = np.array(b.column("model").is_valid()), _matrix(b, columns)
            s = np.full(len(b), np.nan)
            starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (part[1:] != part[:-1])]) if len(b) else []
            for lo, hi in zip(starts, np.r_[starts[1:], len(b)] if len(b) else [], strict=True):
                if (g[lo], part[lo]) != at:
                    at, model = (g[lo], part[lo]), None
                if head[lo]:
                    model = _loaded(b.column("model")[int(lo)].as_py())
                own = np.arange(lo, hi)[~head[lo:hi]]
                if model is not None and len(own):
                    s[own] = model.score(x[own])
            keep = pa.array(~np.isnan(s))
            out = [b.column(key), b.column(group), pa.array(s), pa.array((s > above).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in out], names=[key, group, "score", "anomaly"])

    return both.mapInArrow(run, f"`{key}` {kind[key]}, `{group}` {kind[group]}, score double, anomaly int")


def group_scores(df: DataFrame, key: str, group: str, columns: Sequence[str], sample: int = SAMPLE, trees: int = 50, above: float = 0.5, seed: int = 42) -> DataFrame:
    """``key, group, score, anomaly``: :func:`group_models` fitted and applied; a group without a model (null, or one row) emits nothing."""
    models = written(group_models(df, key, group, columns, sample, trees, seed), "models")
    return model_scores(df, models, key, group, columns, above)


class LocalOutlierFactor:
    """The density of a point's neighbourhood against that of its neighbours, over the rows of one array."""

    def __init__(self, x: np.ndarray, k: int = 20) -> None:
        self.mean, std = x.mean(0), x.std(0)
        self.scale = np.where(std > 0, std, 1.0)
        self.x = (x - self.mean) / self.scale
        self.k = max(1, min(k, len(x) - 1))
        d = self._distance(self.x)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, : self.k]
        far = np.take_along_axis(d, near, 1)
        self.reach = far[:, -1]
        self.density = 1 / np.maximum(np.maximum(self.reach[near], far).mean(1), 1e-10)
        self.own = self.density[near].mean(1) / self.density  # factors of the sample's own rows

    def _distance(self, y: np.ndarray) -> np.ndarray:
        d = (y * y).sum(1)[:, None] + (self.x * self.x).sum(1)[None, :] - 2 * y @ self.x.T
        return np.sqrt(np.maximum(d, 0))


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """``_i, v`` packed: a row per block of at most ``BLOCK`` rows, written once."""
    packed = rows.groupBy(F.floor((F.col("_i") - 1) / BLOCK).alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_i", "v"))).alias("_l"))
    return written(packed.select(F.col("_l._i").alias(f"{name}i"), F.flatten("_l.v").alias(f"{name}v")), "blocks")


def _nearest(queries: DataFrame, others: DataFrame, k: int, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """``_i, near``: the ``k`` nearest (distance, ``_i``) of each row of ``queries`` among all of ``others``, nearest first, without the row itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                qi, qv, ci, cv = [b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("qi", "qv", "ci", "cv")]
                x, y = (qv.reshape(len(qi), -1) - mean) / scale, (cv.reshape(len(ci), -1) - mean) / scale
                d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
                d[qi[:, None] == ci[None, :]] = np.inf
                at = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(ci) else np.tile(np.arange(len(ci)), (len(qi), 1))
                far = np.stack([np.sqrt(((x - y[j]) ** 2).sum(1)) for j in at.T], 1)  # differences again: the products are off where rows are equal
                other = ci[at] != qi[:, None]
                offsets = np.concatenate([[0], other.sum(1).cumsum()]).astype(np.int32)
                near = pa.StructArray.from_arrays([pa.array(far[other]), pa.array(ci[at][other])], names=["d", "j"])
                yield pa.RecordBatch.from_arrays([pa.array(qi), pa.ListArray.from_arrays(pa.array(offsets), near)], names=["_i", "near"])

    pairs = queries.repartition(tasks(queries.sparkSession)).crossJoin(others)  # blocks, not rows
    each = pairs.mapInArrow(run, "_i long, near array<struct<d: double, j: long>>")
    return written(each.groupBy("_i").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near")), "near")


def lof_scores(df: DataFrame, key: str, vector: str, k: int = 20, sample: int | None = None, seed: int = 42) -> DataFrame:
    """``key, lof``: the local outlier factor (about 1 is usual, more is stranger) of every row, its ``k`` neighbours searched exactly among all rows.

    A row is no neighbour of itself; equal rows are. Distances are between scaled vectors. A row without neighbours scores 1, null vectors
    are left out. The work grows with the square of the rows; only if ``sample`` is given, neighbours are searched among about so many drawn rows.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("v"))
    rows = written(ranked(rows, [F.col("_key").asc(), F.xxhash64("v").asc()], "_i"), "vectors")
    each = rows.select(F.posexplode("v").alias("_p", "_x")).groupBy("_p").agg(F.avg("_x").alias("m"), F.stddev_pop("_x").alias("s"))
    stats = sorted(each.collect())  # a row per dimension
    mean, std = np.array([r["m"] for r in stats]), np.array([r["s"] for r in stats])
    others = rows if sample is None else _drawn(rows, "_i", sample, seed)
    near = _nearest(_blocks(rows, "q"), _blocks(others, "c"), k, mean, np.where(std > 0, std, 1.0))
    links = near.select("_i", F.explode("near").alias("_n")).select("_i", F.col("_n.d").alias("d"), F.col("_n.j").alias("j"))
    reach = near.select(F.col("_i").alias("j"), F.array_max("near.d").alias("reach"))
    density = links.join(reach, "j").groupBy("_i").agg((1 / F.greatest(F.avg(F.greatest("reach", "d")), F.lit(1e-10))).alias("density"))
    density = written(density, "density")
    around = links.join(density.select(F.col("_i").alias("j"), F.col("density").alias("near")), "j").groupBy("_i").agg(F.avg("near").alias("around"))
    lof = around.join(density, "_i").select("_i", (F.col("around") / F.col("density")).alias("lof"))
    return rows.select("_key", "_i").join(lof, "_i", "left").select(F.col("_key").alias(key), F.coalesce("lof", F.lit(1.0)).alias("lof"))


def pca_errors(df: DataFrame, key: str, vector: str, k: int = 8) -> DataFrame:
    """``key, error``: mean squared error of rebuilding a vector from ``k`` principal components. It stands in for an autoencoder."""
    rows = df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    model = PCA(k=k, inputCol="x", outputCol="z").fit(rows.select(array_to_vector("v").alias("x")))
    axes = model.pc.toArray().T.tolist()
    out = model.transform(rows.withColumn("x", array_to_vector("v"))).withColumn("z", vector_to_array("z"))
    width = len(axes[0])
    back = F.array(*[sum((F.col("z")[j] * F.lit(axes[j][i]) for j in range(k)), F.lit(0.0)) for i in range(width)])
    return out.withColumn("_back", back).select(key, reconstruction_error("v", "_back").alias("error"))
