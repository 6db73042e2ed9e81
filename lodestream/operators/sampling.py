"""Samples that a hash decides, so they are the same on every run and need no shuffle."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.ordered import ranked
from lodestream.scratch import written


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) from the md5 of the keys and a seed (so that SQL can give the same)."""
    digest = F.md5(F.concat_ws("_", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def split(df: DataFrame, key: str, parts: dict[str, float], seed: int = 42, name: str = "part") -> DataFrame:
    """``df`` with the part each key falls into; the shares are made to add up to 1."""
    u, whole, edge, out = uniform(seed, key), sum(parts.values()), 0.0, None
    for part, share in list(parts.items())[:-1]:
        edge += share / whole
        out = F.when(u < edge, part) if out is None else out.when(u < edge, part)
    last = list(parts)[-1]
    return df.withColumn(name, out.otherwise(last) if out is not None else F.lit(last))


def bags(df: DataFrame, key: str, learners: int, seed: int = 7, most: int = 12) -> DataFrame:
    """Sampling with replacement, distributed: ``learner, draws`` per row and learner, draws from a Poisson of mean 1 (0 is out of bag).

    The Poisson stands for m draws out of m rows at any size; more than ``most`` draws have a chance below 2**-32, the resolution of the hash.
    """
    learner = F.explode(F.sequence(F.lit(0), F.lit(learners - 1))).alias("learner")
    rows = df.select("*", learner)
    u = uniform(seed, key, F.col("learner"))
    p, total, steps = 0.36787944117144233, 0.0, []
    for k in range(most):
        total += p
        steps.append(F.when(u >= total, 1).otherwise(0))
        p /= k + 1
    return rows.withColumn("draws", sum(steps[1:], steps[0]))


def exact_bags(df: DataFrame, key: str, learners: int, many: int | None = None, seed: int = 7) -> DataFrame:
    """:func:`bags` with exactly ``many`` draws a learner (as many as rows by default): each draw names a position in the order of ``key``.

    The draws are counted per position before they meet the rows; nobody holds them all. Equal keys are rows of their own.
    """
    rows = written(ranked(df, [F.col(key).asc(), F.xxhash64(*df.columns).asc()], "_at"), "ranked")
    n = rows.count()
    draws = df.sparkSession.range((n if many is None else many) * learners if n else 0).select((F.col("id") % learners).cast("int").alias("learner"), (F.floor(uniform(seed, F.col("id")) * n) + 1).alias("_at"))
    counts = draws.groupBy("learner", "_at").agg(F.count("*").cast("int").alias("draws"))
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(learners - 1))).alias("learner"))
    return each.join(counts, ["learner", "_at"], "left").select(*df.columns, "learner", F.coalesce("draws", F.lit(0)).alias("draws"))


def out_of_bag(bagged: DataFrame) -> DataFrame:
    """Each learner's rows that it hasn't drawn."""
    return bagged.where("draws = 0").drop("draws")


def columns(names: Sequence[str], many: int, seed: int = 0) -> list[str]:
    """``many`` of the names, in their order."""
    chosen = set(random.Random(seed).sample(list(names), many))
    return [n for n in names if n in chosen]
