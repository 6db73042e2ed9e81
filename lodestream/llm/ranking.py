"""One ranking from differently scaled scores: closeness to an ideal point.

Each score is winsorised at two of its own quantiles (exact, from the distributed sort), divided by its vector norm,
and weighted; a record's rank comes from its distances to the best and the worst point. A range, however large,
cannot dominate: outliers end at the winsor limits and the norm takes the unit out, so a score in other units ranks alike.
All scores weigh the same unless weights are given.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions.clean import finite
from lodestream.llm.quantiles import melted, quantiles
from lodestream.operators.ordered import ranked


def closeness(df: DataFrame, scores: Sequence[str], limits: tuple[float, float] = (0.02, 0.98), weights: Mapping[str, float] | None = None) -> DataFrame:
    """``df`` with ``to_ideal``, ``to_worst``, ``closeness`` (0 to 1, higher leads) and ``missing`` (scores without a finite value).

    A missing score takes the median of its column, so it neither leads nor trails by it. A column that is constant or
    empty adds no distance; if all are, closeness is 0.5. ``weights`` are 1 where not given. A record has distance 0 to the ideal exactly if each
    score is at or above the upper winsor limit. Only two limits, a median and a norm per score reach the driver.
    """
    points = {"lo": limits[0], "mid": 0.5, "hi": limits[1]}
    found = {r["field"]: r for r in quantiles(melted(df, [], scores), ["field"], "value", points).collect()}  # a row per score
    clipped = {c: F.least(F.greatest(F.coalesce(finite(F.col(c)), F.lit(r["mid"])), F.lit(r["lo"])), F.lit(r["hi"])) for c, r in found.items()}
    norms = df.agg(*[F.sqrt(F.sum(x * x)).alias(c) for c, x in clipped.items()]).first().asDict() if clipped else {}
    up, down = [], []
    for c, r in found.items():
        if r["hi"] > r["lo"] and norms[c]:
            scale = F.lit(float((weights or {}).get(c, 1.0)) / norms[c])
            up.append(F.pow((F.lit(r["hi"]) - clipped[c]) * scale, 2))
            down.append(F.pow((clipped[c] - F.lit(r["lo"])) * scale, 2))
    add = lambda xs: F.sqrt(reduce(lambda a, b: a + b, xs, F.lit(0.0)))
    missing = reduce(lambda a, b: a + b, [F.when(finite(F.col(c)).isNull(), 1).otherwise(0) for c in scores])
    both = F.col("to_ideal") + F.col("to_worst")
    out = df.withColumns({"to_ideal": add(up), "to_worst": add(down), "missing": missing})
    return out.withColumn("closeness", F.when(both > 0, F.col("to_worst") / both).otherwise(0.5))


def ranking(df: DataFrame, key: str, scores: Sequence[str], limits: tuple[float, float] = (0.02, 0.98), weights: Mapping[str, float] | None = None) -> DataFrame:
    """:func:`closeness` with ``position`` (from 1, the most unusual first); equal records are ordered by ``key``."""
    return ranked(closeness(df, scores, limits, weights), [F.col("closeness").desc(), F.col(key).asc()])
