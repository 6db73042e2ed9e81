"""Severity of scored rows: squashed components, a weighted blend, labels, daily roll-ups and score reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.clean import number
from lodestream.operators.ordered import cumulative_frequencies, interpolated


def tanh(z: Column, scale: float, absolute: bool = True) -> Column:
    """Smoothly to 0..1 (or -1..1 with the sign)."""
    return F.tanh((F.abs(z) if absolute else z) / scale)


def logistic(z: Column, scale: float, absolute: bool = True) -> Column:
    """Logistic, 0.5 at 0; the argument ends at 20 to either side."""
    x = (F.abs(z) if absolute else z) / scale
    return 1 / (1 + F.exp(-F.least(F.lit(20.0), F.greatest(F.lit(-20.0), x))))


def linear(z: Column, scale: float, absolute: bool = True) -> Column:
    """A ramp that ends at 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.abs(z) if absolute else z) / scale))


SQUASH = {"tanh": tanh, "logistic": logistic, "linear": linear}

# Components, their columns and weights, flags and defaults of the severity index.
COLUMNS = {"SC": "SC_z_score_session_cnt", "SS": "SS_z_score_max", "SL": "SL_z_score", "ZB": "ZB_z_score", "BU": "BU_z_score_bytes_usage", "IDLE": "IDLE_z_idle"}
WEIGHTS = {"SC": 0.15, "SS": 0.15, "SL": 0.20, "ZB": 0.20, "BU": 0.15, "IDLE": 0.15}
FLAGS = ("anomaly", "shortSessionAnomaly", "ZerobytesUsagenAnomaly")


@dataclass(frozen=True)
class Config:
    """How severity is computed. :meth:`of` takes overrides before a configuration file's values before these defaults."""

    columns: Mapping[str, str] = field(default_factory=lambda: dict(COLUMNS))
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    flags: Sequence[str] = FLAGS
    persistence: str | None = None
    scales: Mapping[str, float] = field(default_factory=dict)
    methods: Mapping[str, str] = field(default_factory=dict)
    polarity: Mapping[str, int] = field(default_factory=dict)
    absolute: Mapping[str, bool] = field(default_factory=dict)
    scale: float = 3.0
    method: str = "tanh"
    core: float = 0.85
    flag: float = 0.10
    persist: float = 0.05
    low: float = 0.30
    high: float = 0.70
    severe: float = 0.70
    window: int = 7

    @classmethod
    def of(cls, file: Mapping | None = None, **overrides) -> Config:
        known = {f.name for f in fields(cls)}
        given = {**(file or {}), **{k: v for k, v in overrides.items() if v is not None}}
        if unknown := set(given) - known:
            raise ValueError(f"unknown severity settings: {sorted(unknown)}")
        return replace(cls(), **given)


def components(df: DataFrame, c: Config) -> DataFrame:
    """``<name>_score`` per component. A column that ``df`` lacks counts as 0, like a value that is no finite number."""
    out = {}
    for name, column in c.columns.items():
        method = c.methods.get(name, c.method)
        if method not in SQUASH:
            raise ValueError(f"unknown squash {method!r} for {name}; there are {sorted(SQUASH)}")
        z = (number(column) if column in df.columns else F.lit(0.0)) * c.polarity.get(name, 1)
        out[f"{name}_score"] = SQUASH[method](z, float(c.scales.get(name, c.scale)), c.absolute.get(name, True))
    return df.withColumns(out)


def severity(df: DataFrame, c: Config | None = None, name: str = "Severity_final", label: str = "Severity_label") -> DataFrame:
    """``df`` with components, ``Severity_S0`` (weights made to add up to 1), severity in 0..1 and its label.

    Flags are averaged over those that ``df`` has. Nulls, NaN and infinities count as 0 everywhere.
    """
    c = c or Config()
    if set(c.weights) != set(c.columns):
        raise ValueError(f"weights and columns have to have the same names: {sorted(set(c.weights) ^ set(c.columns))}")
    whole = sum(c.weights.values())
    whole = whole if whole > 0 else 1.0
    add = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0.0))
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    present = [f for f in c.flags if f in df.columns]
    out = components(df, c).withColumn("Severity_S0", add(F.lit(c.weights[k] / whole) * F.col(f"{k}_score") for k in c.columns))
    flags = clip(add(number(f) for f in present) / len(present)) if present else F.lit(0.0)
    persist = clip(number(c.persistence)) if c.persistence and c.persistence in df.columns else F.lit(0.0)
    out = out.withColumn(name, clip(c.core * F.col("Severity_S0") + c.flag * flags + c.persist * persist))
    return out.withColumn(label, labelled(F.col(name), c.low, c.high))


def labelled(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, "Low").when(x < high, "Medium").otherwise("High")


def rolling(daily: DataFrame, column: str, window: int = 7) -> DataFrame:
    """Mean over the last ``window`` rows of a table with a row a day (days without a row are not counted in)."""
    days = Window.orderBy("date").rowsBetween(1 - window, 0)  # one row a day
    return daily.withColumn(f"{column}_rolling", F.avg(column).over(days))


def severe_devices(df: DataFrame, day: Column, device: str, score: str, least: float = 0.7, window: int = 7) -> DataFrame:
    """``date, devices_severe, devices_severe_rolling``: distinct devices a day at or above ``least``."""
    daily = df.where(F.expr(f"try_cast(`{score}` AS DOUBLE)") >= least).where(~F.isnan(score)).groupBy(day.alias("date")).agg(F.count_distinct(device).alias("devices_severe"))
    return rolling(daily, "devices_severe", window)


def flagged_devices(df: DataFrame, day: Column, device: str, columns: Sequence[str], least: float = 3.0, window: int = 7) -> DataFrame:
    """``date, devices_flagged, devices_flagged_rolling``: distinct devices a day with any z score ``least`` or more from 0.

    Columns that ``df`` lacks are skipped; without any, no row is flagged.
    """
    any_ = reduce(lambda a, b: a | b, [F.abs(number(c)) >= least for c in columns if c in df.columns], F.lit(False))
    daily = df.where(any_).groupBy(day.alias("date")).agg(F.count_distinct(device).alias("devices_flagged"))
    return rolling(daily, "devices_flagged", window)


def trend(df: DataFrame, device: str, which: int, columns: Sequence[str]) -> DataFrame:
    """One device's rows over time; columns that ``df`` lacks are skipped."""
    return df.where(F.col(device) == which).select(device, "date", "hour", *[c for c in columns if c in df.columns])


def summary(df: DataFrame, score: str) -> DataFrame:
    x = F.col(score)
    return df.agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"))


def percentiles(df: DataFrame, score: str, points: Mapping[str, float]) -> DataFrame:
    """Exact linear percentiles of all rows, from the distributed sort."""
    return interpolated(df, [], score, points).drop("readings")


def operating_points(df: DataFrame, score: str, points: Mapping[str, float]) -> DataFrame:
    """``point, threshold, share``: which share of rows is at or above each percentile."""
    limits = percentiles(df, score, points)
    rows = df.select(F.col(score).alias("_s")).where(F.col("_s").isNotNull()).crossJoin(F.broadcast(limits))  # one row
    shares = rows.agg(*[F.avg(F.when(F.col("_s") >= F.col(n), 1.0).otherwise(0.0)).alias(f"{n}_share") for n in points], *[F.max(n).alias(n) for n in points])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(n).alias("point"), F.col(n).alias("threshold"), F.col(f"{n}_share").alias("share")) for n in points])).alias("p")).select("p.*")


def histogram(df: DataFrame, score: str, bins: int = 50) -> DataFrame:
    """``bin, n`` of equal-width bins; the last one has its upper end. Empty bins have no row."""
    ends = df.agg(F.min(score).alias("_a"), F.max(score).alias("_b"))
    rows = df.where(F.col(score).isNotNull()).select(F.col(score).alias("_s")).crossJoin(F.broadcast(ends))  # one row
    at = F.floor((F.col("_s") - F.col("_a")) / F.nullif((F.col("_b") - F.col("_a")) / bins, F.lit(0.0)))
    return rows.groupBy(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def batch_severity(df: DataFrame, score: str, method: str = "topk", k: int | None = None, p: float = 99.0, threshold: float | None = None) -> DataFrame:
    """One row, ``severity``: the mean of the top k (by default the larger of 50 and 1 percent), of what is at or above a percentile
    or a threshold, or of all; 0 without rows. The top k comes from running counts, not from a sort into one task."""
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score)).select(F.col(score).cast("double").alias("_s"))
    if method == "topk":
        counts = cumulative_frequencies(rows, [], "_s", descending=True)
        total = F.col("total")
        most = F.lit(k).cast("long") if k else F.greatest(F.lit(50).cast("long"), F.floor(total * 0.01))
        most = F.greatest(F.lit(1).cast("long"), F.least(most, total))
        taken = F.least("upto", most) - F.least("before", most)
        return counts.agg(F.coalesce(F.sum(taken * F.col("_s")) / F.sum(taken), F.lit(0.0)).alias("severity"))
    if method == "percentile":
        limit = percentiles(rows, "_s", {"_t": p / 100})
        rows = rows.crossJoin(F.broadcast(limit)).where(F.col("_s") >= F.col("_t"))  # one row
    elif method == "threshold":
        if threshold is None:
            raise ValueError("the threshold method needs a threshold")
        rows = rows.where(F.col("_s") >= threshold)
    return rows.agg(F.coalesce(F.avg("_s"), F.lit(0.0)).alias("severity"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, n, mean, std`` (population) of the finite values, in one pass."""
    ok = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double"))
    aggs = [x for c in columns for x in (F.count(ok(c)).alias(f"{c}.n"), F.avg(ok(c)).alias(f"{c}.m"), F.stddev_pop(ok(c)).alias(f"{c}.s"))]
    row = df.agg(*aggs)
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}.n`").alias("n"), F.col(f"`{c}.m`").alias("mean"), F.col(f"`{c}.s`").alias("std")) for c in columns])
    return row.select(F.explode(each).alias("x")).select("x.*")
