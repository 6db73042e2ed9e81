"""Hourly session features: one aggregate over the events, then statistics over each device's hours.

Grouped rows are at most one per device and hour, so the windows over a device stay small however many events it has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.scratch import written

KEYS = ["app_id", "device_id", "day", "hr"]
DEVICE = KEYS[:2]


def nudged(x: Column) -> Column:
    """Six digits, moved off the ties that the order of summing would decide."""
    return F.round(x + 1e-9, 6)


REPEAT = ["app_id", "device_id", "event_date", "record_type", "session_id"]


def once(events: DataFrame, beside: Sequence[str] = ()) -> DataFrame:
    """An event per (app, device, time, record type, session): repeats that arrived again carry the same values; NaN times become null.

    ``beside``: columns that follow from the time and are kept with it.
    """
    time = F.when(~F.isnan("session_time"), F.col("session_time"))
    return events.groupBy(*REPEAT, *beside).agg(F.min("input_bytes").alias("input_bytes"), F.min("output_bytes").alias("output_bytes"), F.min(time).alias("session_time"))


def arrived(events: DataFrame, job: str, hours: int = 1) -> DataFrame:
    """Events that arrived from ``hours`` before the job's hour to its end, and happened in the ``hours`` before it.

    The arrival columns are compared as partition columns are stored, so folders outside are pruned.
    """
    end = F.date_trunc("hour", F.lit(job).cast("timestamp_ntz")).cast("timestamp_ntz")
    steps = F.sequence(end - F.expr(f"INTERVAL {hours} HOURS"), end, F.expr("INTERVAL 1 HOUR"))
    stamp = F.make_timestamp_ntz("year", "month", "day", "hour", F.lit(0), F.lit(0))
    event = F.col("event_date")
    return events.where(F.array_contains(steps, stamp) & (event >= end - F.expr(f"INTERVAL {hours} HOURS")) & (event < end))


def hourly(events: DataFrame, short: int = 60) -> DataFrame:
    """All measures of a device's hour: distinct sessions, short ones and their mean length, mean time, zero-usage records.

    Events move once, by device and hour, which spreads a busy device over its hours; repeats, distinct sessions and the
    measures are all found where the events then lie.
    """
    rows = events.withColumns({"day": F.to_date("event_date"), "hr": F.hour("event_date")})
    rows = once(rows.select(*REPEAT, "day", "hr", "input_bytes", "output_bytes", "session_time").repartition(*KEYS), ["day", "hr"])
    brief = F.col("session_time").cast("int") <= short
    return rows.groupBy(*KEYS).agg(
        F.count_distinct("session_id").alias("session_count"),
        F.count(F.when(brief, 1)).alias("max_shortLength"),
        F.avg(F.when(brief, F.col("session_time"))).alias("AvgSessionLengthTime"),
        F.avg("session_time").alias("session_time"),
        F.count(F.when(F.col("input_bytes") + F.col("output_bytes") == 0, 1)).alias("max_zero_bytes_Count"),
    )


def expanding(hours: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``hours`` with ``expanding_mean_<c>`` (0 before the first) and ``expanding_std_<c>`` over the device's earlier hours."""
    before = Window.partitionBy(*DEVICE).orderBy("day", "hr").rowsBetween(Window.unboundedPreceding, -1)
    stats = {f"expanding_mean_{c}": F.coalesce(F.avg(c).over(before), F.lit(0.0)) for c in columns}
    stats |= {f"expanding_std_{c}": F.coalesce(F.stddev_pop(c).over(before), F.lit(0.0)) for c in columns}
    return hours.withColumns(stats)


def advanced(hours: DataFrame, history: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One new hour per device against its history: the old mean and deviation are shown, the new ones stored in ``prev_*``.

    The update is the exact one for a single new value, which is why ``hours`` has one row per device; for many, use
    :func:`expanding`. Devices without history start from 0; a null value leaves its statistics as they were. One join for all ``columns``.
    """
    stats = [f"prev_{s}_{c}" for c in columns for s in ("mean", "std", "count")]
    old = history.select(*[F.col(k).alias(f"_{k}") for k in DEVICE], *[F.col(p).alias(f"_{p}") for p in stats])
    rows = hours.join(old, (F.col("app_id") == F.col("_app_id")) & (F.col("device_id") == F.col("_device_id")), "left")
    out = {}
    for c in columns:
        mean, std, n = (F.coalesce(f"_prev_{s}_{c}", F.lit(zero)) for s, zero in (("mean", 0.0), ("std", 0.0), ("count", 0)))
        x = F.col(c)
        new_mean = F.when(x.isNull(), mean).otherwise((mean * n + x) / (n + 1))
        new_std = F.when(x.isNull(), std).otherwise(F.sqrt((std * std * n + (x - mean) * (x - new_mean)) / (n + 1)))
        out |= {f"expanding_mean_{c}": mean, f"expanding_std_{c}": std, f"prev_mean_{c}": new_mean, f"prev_std_{c}": new_std, f"prev_count_{c}": n + x.isNotNull().cast("int")}
    return rows.withColumns(out).drop("_app_id", "_device_id", *[f"_{p}" for p in stats])


def incremental(hours: DataFrame, history: DataFrame, column: str) -> DataFrame:
    """:func:`advanced` for one column."""
    return advanced(hours, history, [column])


def z_score(x: Column, mean: Column, std: Column) -> Column:
    """Null where the deviation is 0."""
    return (x - mean) / F.nullif(std, F.lit(0.0))


def two_sided(column: str, z: float = 3.0, least: float = 4.0) -> Column:
    """1 where a value is more than ``z`` deviations and more than ``least`` away from what the device had before."""
    x, mean = F.col(column), F.col(f"expanding_mean_{column}")
    return F.when((F.abs(z_score(x, mean, F.col(f"expanding_std_{column}"))) > z) & (F.abs(x - mean) > least), 1).otherwise(0)


def asymmetric(column: str, high: Column, low: Column) -> Column:
    """1 where z > 3 and the difference is above ``high``, or z < -1 and it is below ``low``."""
    x, mean = F.col(column), F.col(f"expanding_mean_{column}")
    z = z_score(x, mean, F.col(f"expanding_std_{column}"))
    return F.when(((z > 3) & (x - mean > high)) | ((z < -1) & (x - mean < low)), 1).otherwise(0)


def zero_usage(hours: DataFrame, more_than: int = 5, rows: int = 8) -> DataFrame:
    """Zero-usage counts with the mean over the last ``rows`` active hours that had any, the hour itself included, and the flag."""
    recent = Window.partitionBy(*DEVICE).orderBy("day", "hr").rowsBetween(1 - rows, 0)
    some = F.nullif(F.col("max_zero_bytes_Count"), F.lit(0))
    flag = F.when(F.col("max_zero_bytes_Count") > more_than, 1).otherwise(0)
    return hours.withColumns({"rolling_mean_zero_bytes_Count": F.coalesce(F.avg(some).over(recent), F.lit(0.0)), "ZerobytesUsagenAnomaly": flag})


COLUMNS = ["session_count", "max_shortLength", "session_time"]


def job_hour(job: str | datetime | None = None) -> datetime:
    """The full hour that a job at ``job`` (``yyyy-MM-dd HH:mm:ss``, or a time; now in UTC where None) works on: the one that has just ended."""
    at = datetime.now(UTC).replace(tzinfo=None) if job is None else job if isinstance(job, datetime) else datetime.strptime(job, "%Y-%m-%d %H:%M:%S")  # noqa: DTZ007
    return at.replace(minute=0, second=0, microsecond=0) - timedelta(hours=1)


def at_hour(at: datetime) -> Column:
    """Rows of one hour of :func:`hourly`."""
    return (F.col("day") == F.lit(at.date())) & (F.col("hr") == at.hour)


def job(events: DataFrame, history: DataFrame, last_n: DataFrame, when: str | datetime | None = None, limits: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run of the hourly job: the features of the hour that ended last, the new history and the new last seven hours.

    ``events`` are read by their arrival columns, so only two hours' folders are touched; ``history`` (:func:`latest_history`) has a row
    per device, ``last_n`` (``app_id, device_id, day, hr, max_zero_bytes_Count``) the device's recent active hours. No earlier event is read
    again: run hour after hour, the features equal those of :func:`expanding` and :func:`zero_usage` over everything. Devices without
    events keep their history; all of it is stamped with the hour. ``limits``: from the hour's rows to ``high, low`` (one row), by default its
    95 and 10 percent quantiles of the difference to the mean, from a sketch. Null ids have features but no history. The hour's rows are
    written once.
    """
    at = job_hour(when)
    hours = hourly(arrived(events, str(at + timedelta(hours=1)))).where(at_hour(at))
    rows = advanced(hours, history, COLUMNS)
    kept = last_n.select(*KEYS, "max_zero_bytes_Count").where((F.col("day") < F.lit(at.date())) | ((F.col("day") == F.lit(at.date())) & (F.col("hr") < at.hour)))
    some = F.when(F.col("max_zero_bytes_Count") != 0, F.struct("day", "hr", F.col("max_zero_bytes_Count").alias("n"))).otherwise(F.struct("day", "hr", F.lit(None).cast("long").alias("n")))
    recent = kept.groupBy(*DEVICE).agg(F.slice(F.sort_array(F.collect_list(some), False), 1, 7).alias("_recent"))  # a device's stored hours
    rows = rows.join(recent, [rows[k].eqNullSafe(recent[k]) for k in DEVICE], "left").drop(*[recent[k] for k in DEVICE])
    own = F.nullif(F.col("max_zero_bytes_Count"), F.lit(0))
    seen = F.filter(F.concat(F.array(own), F.coalesce(F.col("_recent.n"), F.array().cast("array<bigint>"))), lambda x: x.isNotNull())
    total = F.aggregate(seen, F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = rows.withColumns({"rolling_mean_zero_bytes_Count": F.when(F.size(seen) > 0, total / F.size(seen)).otherwise(0.0), "ZerobytesUsagenAnomaly": F.when(F.col("max_zero_bytes_Count") > 5, 1).otherwise(0)}).drop("_recent")
    rows = written(rows, "hour")
    if limits is None:
        diff = F.col("session_time") - F.col("expanding_mean_session_time")
        bounds = rows.agg(F.percentile_approx(diff, 0.95, 10000).alias("high"), F.percentile_approx(diff, 0.10, 10000).alias("low"))
    else:
        bounds = limits(rows)
    flags = {
        "AnomalySessionCount": two_sided("session_count"),
        "shortSessionAnomaly": two_sided("max_shortLength"),
        "sessionTimeAnomalyBasedOnHistory": F.coalesce(asymmetric("session_time", F.col("high"), F.col("low")), F.lit(0)),
    }
    stamp = {"date": F.lit(str(at.date())), "hour": F.lit(f"{at.hour:02d}")}
    stats = [f"prev_{s}_{c}" for c in COLUMNS for s in ("mean", "std", "count")]
    features = rows.crossJoin(F.broadcast(bounds)).withColumns(flags | stamp)  # one row
    features = features.drop("high", "low", "day", "hr", *stats, *[f"expanding_std_{c}" for c in COLUMNS])
    known = rows.where(F.col("app_id").isNotNull() & F.col("device_id").isNotNull())
    new = upserted(history.select(*DEVICE, "date", "hour", *stats), known.withColumns(stamp).select(*DEVICE, "date", "hour", *stats)).withColumns(stamp)
    line = Window.partitionBy(*DEVICE).orderBy(F.col("day").desc(), F.col("hr").desc())  # at most a device's stored hours and one
    later = kept.unionByName(known.select(kept.columns)).withColumn("_r", F.row_number().over(line)).where("_r <= 7").drop("_r")
    return features, new, later


def latest_history(history: DataFrame) -> DataFrame:
    """One row per device, the one with the most observations (then the latest)."""
    order = Window.partitionBy(*DEVICE).orderBy(F.col("prev_count_session_count").desc(), F.col("date").desc(), F.col("hour").desc())
    return history.distinct().withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def upserted(history: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows and the ``history`` rows of devices that have none; a null id never matches, so such history is carried on."""
    return history.join(new.select(*DEVICE).distinct(), DEVICE, "left_anti").select(*history.columns).unionByName(new.select(*history.columns))
