"""Alerts from flagged hours: causes, normal and unusual counts, one row per cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.clean import day, hour

# Each cause's name, flag, count and baseline.
CAUSES = {
    "ShortSession": ("shortSessionAnomaly", "max_shortLength", "expanding_mean_max_shortLength"),
    "ZeroByteSession": ("ZerobytesUsagenAnomaly", "max_zero_bytes_Count", "rolling_mean_zero_bytes_Count"),
}
CAP = 5


def cause() -> Column:
    """The causes whose flag is set, joined by a comma; an empty text if there is none."""
    return F.concat_ws(", ", *[F.when(F.col(flag) == 1, F.lit(name)) for name, (flag, _, _) in CAUSES.items()])


def event_time() -> Column:
    at = F.make_timestamp_ntz(F.year(day()), F.month(day()), F.dayofmonth(day()), hour(), F.lit(0), F.lit(0))
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def counts(name: str) -> tuple[Column, Column]:
    """Normal and unusual count of a cause. Normal: the count if the flag is off, else the baseline (for zero usage at most ``CAP``),
    cut to a whole number, 0 if there is none. Unusual: the count if the flag is on, else the 0/1 flag of frequent sessions."""
    flag, count, usual = CAUSES[name]
    base = F.when(F.col(usual) > CAP, F.lit(float(CAP))).otherwise(F.col(usual)) if name == "ZeroByteSession" else F.col(usual)
    normal = F.coalesce(F.when(F.col(flag) == 0, F.col(count).cast("double")), base, F.lit(0.0)).cast("long")
    unusual = F.coalesce(F.when(F.col(flag) == 1, F.col(count)).otherwise(F.col("AnomalySessionCount").cast("long")), F.lit(0).cast("long"))
    return normal, unusual


def labelled(df: DataFrame) -> DataFrame:
    """``df`` with ``AnomalyCause``, ``DurationInMin``, ``AnomalyEventTime`` and the counts of every cause."""
    out = {"AnomalyCause": cause(), "DurationInMin": F.lit(60), "AnomalyEventTime": event_time()}
    for name in CAUSES:
        out[f"NormalSessionCount_{name}"], out[f"AnomalySessionCount_{name}"] = counts(name)
    return df.withColumns(out)


def exploded(df: DataFrame, anomaly: Column) -> DataFrame:
    """The alerts: a row per cause of each row that ``anomaly`` accepts; the mean short length belongs to short sessions only."""
    rows = labelled(df).where(anomaly & (F.col("AnomalyCause") != "")).withColumn("AnomalyCause", F.explode(F.split("AnomalyCause", ", ")))
    pick = lambda what: F.coalesce(*[F.when(F.col("AnomalyCause") == n, F.col(f"{what}_{n}")) for n in CAUSES])
    return rows.select(
        F.col("device_id").alias("DeviceId"), F.col("app_id").alias("AppId"), "AnomalyCause", pick("NormalSessionCount").alias("NormalSessionCount"), pick("AnomalySessionCount").alias("AnomalySessionCount"),
        "DurationInMin", F.when(F.col("AnomalyCause") != "ZeroByteSession", F.col("AvgSessionLengthTime").cast("int")).alias("AvgSessionLengthTime"), "AnomalyEventTime",
    )


def read_causes(df: DataFrame, column: str = "AnomalyCause") -> DataFrame:
    """``df`` with a row per cause, however the causes are spelled and separated; unknown ones stay as they are."""
    rows = df.withColumn(column, F.explode(F.split(column, ","))).withColumn(column, F.trim(column))
    known = F.lit(None).cast("string")
    for name in CAUSES:
        known = F.when(F.lower(column) == name.lower(), F.lit(name)).otherwise(known)
    return rows.withColumn(column, F.coalesce(known, F.col(column)))
