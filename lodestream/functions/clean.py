"""Expressions that read dirty values in one way everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day(column: str = "date") -> Column:
    """Date of ``2025-01-06``, ``2025/01/06`` and ``2025-01-06 00:00:00``; null where it is none of them."""
    return F.expr(f"try_cast(translate(substring(trim(`{column}`), 1, 10), '/', '-') AS DATE)")


def hour(column: str = "hour") -> Column:
    """Hour of ``7`` and ``07``; null where it is no number."""
    return F.expr(f"try_cast(`{column}` AS INT)")


def finite(x: Column) -> Column:
    """``x`` as double, null where it is null, NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(column: str) -> Column:
    """Column read as a number: unparsable, null, NaN and infinite become 0."""
    x = F.expr(f"try_cast(`{column}` AS DOUBLE)")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per non-null ``key`` (repeats are equal by contract, so any will do); rows without a key all stay."""
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    return df.withColumn("__lode_alone", alone).dropDuplicates([key, "__lode_alone"]).drop("__lode_alone")
