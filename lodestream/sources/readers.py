"""Readers: what comes in, with its schema declared at the boundary."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, path: str, where: str | None = None, base: str | None = None) -> DataFrame:
    """Parquet at a path or glob; ``where`` is a SQL condition that the scan prunes and filters by; a path without files is an error."""
    reader = spark.read.option("basePath", base) if base else spark.read
    df = reader.parquet(path)
    return df.where(F.expr(where)) if where else df


def catalog(spark: SparkSession, name: str, where: str | None = None) -> DataFrame:
    """A table of the catalog."""
    df = spark.table(name)
    return df.where(F.expr(where)) if where else df


def csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header line; the schema is given, so the file is read once."""
    return spark.read.csv(path, header=True, schema=schema)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files that aren't blank: ``value``."""
    return spark.read.text(path).where(F.trim("value") != "")


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: ``value``."""
    return spark.read.text(path, wholetext=True)


def decoded(df: DataFrame, data: str, schema: T.StructType | str) -> DataFrame:
    """Rows of base64-coded JSON records; what can't be read gives a row of nulls."""
    record = F.from_json(F.expr(f"try_to_binary(`{data}`, 'base64')").cast("string"), schema)
    return df.select(record.alias("_r")).select("_r.*")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file system the session knows has ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema: T.StructType | str) -> DataFrame:
    """What ``read`` returns, or no rows of ``schema`` if its path isn't there yet."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "TABLE_OR_VIEW_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def latest_before(df: DataFrame, day: Column, hour: Column, moment: Column) -> DataFrame:
    """The rows of the last (day, hour) partition strictly before ``moment``. One aggregate row is broadcast, nothing is listed on the driver."""
    at = F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), hour, F.lit(0), F.lit(0))
    rows = df.withColumn("_at", at)
    last = rows.where(F.col("_at") < moment).agg(F.max("_at").alias("_last"))
    return rows.join(F.broadcast(last), F.col("_at") == F.col("_last")).drop("_at", "_last")  # one row


def only(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Rows whose ``column`` is one of ``values``, all rows where None. The list becomes a scan filter; nulls never match."""
    return df if values is None else df.where(F.col(column).isin(list(values)))
