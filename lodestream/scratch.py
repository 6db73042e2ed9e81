"""Tables written between stages of one operator.

A written table cuts the lineage: an executor lost later costs only the tasks that read it, and a range
partitioning that was sampled once is never sampled again with other bounds. The tables live below
``spark.checkpoint.dir``, which all executors share. Only a local master without that setting gets a local folder;
on a cluster the setting is required, because each executor would write to a disk of its own and rows would be lost.
All tables of an application are deleted when its driver ends, on any file system.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: set[str] = set()
_OWN: dict[str, str] = {}  # by application, where the setting is empty


def shared(setting: str | None, master: str) -> str | None:
    """The folder that ``spark.checkpoint.dir`` names, or None where a local folder will do; raises where neither holds."""
    if setting:
        return setting.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share; a local one would lose rows")
    return None


def root(spark: SparkSession) -> str:
    """The shared folder of this application, without a trailing slash."""
    app = spark.sparkContext.applicationId
    base = shared(spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master) or _OWN.get(app)
    if not base:
        base = _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lodestream-")
        spark.sparkContext.setCheckpointDir(base)
        _ROOTS.add(base)
    own = f"{base}/lodestream-{app}"
    if own not in _ROOTS:
        _ROOTS.add(own)
        path, files = _place(spark, own)
        files.mkdirs(path)
        files.deleteOnExit(path)  # by the driver's JVM, whatever the file system
    return own


def _place(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written once to the shared folder and read back (eager). Row order inside files is kept, the
    partitioning is not: whatever depends on it has to be a column by now."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete every table this application has written so far. Results that still read them break."""
    path, files = _place(spark, root(spark))
    files.delete(path, True)
    files.mkdirs(path)


@atexit.register
def _clear_local() -> None:
    for path in _ROOTS:
        if path.startswith(("file:", "/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
