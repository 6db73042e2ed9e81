from __future__ import annotations

import os
import shutil
import subprocess
import sys
import time
from pathlib import Path

import pytest

from lodestream import scratch


def test_written_tables_lie_below_the_shared_folder(spark):
    df = scratch.written(spark.range(5), "five")
    path = df.inputFiles()[0]
    assert scratch.root(spark).removeprefix("file://") in path
    assert df.count() == 5 and scratch.written(spark.range(0)).count() == 0


def test_a_folder_is_made_only_where_the_setting_is_empty(tmp_path):
    code = """
import sys; sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from lodestream import scratch
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
spark = (spark.config("spark.checkpoint.dir", sys.argv[2]) if sys.argv[2] else spark).getOrCreate()
print("ROOT", scratch.root(spark), scratch.written(spark.range(3)).count(), scratch.root(spark) == scratch.root(spark))
"""
    repo = str(Path(__file__).resolve().parents[1])
    for given in ("", f"file://{tmp_path}/shared"):
        out = subprocess.run([sys.executable, "-c", code, repo, given], capture_output=True, text=True, timeout=240, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}).stdout
        said = next(line for line in out.splitlines() if line.startswith("ROOT")).split()
        assert said[2:] == ["3", "True"] and (said[1].startswith(given) if given else "/lodestream-" in said[1])


def test_a_cluster_needs_the_setting():
    assert scratch.shared(None, "local[4]") is None and scratch.shared("hdfs://x/y/", "yarn") == "hdfs://x/y"
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch.shared(None, master)


def test_nothing_is_left_after_a_run(tmp_path):
    code = """
import sys; sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from lodestream import scratch
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
scratch._ROOTS = type("none", (set,), {"__iter__": lambda self: iter(())})()  # leave it to the driver's JVM
scratch.written(spark.range(3))
scratch.clear(spark)
print("ROOT", scratch.written(spark.range(3)).count())
"""
    shared = tmp_path / "shared"
    shared.mkdir()
    out = subprocess.run([sys.executable, "-c", code, str(Path(__file__).resolve().parents[1]), f"file://{shared}"], capture_output=True, text=True, timeout=240).stdout
    assert "ROOT 3" in out
    for _ in range(100):
        if not list(shared.glob("lodestream-*")):
            break
        time.sleep(0.1)
    assert not list(shared.glob("lodestream-*"))


def test_the_rest_works_without_the_subpackage(tmp_path):
    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "lodestream", tmp_path / "lodestream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print('QUERIES', len(e.queries()), any(q.startswith('p1_') for q in e.queries()), 'p2_found' in e.queries())"
    for left in (False, True):  # the folder gone, or an empty one left behind
        if left:
            (tmp_path / "lodestream/llm/__pycache__").mkdir(parents=True)
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert out.stdout.split()[0] == "QUERIES" and out.stdout.split()[2:] == ["False", "True"], out.stderr
