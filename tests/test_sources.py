from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodestream.functions import select
from lodestream.sources import readers, sinks


def test_filters_and_columns_reach_the_scan(spark, folder):
    df = readers.parquet(spark, f"{folder}/lineitem.parquet", "l_quantity > 45").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_text_csv_and_missing_paths(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n  \ntwo\n")
    assert [r.value for r in readers.lines(spark, str(tmp_path / "a.txt")).collect()] == ["one", "two"]
    assert readers.whole_text(spark, str(tmp_path / "a.txt")).first().value == "one\n\n  \ntwo\n"
    (tmp_path / "a.csv").write_text("x,y\n1,b\n")
    assert readers.csv(spark, str(tmp_path / "a.csv"), "x int, y string").collect() == [(1, "b")]
    with pytest.raises(AnalysisException):
        readers.parquet(spark, str(tmp_path / "none*"))
    assert readers.exists(spark, str(tmp_path)) and not readers.exists(spark, str(tmp_path / "none"))
    assert readers.or_empty(spark, lambda: readers.parquet(spark, str(tmp_path / "none")), "x int").collect() == []


def test_bad_records_decode_to_nulls(spark):
    df = spark.createDataFrame([("eyJhIjoxfQ==",), ("not base64!",), ("bm90IGpzb24=",), (None,)], "data string")
    assert [r.a for r in readers.decoded(df, "data", "a int").collect()] == [1, None, None, None]


def test_a_repeated_write_replaces_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "v int, p string")
    sinks.partitioned(df, path, ["p"], ["v"])
    sinks.partitioned(df.where("p = 'b'").withColumn("v", F.lit(9)), path, ["p"])
    sinks.partitioned(df.limit(0), path, ["p"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "a"), (9, "b")]


def test_put_sends_each_record_again_until_it_is_taken(spark, tmp_path):
    out = str(tmp_path)

    def send(records):
        import uuid

        if uuid.uuid4().int % 5 == 0:
            raise sinks.Throttled
        refused = [i for i in range(len(records)) if uuid.uuid4().int % 4 == 0]
        with open(f"{out}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(j + "\n" for i, (k, j) in enumerate(records) if i not in refused and len(k) == 32)
        return refused

    df = spark.range(200).select(F.col("id"), (F.col("id") % 3).alias("app"))
    sinks.put(df, "app", "id", send, streams=4, batch=25, attempts=12, wait=0.001)
    got = [json.loads(line)["id"] for p in tmp_path.iterdir() for line in p.read_text().splitlines()]
    assert sorted(got) == list(range(200))


def test_put_fails_loudly(spark):
    with pytest.raises(Exception, match="refused"):
        sinks.put(spark.range(3).withColumn("a", F.lit(1)), "a", "id", lambda r: list(range(len(r))), 1, 25, 2, 0.001)


def test_batches_keep_order_size_and_leave_nulls_out(spark):
    df = spark.createDataFrame([(i, None if i % 2 else i) for i in range(25)], "k int, v int")
    rows = sinks.batches(df, [F.col("k").desc()], 10).orderBy("batch").collect()
    assert [r.records for r in rows] == [10, 10, 5]
    first = json.loads(rows[0].document)["events"]
    assert [e["k"] for e in first] == list(range(24, 14, -1)) and "v" not in first[1]
    assert sinks.batches(df.limit(0), [F.col("k")], 10).count() == 0


def test_run_log(spark, tmp_path):
    for run in ("r1", "r2"):
        sinks.log_run(spark.createDataFrame([(0.5, 3)], "f1 double, n int"), str(tmp_path / "runs"), run, {"depth": "2"})
    rows = spark.read.parquet(str(tmp_path / "runs")).collect()
    assert sorted((r.run, r.metric, r.value, r.params["depth"]) for r in rows) == [("r1", "f1", 0.5, "2"), ("r1", "n", 3.0, "2"), ("r2", "f1", 0.5, "2"), ("r2", "n", 3.0, "2")]


SPEC = {"features": {"feature_groups": {"z": ["a", "b"], "flags": ["c", "a"]}, "feature_all": ["a", "b", "c", "d"]}}


@pytest.mark.parametrize(("wanted", "without", "want"), [("all", (), ["a", "b", "c", "d"]), ("z", (), ["a", "b"]), ("flags, z,extra", (), ["c", "a", "b", "extra"]), ('["z", "d"]', ("b",), ["a", "d"]), (["d"], (), ["d"])])
def test_feature_lists(wanted, without, want):
    assert select.features(SPEC, wanted, without) == want


def test_feature_errors(tmp_path):
    with pytest.raises(ValueError):
        select.features(SPEC, "z", ["a", "b"])
    assert select.audit(["session_count", "x"], ["sesion_count", "x"]) == {"sesion_count": ["session_count"]}
    with pytest.raises(ValueError):
        select.checked({"depth": 1, "oops": 2}, ["depth"])
    (tmp_path / "c.yaml").write_text("")
    assert select.settings(str(tmp_path / "c.yaml")) == {}
