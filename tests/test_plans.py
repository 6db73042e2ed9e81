"""The plans are the ones that are meant: no cross joins over rows, scans that read what is needed, windows over small groups."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from lodestream.operators import hourly as H


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["hourly_aggregates", "expanding_stats", "frequent_flag", "zero_usage_rolling", "severity_blend", "daily_severe_devices", "cause_counts", "word_vocab", "information_gain"])
def test_no_cartesian_products_and_no_python(spark, folder, name):
    plan = executed(entry.queries()[name](spark, folder))
    assert "CartesianProduct" not in plan and not re.search("Python|Pandas|Arrow", plan)


def test_one_aggregate_makes_all_hourly_measures(spark, folder):
    events = spark.read.parquet(f"{folder}/session_events.parquet")
    plan = executed(H.hourly(events))
    assert plan.count("Exchange hashpartitioning") == 1  # events to their hours
    read = re.search("ReadSchema: struct<(.*)", plan)[1]
    assert "session_type" not in read and "minute" not in read


def test_the_arrival_filter_reaches_the_scan(spark, folder):
    events = spark.read.parquet(f"{folder}/session_events.parquet")
    assert re.search("PushedFilters: .*event_date", executed(H.arrived(events, "2025-02-05 12:30:00")))
