"""Readers with parameters; results are kept until the watermark moves."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidewater.plans import metrics
from tidewater.sources import writers

DAY = dt.date(2026, 1, 1)


def later(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture
def root(spark, tmp_path):
    sales = [(later(i), c, i * (2 if c == "email" else 1), float(i)) for i in range(10) for c in ("email", "social")]
    spark.createDataFrame(sales, "date date, channel string, orders long, revenue double").write.parquet(f"{tmp_path}/gold/mart_daily_sales")
    spark.createDataFrame([(DAY, m, 5 - m) for m in range(5)], "cohort date, months_since int, active long").write.parquet(f"{tmp_path}/gold/mart_cohort_retention")
    done(spark, tmp_path, 1)
    return str(tmp_path)


def done(spark, root, hour, status="SUCCESS"):
    writers.append_log(spark, [(f"b:{hour}", "gold", status, dt.datetime(2026, 1, 1, hour), 1, None)], writers.RUN_LOG, f"{root}/meta/runs")


def test_parameters(spark, root):
    m = metrics.Metrics.of(spark, root)
    assert m.date_bounds() == (DAY, later(9))
    assert [r[0] for r in m.channels().collect()] == ["email", "social"]
    got = m.daily_sales(later(2), later(4), "email").collect()
    assert [(r["date"], r["channel"], r["orders"]) for r in got] == [(later(i), "email", 2 * i) for i in (2, 3, 4)]
    assert m.daily_sales(later(2), later(4)).count() == 6 and m.daily_sales(later(20), later(30)).count() == 0
    assert [r["months_since"] for r in m.cohort_retention(2).collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        m.daily_sales(later(4), later(2))
    with pytest.raises(ValueError):
        m.cohort_retention(-1)


def test_a_second_call_reads_what_the_first_wrote(spark, root):
    m = metrics.Metrics.of(spark, root)
    built = []
    table = m.table
    m.table = lambda name: built.append(name) or table(name)
    first = m.daily_sales(later(0), later(3)).collect()
    again = m.daily_sales(later(0), later(3))
    assert again.collect() == first and built == ["mart_daily_sales"]
    assert all("/cache/watermark=" in f for f in again.inputFiles())
    m.daily_sales(later(0), later(3), "email")
    assert len(built) == 2  # other parameters are another result
    done(spark, root, 2, "FAILED")
    m.daily_sales(later(0), later(3))
    assert len(built) == 2  # a failed run completes nothing
    done(spark, root, 3)
    spark.createDataFrame([(later(1), "direct", 7, 7.0)], "date date, channel string, orders long, revenue double").write.mode("append").parquet(f"{root}/gold/mart_daily_sales")
    assert m.daily_sales(later(0), later(3)).count() == len(first) + 1 and len(built) == 3
    assert len(os.listdir(f"{root}/cache")) == 1  # results of the old watermark are gone


def test_logs_and_streams(spark):
    at = lambda h: dt.datetime(2026, 1, 3, h)
    history = spark.createDataFrame([("sql", "a", "FAIL", at(1)), ("sql", "a", "PASS", at(2)), ("dbt", "a", "FAIL", at(1)), ("sql", "b", "PASS", at(3))], "source string, check string, status string, at timestamp")
    got = metrics.data_quality_summary(history).collect()
    assert [(r["source"], r["check"], r["status"]) for r in got] == [("dbt", "a", "FAIL"), ("sql", "a", "PASS"), ("sql", "b", "PASS")]
    assert metrics.data_quality_summary(history, limit=1).count() == 1
    windows = spark.createDataFrame([(dt.datetime(2026, 1, d), 1) for d in range(1, 6)], "window_start timestamp, value int")
    assert [r["window_start"].day for r in metrics.stream_metrics(windows, F.lit(dt.datetime(2026, 1, 4)), 48).collect()] == [3, 4]
    series = spark.createDataFrame([("g", "t", 0, e, 10 * e, 30, 30 - 10 * e, at(e)) for e in range(3)], "consumer_group string, topic string, partition int, epoch long, current_offset long, log_end_offset long, lag long, observed_at timestamp")
    assert [(r["current_offset"], r["lag"]) for r in metrics.consumer_lag(series).collect()] == [(20, 10)]
