"""The batch run over generated data with planted defects."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater import spec
from tidewater.plans import medallion
from tidewater.sources.fixtures import Generator, corrupted, with_defects


def test_generated_tables_agree(spark):
    g = Generator(spark)
    orders, items = g.orders(200), g.order_items(200)
    assert orders.count() == 200 == items.select("order_id").distinct().count()
    off = items.groupBy("order_id").agg(F.sum("line_amount").alias("s")).join(orders, "order_id").where("s <> gross_amount")
    assert off.count() == 0
    assert sorted(map(str, orders.collect())) == sorted(map(str, Generator(spark).orders(200).collect()))
    assert orders.join(g.customers(), "customer_id", "left_anti").count() == 0 == items.join(g.products(), "product_id", "left_anti").count()


def test_batch_run(spark, tmp_path):
    g = Generator(spark)
    payments = with_defects(g.payments(3000), spec.ENTITIES["payments"])
    planted = payments.where("_defect is not null").dropDuplicates(["payment_id"]).count()
    assert planted > 20 and {r[0].split(":")[0] for r in payments.select("_defect").distinct().collect() if r[0]} == {"missing", "bad_enum", "negative", "bad_date"}
    clock = (dt.datetime(2026, 8, 1) + dt.timedelta(minutes=i) for i in range(99)).__next__
    out = medallion.run(spark, str(tmp_path), {"payments": payments.drop("_defect"), "orders": g.orders(3000)}, clock)
    assert out["orders"] == 3000 and out["payments"] == 3000 - planted
    rejected = spark.read.parquet(f"{tmp_path}/quarantine/payments")
    assert {r[0].split(":")[0] for r in rejected.select("_quarantine_reason").distinct().collect()} <= {"missing", "bad_enum", "bad_type", "out_of_range"}
    checks = {r["check"]: r for r in medallion.reconciled(spark, str(tmp_path), f"{tmp_path}/meta/checks").collect()}
    assert checks["payments:duplicates"]["failed"] > 0 and checks["payments:quarantine_rate"]["status"] == "PASS"
    assert spark.read.parquet(f"{tmp_path}/meta/runs").where("status = 'SUCCESS'").count() == 4


def test_too_many_rejects_stop_the_build(spark, tmp_path):
    bad = with_defects(Generator(spark).payments(300), spec.ENTITIES["payments"], permille=400).drop("_defect")
    with pytest.raises(medallion.QualityError):
        medallion.run(spark, str(tmp_path), {"payments": bad}, lambda: dt.datetime(2026, 8, 1))
    assert spark.read.parquet(f"{tmp_path}/meta/runs").where("status = 'FAILED'").count() == 1


def test_drift_and_evaluation_rows(spark):
    e = spark.createDataFrame([("a", 3), ("b", 1), ("c", 1)], "topic string, partitions int")
    a = spark.createDataFrame([("a", 3), ("b", 2), ("x", 1)], "topic string, partitions int")
    assert {r["topic"]: r["state"] for r in medallion.topic_drift(e, a).collect()} == {"a": "ok", "b": "different", "c": "missing", "x": "unexpected"}
    ranked = spark.createDataFrame([(1, 7, 0.5, 2), (1, 9, 0.9, 1)], "query_id long, id long, score double, rank long")
    assert medallion.evaluation_rows(ranked, "r").first()["payload"] == '[{"rank":1,"id":9,"score":0.9},{"rank":2,"id":7,"score":0.5}]'
    assert len({corrupted(b"0123456789abcdef", i) for i in range(3)}) == 3
