"""One run from captures to marts, checks and the index; restart after a failure."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidewater.operators import quality as Q
from tidewater.operators import suites
from tidewater.plans import gold
from tidewater.sources.fixtures import Generator

ENTITIES = ("customers", "products", "orders", "order_items", "payments")


@pytest.fixture(scope="module")
def captures(spark):
    g = Generator(spark, customers=60, products=20)
    items = g.order_items(400)
    items = items.join(g.orders(400).select("order_id", "order_ts"), "order_id").select(*items.columns, "order_ts")  # lines take the time of their order
    tickets = spark.createDataFrame([(f"T{i:06d}", f"C{i:06d}", None, dt.datetime(2026, 7, 1), None, "open", "email", "P1", "late delivery", f"my parcel number {i} is late", "late", "neutral") for i in range(1, 9)], "ticket_id string, customer_id string, order_id string, created_ts timestamp, resolved_ts timestamp, status string, channel string, priority string, subject string, body string, intent string, sentiment string")
    return {"customers": g.customers(), "products": g.products(), "orders": g.orders(400), "order_items": items, "payments": g.payments(400)} | {"support_tickets": tickets}


def without_shapes(*a):
    """The declared checks but for those of distributions, which generated rows don't have."""
    return [c for c in suites.declared(*a) if not c.name.endswith(":distribution")]


def clock():
    return (dt.datetime(2026, 8, 1) + dt.timedelta(seconds=i) for i in range(9999)).__next__


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs}


def test_whole_run_and_restart(spark, tmp_path, captures, monkeypatch):
    root, now = str(tmp_path), clock()
    needs, build = gold.GOLD["mart_customer_rfm"]

    def fail(lake):
        raise RuntimeError("no memory")

    monkeypatch.setitem(gold.GOLD, "mart_customer_rfm", (needs, fail))
    with pytest.raises(RuntimeError, match="no memory"):
        gold.execute(spark, root, gold.batch(spark, root, captures, now, declared=without_shapes), "b1", now)
    assert not os.path.exists(f"{root}/gold/mart_customer_rfm")
    first = gold.succeeded(spark, f"{root}/meta/runs", "b1")
    assert {f"silver:{e}" for e in ENTITIES} | {"dq:silver"} <= first and "dq:gold" not in first
    before = files(f"{root}/silver") | files(f"{root}/bronze") | {k: v for k, v in files(f"{root}/gold").items() if k.split("/gold/")[1].split("/")[0] in {s[5:] for s in first if s.startswith("gold:")}}
    monkeypatch.setitem(gold.GOLD, "mart_customer_rfm", (needs, build))
    steps = gold.batch(spark, root, captures, now, declared=without_shapes)
    ran = gold.execute(spark, root, steps, "b1", now)
    assert "gold:mart_customer_rfm" in ran and "dq:gold" in ran and not set(ran) & first
    after = files(root)
    assert all(after[f] == t for f, t in before.items())  # what had succeeded was left alone
    assert gold.succeeded(spark, f"{root}/meta/runs", "b1") == {s.name for s in steps}
    assert gold.execute(spark, root, steps, "b1", now) == []

    lake = {g: spark.read.parquet(f"{root}/gold/{g}") for g in gold.GOLD}
    orders = captures["orders"].where(~F.col("status").isin("cancelled", "returned"))
    assert lake["fact_orders"].count() == 400
    assert lake["mart_daily_sales"].agg(F.sum("revenue")).first()[0] == pytest.approx(float(orders.agg(F.sum("total_amount")).first()[0]))
    assert lake["mart_customer_rfm"].count() == orders.select("customer_id").distinct().join(captures["customers"], "customer_id").count()
    assert lake["fact_order_items"].where("product_key IS NULL").isEmpty() and lake["dim_product"].count() == 20
    from tidewater.operators.textindex import TextIndex

    index = TextIndex(spark, f"{root}/index")
    found = index.bm25(index.asked(spark.createDataFrame([(1, "which parcels are late")], "q int, t string"), "q", "t"), 3)
    assert found.count() == 3 and index.stats()[0] == 8


def test_steps_run_in_order_of_need(spark, tmp_path):
    seen = []
    steps = [gold.Step(n, needs, lambda n=n: seen.append(n) or 1) for n, needs in (("c", ("b",)), ("b", ("a",)), ("a", ()), ("d", ("a", "elsewhere")))]
    assert gold.execute(spark, str(tmp_path), steps, "x", clock()) == seen and seen.index("a") < seen.index("b") < seen.index("c") and len(seen) == 4
    assert sorted(gold.execute(spark, str(tmp_path), steps, "y", clock())) == ["a", "b", "c", "d"]  # another batch


def test_failed_checks_keep_rows_and_stop(spark, tmp_path):
    facts = spark.createDataFrame([(i, "k1" if i < 30 else "gone", 1.0) for i in range(60)] + [(1, "k1", 1.0)], "order_id long, customer_key string, recognised_amount double")
    dim = spark.createDataFrame([("k1", 1, True), ("k2", 2, False)], "customer_key string, customer_id long, is_current boolean")
    with pytest.raises(Q.QualityError):
        gold.checked(spark, str(tmp_path), gold.gold_checks({"fact_orders": facts, "dim_customer": dim}))
    results = {r["check"]: (r["scanned"], r["failed"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/meta/checks").collect()}
    assert results["fact_orders:unique"] == (61, 1, "FAIL") and results["fact_orders.customer_key->dim_customer"] == (61, 30, "FAIL") and results["dim_customer:one_current"] == (2, 1, "FAIL") and results["dim_customer:unique"][2] == "PASS"
    rows = [(r["check"], json.loads(r["row"])) for r in spark.read.parquet(f"{tmp_path}/meta/check_rows").collect()]
    assert sum(c == "fact_orders.customer_key->dim_customer" for c, _ in rows) == Q.SAMPLE
    assert [r for c, r in rows if c == "dim_customer:one_current"] == [{"customer_id": 2, "n": 0}]
