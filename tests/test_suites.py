"""The declared checks: every rule with a row that breaks it; the run that stops on them."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.operators import quality, suites
from tidewater.plans import medallion
from tidewater.sources.fixtures import Generator


def frames(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "customers": f([("C1", "gold", False), ("C1", "silver", True)], "customer_id string, loyalty_tier string, is_deleted boolean"),
        "orders": f([("O1", "C1", "delivered", 10.0, 1.0, 2.0, 1.0, 12.0), ("O2", "C9", "cancelled", 10.0, 0.0, 0.0, 0.0, 11.0), ("O3", None, "delivered", 5.0, 0.0, 0.0, 0.0, None)], "order_id string, customer_id string, status string, gross_amount double, discount_amount double, shipping_amount double, tax_amount double, total_amount double"),
        "order_items": f([("O1", 1, "P1", 2, 5.0, 10.0), ("O1", 1, "P9", 2, 5.0, 11.0), ("O8", 1, "P1", 1, 1.0, 1.0)], "order_id string, line_number int, product_id string, quantity int, unit_price double, line_amount double"),
        "products": f([("P1", 2.0, 1.0, True)], "product_id string, unit_price double, unit_cost double, is_active boolean"),
        "payments": f([("A1", "O1", "captured", 12.0, None), ("A2", "O1", "failed", 12.005, ""), ("A3", "O2", "failed", 3.0, "declined"), ("A4", "O7", "failed", 3.0, None)], "payment_id string, order_id string, status string, amount double, failure_reason string"),
        "support_tickets": f([("T1", "C1", "O1", "resolved", None, "negative", "refund"), ("T2", "C1", None, "open", None, "neutral", "other")], "ticket_id string, customer_id string, order_id string, status string, resolved_ts timestamp, sentiment string, intent string"),
        "web_events": f([("E1", None, "purchase", "O1"), ("E2", "C1", "purchase", "O9"), ("E3", "C2", "page_view", None)], "event_id string, customer_id string, event_type string, order_id string"),
        "customer_change_log": f([("C000042", "loyalty_tier")], "customer_id string, field string"),
    }


def test_every_declared_check(spark):
    now = dt.datetime(2026, 8, 2)
    log = spark.createDataFrame([("r1", "a", "RUNNING", now - dt.timedelta(hours=30)), ("r1", "a", "SUCCESS", now - dt.timedelta(hours=29)), ("r2", "b", "RUNNING", now - dt.timedelta(hours=2)), ("r3", "c", "SUCCESS", now)], "run_id string, step string, status string, at timestamp")
    checks = suites.declared(frames(spark), log, F.lit(now))
    assert len(checks) == 38 == len({c.name for c in checks})
    got = {r["check"]: (r["scanned"], r["failed"]) for r in quality.run(spark, checks).collect()}
    want = {
        "orders.customer_id->customers": (2, 1), "order_items.order_id->orders": (3, 1), "payments.order_id->orders": (4, 1), "support_tickets.order_id->orders": (1, 0),
        "support_tickets.customer_id->customers": (2, 0), "web_events.customer_id->customers": (2, 1), "order_items.product_id->products": (3, 1),
        "order_total_reconciles": (3, 1), "line_amount_reconciles": (3, 1), "payment_matches_order_total": (4, 2), "failed_payment_has_reason": (3, 2), "resolved_ticket_has_timestamp": (1, 1),
        "order_has_line_items": (3, 2), "purchase_event_has_order": (2, 1), "scd2_demo_customer_still_changes": (1, 0),
        "customers:unique": (2, 1), "orders:unique": (3, 0), "order_items:unique": (3, 1), "products:unique": (1, 0), "support_tickets:unique": (2, 0), "payments:unique": (4, 0),
        "customers:distribution": (2, 2), "order_items:distribution": (1, 1), "web_events:distribution": (2, 2), "pipeline_step_freshness": (3, 2), "no_stuck_pipeline_runs": (3, 1),
    }
    assert {k: got[k] for k in want} == want
    assert all(got[f"{t}:not_empty"] == (1, 0) for t in frames(spark))


def test_a_blocking_check_stops_the_run(spark, tmp_path):
    g = Generator(spark)
    clock = (dt.datetime(2026, 8, 1) + dt.timedelta(minutes=i) for i in range(99)).__next__
    medallion.run(spark, str(tmp_path), {"orders": g.orders(200), "payments": g.payments(300)}, clock)
    with pytest.raises(quality.QualityError) as e:  # a third of the payments is for orders that are not there
        medallion.check(spark, str(tmp_path), clock)
    history = {r["check"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/meta/checks").collect()}
    assert history["payments.order_id->orders"] == "FAIL" and history["orders:unique"] == "PASS" and history["no_stuck_pipeline_runs"] == "PASS"
    assert [quality.exit_code_of(x) for x in (None, ValueError(), e.value, ConnectionRefusedError())] == [0, 1, 2, 3]
