"""The declared checks of the data model: references, business rules, volumes, keys, freshness and distributions, as data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import quality as Q
from tidewater.spec import ENTITIES

# Fixed values: (child, column, parent, severity, failures allowed in per cent); the column has one name in both.
REFERENCES = [
    ("orders", "customer_id", "customers", Q.BLOCK, 0.0),
    ("order_items", "order_id", "orders", Q.BLOCK, 0.0),
    ("payments", "order_id", "orders", Q.BLOCK, 0.0),
    ("support_tickets", "order_id", "orders", Q.BLOCK, 0.0),
    ("support_tickets", "customer_id", "customers", Q.BLOCK, 0.0),
    ("web_events", "customer_id", "customers", Q.BLOCK, 0.0),
    # lines of quarantined products are valid, but leave any join with products
    ("order_items", "product_id", "products", Q.WARN, 3.0),
]
# Fixed values: (name, table, what holds, scope, table looked up by order and what its row must fulfil).
RULES = [
    ("order_total_reconciles", "orders", "abs(total_amount - (gross_amount - discount_amount + shipping_amount + tax_amount)) <= 0.01", None, None),
    ("line_amount_reconciles", "order_items", "abs(line_amount - unit_price * quantity) <= 0.01", None, None),
    ("payment_matches_order_total", "payments", "found", None, ("orders", "abs(amount - total_amount) <= 0.01")),
    ("failed_payment_has_reason", "payments", "failure_reason is not null and failure_reason <> ''", "status = 'failed'", None),
    ("resolved_ticket_has_timestamp", "support_tickets", "resolved_ts is not null", "status = 'resolved'", None),
    ("order_has_line_items", "orders", "found", None, ("order_items", "true")),
    ("purchase_event_has_order", "web_events", "found", "event_type = 'purchase' and order_id is not null", ("orders", "true")),
    ("scd2_demo_customer_still_changes", "customer_change_log", "true", "customer_id = 'C000042' and field = 'loyalty_tier'", None),
]
KEYS = {"customers": ["customer_id"], "orders": ["order_id"], "order_items": ["order_id", "line_number"], "products": ["product_id"], "support_tickets": ["ticket_id"], "payments": ["payment_id"]}


def share(condition: str) -> Column:
    return F.avg(F.expr(condition).cast("double"))


# Fixed values: (measure, aggregate, least, most) of each table's distribution.
SHAPES: dict[str, list[tuple[str, Callable[[], Column], float | None, float | None]]] = {
    "orders": [
        ("delivered_share", lambda: share("status = 'delivered'"), 0.60, 0.85),
        ("cancelled_share", lambda: share("status = 'cancelled'"), 0.02, 0.12),
        ("mean_order_total", lambda: F.avg("total_amount"), 90.0, 220.0),
        ("order_total_right_skewed", lambda: (F.avg("total_amount") > F.median("total_amount")).cast("int"), 1, None),
    ],
    "order_items": [("line_amount_reconciles", lambda: F.max(F.expr("abs(line_amount - unit_price * quantity)")), None, 0.01)],
    "products": [
        ("active_product_share", lambda: share("is_active"), 0.75, 0.99),
        ("mean_margin_pct", lambda: F.avg(F.expr("100.0 * (unit_price - unit_cost) / unit_price")), 30.0, 58.0),
    ],
    "payments": [
        ("captured_share", lambda: share("status = 'captured'"), 0.70, 0.92),
        ("failed_share", lambda: share("status = 'failed'"), 0.05, 0.22),
    ],
    "support_tickets": [
        ("negative_share", lambda: share("sentiment = 'negative'"), 0.40, 0.72),
        ("all_seven_intents_present", lambda: F.count_distinct("intent"), 7, 7),
    ],
    "web_events": [
        ("purchase_share", lambda: share("event_type = 'purchase'"), 0.05, 0.16),
        ("funnel_is_a_funnel", lambda: F.count_if(F.expr("event_type = 'page_view'")) - F.count_if(F.expr("event_type = 'purchase'")), 0, None),
    ],
    "customers": [
        ("all_four_tiers_present", lambda: F.count_distinct("loyalty_tier"), 4, 4),
        ("deleted_share", lambda: share("is_deleted"), None, 0.05),
    ],
}


def ruled(tables: dict[str, DataFrame], table: str, holds: str, scope: str | None, lookup: tuple[str, str] | None) -> DataFrame:
    """One row (scanned, failed) of a rule; a rule with a look-up holds where a row of the other table with the same order fulfils it."""
    df = tables[table] if scope is None else tables[table].where(scope)
    if lookup is None:
        return Q.invariant(df, F.expr(holds))
    other, fulfils = lookup
    own = [c for c in tables[other].columns if c not in df.columns]
    kept = df.join(tables[other].select(F.col("order_id").alias("_order"), *own), F.expr(f"order_id = _order and ({fulfils})"), "left_semi")
    held = kept.agg(F.count("*").alias("held"))
    # two frames of one row
    return df.agg(F.count("*").alias("scanned")).crossJoin(F.broadcast(held)).select("scanned", (F.col("scanned") - F.col("held")).alias("failed"))


def shaped(df: DataFrame, table: str) -> DataFrame:
    """One row (scanned, failed): the measures of a table and those outside their bounds, all in one pass."""
    got = Q.distribution(df, [(name, make(), low, high) for name, make, low, high in SHAPES[table]])
    return got.agg(F.count("*").alias("scanned"), F.count_if(~F.col("ok")).alias("failed"))


def stuck(log: DataFrame, now: Column, hours: float = 1.0) -> DataFrame:
    """Runs that began over ``hours`` ago and have neither succeeded nor failed."""
    runs = log.groupBy("run_id").agg(F.min("at").alias("began"), F.max(F.col("status") != "RUNNING").alias("ended"))
    late = ~F.col("ended") & ((F.unix_micros(now) - F.unix_micros("began")) / F.lit(3.6e9) > hours)
    return runs.agg(F.count("*").alias("scanned"), F.count_if(late).alias("failed"))


def declared(tables: dict[str, DataFrame], log: DataFrame | None = None, now: Column | None = None) -> list[Q.Check]:
    """The checks whose tables are there; with a run log (``run_id, step, status, at``) those of the pipeline itself too."""
    there = tables.keys()
    out = [Q.Check(f"{child}.{col}->{parent}", lambda c=child, k=col, p=parent: Q.referential(tables[c], k, tables[p], k), severity, pct) for child, col, parent, severity, pct in REFERENCES if {child, parent} <= there]
    out += [Q.Check(name, lambda a=(table, holds, scope, lookup): ruled(tables, *a)) for name, table, holds, scope, lookup in RULES if table in there and (not lookup or lookup[0] in there)]
    out += [Q.Check(f"{t}:not_empty", lambda t=t: Q.not_empty(tables[t])) for t in ENTITIES if t in there]
    out += [Q.Check(f"{t}:unique", lambda t=t, k=k: Q.unique_key(tables[t], k)) for t, k in KEYS.items() if t in there]
    out += [Q.Check(f"{t}:distribution", lambda t=t: shaped(tables[t], t)) for t in SHAPES if t in there]
    if log is not None:
        moment = F.current_timestamp() if now is None else now
        out.append(Q.Check("pipeline_step_freshness", lambda: Q.freshness(log, "step", "status", "at", moment, 24), Q.WARN))
        out.append(Q.Check("no_stuck_pipeline_runs", lambda: stuck(log, moment), Q.WARN))
    return out
