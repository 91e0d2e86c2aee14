"""Catalogue: history, dimensions, facts, the seven marts, data quality.

The marts keep the reference's mixed scope on purpose: margins take the margin
of all lines and the revenue of recognised ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import scalar as S
from tidewater.operators import quality as Q
from tidewater.operators import scd2
from tidewater.operators.materialise import once, scratch
from tidewater.operators.snapshots import Snapshots
from tidewater.plans.base import Lake, query


def dim_customer_frame(k: Lake) -> DataFrame:
    """The customer dimension, written once for all facts and marts that read it."""

    def build() -> DataFrame:
        opened = scd2.history(k.customers, k.change_log, F.to_timestamp(F.lit(k.end)))
        d = scd2.close_versions(opened, "customer_id", "opened_at")
        return d.select(S.surrogate_key(F.col("customer_id"), F.col("version")).alias("customer_key"), "customer_id", "loyalty_tier", "segment", "version", "valid_from", "valid_to", "is_current", "is_tombstone")

    return once(k.spark, f"dim_customer-{k.end[:10]}", k.customer_inputs, build)


def lines_with_products(k: Lake) -> DataFrame:
    """Order lines with product and margin; lines without a known product stay."""
    p = k.products.select("product_id", "product_name", "category", "unit_cost", F.lit(True).alias("known"))
    got = k.lines.join(p, "product_id", "left")
    return got.withColumn("margin", F.when(F.col("known"), F.col("line_amount") - F.col("quantity") * F.col("unit_cost")))


LINE_ROLLUP = "SELECT order_id, count(*) AS n_lines, count(DISTINCT product_id) AS n_products, sum(quantity)::DOUBLE AS units, sum(line_amount)::DOUBLE AS lines_amount FROM l GROUP BY 1"
PAY_ROLLUP = "SELECT order_id, count(*) AS attempts, count(*) FILTER (is_failed) AS failures, coalesce(sum(amount) FILTER (is_captured), 0)::DOUBLE AS captured, arg_max(failure_reason, (processed_ts, attempt_number, seq)) FILTER (is_failed) AS last_failure FROM pay GROUP BY 1"


@query("l", LINE_ROLLUP)
def int_order_line_rollup(k: Lake) -> DataFrame:
    return k.lines.groupBy("order_id").agg(F.count("*").alias("n_lines"), F.count_distinct("product_id").alias("n_products"), F.sum("quantity").cast("double").alias("units"), F.sum("line_amount").cast("double").alias("lines_amount"))


@query("l p", "SELECT order_id, line_number, l.product_id, category, (line_amount - quantity * unit_cost)::DOUBLE AS margin FROM l LEFT JOIN p USING (product_id)")
def int_order_lines(k: Lake) -> DataFrame:
    return lines_with_products(k).select("order_id", "line_number", "product_id", "category", F.col("margin").cast("double").alias("margin"))


@query("pay", PAY_ROLLUP)
def int_order_payments(k: Lake) -> DataFrame:
    f, at = F.col("is_failed"), F.struct("processed_ts", "attempt_number", "seq")
    return k.payments.groupBy("order_id").agg(F.count("*").alias("attempts"), F.count_if(f).alias("failures"), F.coalesce(F.sum(F.when(F.col("is_captured"), F.col("amount"))), F.lit(0)).cast("double").alias("captured"), F.max_by(F.when(f, F.col("failure_reason")), F.when(f, at)).alias("last_failure"))


def sessions(k: Lake) -> DataFrame:
    """Events with a session: a user's events at most thirty minutes apart."""
    w = Window.partitionBy("user_id").orderBy("event_ts", "event_id")
    fresh = F.when(F.col("event_ts") - F.lag("event_ts").over(w) <= F.expr("interval 30 minutes"), 0).otherwise(1)
    return k.events.withColumn("fresh", fresh).withColumn("session_id", F.concat_ws("-", "user_id", F.sum("fresh").over(w).cast("string"))).drop("fresh")


FUNNEL_SQL = "SELECT session_id, any_value(user_id) AS user_id, min(event_ts) AS started, arg_min(event_type, (event_ts, event_id)) AS entry_type, count(*) AS n_events, bool_or(event_type = 'view') AS viewed, bool_or(event_type = 'click') AS clicked, bool_or(event_type = 'purchase') AS bought, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END)::BIGINT AS furthest FROM ses GROUP BY session_id"


@query("ses", FUNNEL_SQL)
def int_session_funnel(k: Lake) -> DataFrame:
    t = F.col("event_type")
    step = F.when(t == "view", 1).when(t == "click", 2).when(t == "signup", 3).when(t == "purchase", 4).otherwise(0)
    return sessions(k).groupBy("session_id").agg(F.first("user_id").alias("user_id"), F.min("event_ts").alias("started"), F.min_by("event_type", F.struct("event_ts", "event_id")).alias("entry_type"), F.count("*").alias("n_events"), F.bool_or(t == "view").alias("viewed"), F.bool_or(t == "click").alias("clicked"), F.bool_or(t == "purchase").alias("bought"), F.max(step).cast("bigint").alias("furthest"))


# -- history ----------------------------------------------------------------------


@query("ver", "SELECT customer_id, loyalty_tier, segment, opened_at, is_tombstone FROM ver")
def scd2_versions(k: Lake) -> DataFrame:
    return scd2.history(k.customers, k.change_log, F.to_timestamp(F.lit(k.end)))


@query("c log", "SELECT c.customer_id, coalesce((SELECT arg_max(new_value, (changed_at, seq)) FROM log g WHERE g.customer_id = c.customer_id AND field = 'loyalty_tier' AND changed_at <= TIMESTAMP '1998-06-30'), (SELECT arg_min(old_value, (changed_at, seq)) FROM log g WHERE g.customer_id = c.customer_id AND field = 'loyalty_tier' AND changed_at > TIMESTAMP '1998-06-30'), loyalty_tier) AS loyalty_tier, segment FROM c WHERE signup_date <= DATE '1998-06-30'")
def scd2_point_in_time(k: Lake) -> DataFrame:
    got = scd2.point_in_time(k.customers, k.change_log, F.to_timestamp(F.lit("1998-06-30 00:00:00")), "customer_id", ["loyalty_tier"], "signup_date")
    return got.select("customer_id", "loyalty_tier", "segment")


@query("dim", "SELECT count(*) AS n FROM dim a JOIN dim b ON a.customer_id = b.customer_id AND a.version < b.version AND a.valid_from < b.valid_to AND b.valid_from < a.valid_to")
def scd2_overlap_check(k: Lake) -> DataFrame:
    return scd2.overlaps(dim_customer_frame(k), "customer_id").agg(F.count("*").alias("n"))


@query("dim", "SELECT count(*) AS customers, count(*) FILTER (n <> 1) AS bad FROM (SELECT customer_id, count(*) FILTER (is_current) AS n FROM dim GROUP BY 1)")
def scd2_one_current(k: Lake) -> DataFrame:
    n = dim_customer_frame(k).groupBy("customer_id").agg(F.count_if("is_current").alias("n"))
    return n.agg(F.count("*").alias("customers"), F.count_if(F.col("n") != 1).alias("bad"))


@query("dim", "SELECT customer_id, version, valid_from, is_current FROM dim WHERE is_tombstone")
def scd2_tombstone(k: Lake) -> DataFrame:
    return dim_customer_frame(k).where("is_tombstone").select("customer_id", "version", "valid_from", "is_current")


_AT = ("1995-06-30", "1997-06-30", "1998-06-30", "2002-01-01")


@query(
    "c log",
    f"""WITH i AS (SELECT unnest([{", ".join(f"TIMESTAMP '{t}'" for t in _AT)}]) AS moment),
    s AS (SELECT c.customer_id, i.moment, c.segment, coalesce(
        (SELECT arg_max(new_value, (changed_at, seq)) FROM log g WHERE g.customer_id = c.customer_id AND field = 'loyalty_tier' AND changed_at <= i.moment),
        (SELECT arg_min(old_value, (changed_at, seq)) FROM log g WHERE g.customer_id = c.customer_id AND field = 'loyalty_tier' AND changed_at > i.moment), loyalty_tier) AS tier,
        coalesce((SELECT bool_or(changed_at <= i.moment) FROM log g WHERE g.customer_id = c.customer_id AND field = 'is_deleted'), false) AS gone
      FROM c, i WHERE signup_date <= i.moment::DATE),
    live AS (SELECT customer_id, moment, gone, segment, last_value(CASE WHEN NOT gone THEN tier END IGNORE NULLS) OVER w AS tier, max(CASE WHEN NOT gone THEN 1 END) OVER w AS seen FROM s WINDOW w AS (PARTITION BY customer_id ORDER BY moment)),
    moved AS (SELECT * FROM (SELECT *, lag(moment) OVER w AS b, lag(tier) OVER w AS bt, lag(gone) OVER w AS bg FROM live WHERE seen = 1 WINDOW w AS (PARTITION BY customer_id ORDER BY moment)) WHERE b IS NULL OR bt <> tier OR bg <> gone)
    SELECT customer_id, tier AS loyalty_tier, row_number() OVER w AS version, CASE WHEN row_number() OVER w = 1 THEN TIMESTAMP '1900-01-01' ELSE moment END AS valid_from, coalesce(lead(moment) OVER w, TIMESTAMP '9999-12-31') AS valid_to, lead(moment) OVER w IS NULL AS is_current, gone AS is_tombstone FROM moved WINDOW w AS (PARTITION BY customer_id ORDER BY moment)""",
)
def scd2_snapshots(k: Lake) -> DataFrame:
    """Snapshots of four days merged one by one into the written dimension."""
    store = Snapshots(k.spark, scratch(k.spark, "snapshots"), "customer_id", ["loyalty_tier", "segment"])
    for day in _AT:
        at = F.to_timestamp(F.lit(day))
        store.take(scd2.point_in_time(k.customers, k.change_log, at, "customer_id", ["loyalty_tier", "is_deleted"], "signup_date"), at, F.col("is_deleted") == "true")
    return store.versions().select("customer_id", "loyalty_tier", "version", "valid_from", "valid_to", "is_current", "is_tombstone")


# -- dimensions -------------------------------------------------------------------


@query("", "SELECT d::DATE AS date, strftime(d, '%Y%m%d')::BIGINT AS date_key, year(d) AS year, quarter(d) AS quarter, month(d) AS month, weekofyear(d) AS iso_week, isodow(d) AS iso_dow, isodow(d) >= 6 AS is_weekend, datediff('day', DATE '2026-08-01', d::DATE) AS days_from_anchor FROM generate_series(DATE '2023-08-01', DATE '2027-08-01', INTERVAL 1 DAY) g(d)")
def dim_date(k: Lake) -> DataFrame:
    from tidewater.sources.readers import calendar

    anchor, d = F.lit("2026-08-01").cast("date"), F.col("day")
    days = calendar(k.spark, F.add_months(anchor, -36), F.add_months(anchor, 12))
    dow = (F.weekday(d) + 1).cast("bigint")
    long = lambda c: c.cast("bigint")
    return days.select(d.alias("date"), S.date_key(d).alias("date_key"), long(F.year(d)).alias("year"), long(F.quarter(d)).alias("quarter"), long(F.month(d)).alias("month"), long(F.weekofyear(d)).alias("iso_week"), dow.alias("iso_dow"), (dow >= 6).alias("is_weekend"), long(F.datediff(d, anchor)).alias("days_from_anchor"))


@query("dim", "SELECT * FROM dim")
def dim_customer(k: Lake) -> DataFrame:
    return dim_customer_frame(k)


@query("p", "SELECT md5(product_id::VARCHAR) AS product_key, product_id, product_name, category, subcategory, unit_price::DOUBLE AS unit_price, unit_cost::DOUBLE AS unit_cost, round(100.0::DOUBLE * (unit_price - unit_cost)::DOUBLE / unit_price::DOUBLE, 2) AS nadd_margin_pct FROM p")
def dim_product(k: Lake) -> DataFrame:
    p = k.products
    return p.select(S.surrogate_key(F.col("product_id")).alias("product_key"), "product_id", "product_name", "category", "subcategory", F.col("unit_price").cast("double").alias("unit_price"), F.col("unit_cost").cast("double").alias("unit_cost"), S.percent(F.col("unit_price") - F.col("unit_cost"), F.col("unit_price")).alias("nadd_margin_pct"))


# -- facts ------------------------------------------------------------------------


def versioned(k: Lake, fact: DataFrame, ts: str) -> DataFrame:
    """A fact with the key of the customer version valid at its time."""
    d = dim_customer_frame(k).select("customer_key", F.col("customer_id").alias("_c"), "loyalty_tier", "valid_from", "valid_to")
    return scd2.as_of(fact, d, [("customer_id", "_c")], ts).drop("_c", "valid_from", "valid_to")


AS_OF = "LEFT JOIN dim d ON {f}.customer_id = d.customer_id AND {ts} >= d.valid_from AND {ts} < d.valid_to"


@query("o dim", f"SELECT order_id, o.customer_id, d.version, d.loyalty_tier FROM o {AS_OF.format(f='o', ts='o.order_ts')}")
def join_asof_scd2(k: Lake) -> DataFrame:
    o = k.orders.select("order_id", "customer_id", "order_ts")
    d = dim_customer_frame(k).select(F.col("customer_id").alias("_c"), "version", "loyalty_tier", "valid_from", "valid_to")
    return scd2.as_of(o, d, [("customer_id", "_c")], "order_ts").select("order_id", "customer_id", "version", "loyalty_tier")


@query("o dim l pay", f"WITH lr AS ({LINE_ROLLUP}), pr AS ({PAY_ROLLUP}) SELECT order_id, d.customer_key, strftime(order_ts, '%Y%m%d')::BIGINT AS date_key, status, channel, amount::DOUBLE AS amount, CASE WHEN recognised THEN amount ELSE 0 END::DOUBLE AS recognised_amount, coalesce(n_lines, 0) AS n_lines, coalesce(attempts, 0) AS attempts, coalesce(captured, 0) AS captured FROM o {AS_OF.format(f='o', ts='o.order_ts')} LEFT JOIN lr USING (order_id) LEFT JOIN pr USING (order_id)")
def fact_orders(k: Lake) -> DataFrame:
    o = versioned(k, k.orders, "order_ts").join(int_order_line_rollup(k), "order_id", "left").join(int_order_payments(k), "order_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return o.select("order_id", "customer_key", S.date_key(F.col("order_ts")).alias("date_key"), "status", "channel", F.col("amount").cast("double").alias("amount"), F.when(F.col("recognised"), F.col("amount").cast("double")).otherwise(0.0).alias("recognised_amount"), zero("n_lines"), zero("attempts"), F.coalesce("captured", F.lit(0.0)).alias("captured"))


@query("o l p dim", f"SELECT order_id, line_number, l.product_id, CASE WHEN p.product_id IS NOT NULL THEN md5(l.product_id::VARCHAR) END AS product_key, d.customer_key, quantity::DOUBLE AS quantity, line_amount::DOUBLE AS line_amount, CASE WHEN recognised THEN line_amount ELSE 0 END::DOUBLE AS recognised_amount, (line_amount - quantity * unit_cost)::DOUBLE AS margin FROM l JOIN o USING (order_id) LEFT JOIN p ON p.product_id = l.product_id {AS_OF.format(f='o', ts='o.order_ts')}")
def fact_order_items(k: Lake) -> DataFrame:
    o = versioned(k, k.orders.select("order_id", "customer_id", "order_ts", "recognised"), "order_ts").select("order_id", "customer_key", "recognised")
    return lines_with_products(k).join(o, "order_id").select("order_id", "line_number", "product_id", F.when(F.col("known"), S.surrogate_key(F.col("product_id"))).alias("product_key"), "customer_key", F.col("quantity").cast("double").alias("quantity"), F.col("line_amount").cast("double").alias("line_amount"), F.when(F.col("recognised"), F.col("line_amount").cast("double")).otherwise(0.0).alias("recognised_amount"), F.col("margin").cast("double").alias("margin"))


@query("pay o dim", f"SELECT order_id, attempt_number, payment_method, pay.status, d.customer_key, pay.amount::DOUBLE AS amount, CASE WHEN is_captured THEN pay.amount ELSE 0 END::DOUBLE AS captured_amount, failure_reason, strftime(processed_ts, '%Y%m%d')::BIGINT AS date_key FROM pay LEFT JOIN o USING (order_id) {AS_OF.format(f='o', ts='processed_ts')}")
def fact_payments(k: Lake) -> DataFrame:
    # rows are shuffled whole by customer, so with what the fact shows alone
    needed = k.payments.select("order_id", "attempt_number", "payment_method", "status", "amount", "processed_ts", "is_captured", "failure_reason")
    p = versioned(k, needed.join(k.orders.select("order_id", "customer_id"), "order_id", "left"), "processed_ts")
    return p.select("order_id", "attempt_number", "payment_method", "status", "customer_key", F.col("amount").cast("double").alias("amount"), F.when(F.col("is_captured"), F.col("amount").cast("double")).otherwise(0.0).alias("captured_amount"), "failure_reason", S.date_key(F.col("processed_ts")).alias("date_key"))


@query("ses p dim", "SELECT event_id, session_id, d.customer_key, CASE WHEN p.product_id IS NOT NULL THEN md5(p.product_id::VARCHAR) END AS product_key, event_type FROM ses s LEFT JOIN p ON p.product_id = s.event_id % 300 LEFT JOIN dim d ON d.customer_id = s.user_id AND event_ts >= d.valid_from AND event_ts < d.valid_to")
def fact_web_events(k: Lake) -> DataFrame:
    e = sessions(k).withColumn("customer_id", F.col("user_id")).withColumn("product_id", F.col("event_id") % 300)
    p = k.products.select("product_id", S.surrogate_key(F.col("product_id")).alias("product_key"))
    return versioned(k, e.join(p, "product_id", "left"), "event_ts").select("event_id", "session_id", "customer_key", "product_key", "event_type")


@query("t en dim", "SELECT t.ticket_id, d.customer_key, intent, contact_channel, resolved_ts IS NOT NULL AS is_resolved, round(epoch(resolved_ts - created_ts) / 3600.0, 4) AS hours_to_resolve, CASE WHEN ai_label IS NOT NULL THEN ai_label = truth END AS ai_agrees FROM t LEFT JOIN en ON en.ticket_id = t.ticket_id LEFT JOIN dim d ON d.customer_id = t.customer_id AND created_ts >= d.valid_from AND created_ts < d.valid_to")
def fact_support_tickets(k: Lake) -> DataFrame:
    t = versioned(k, k.tickets.join(k.enrichment, "ticket_id", "left"), "created_ts")
    return t.select("ticket_id", "customer_key", "intent", "contact_channel", F.col("resolved_ts").isNotNull().alias("is_resolved"), F.round(S.hours_between(F.col("created_ts"), F.col("resolved_ts")), 4).alias("hours_to_resolve"), F.when(F.col("ai_label").isNotNull(), F.col("ai_label") == F.col("truth")).alias("ai_agrees"))


# -- marts ------------------------------------------------------------------------


@query(
    "o",
    """WITH a AS (SELECT order_ts::DATE AS date, channel, count(*) AS orders, count(*) FILTER (recognised) AS recognised_orders, count(DISTINCT customer_id) AS customers, coalesce(sum(amount) FILTER (recognised), 0)::DOUBLE AS revenue FROM o GROUP BY 1, 2),
    s AS (SELECT d::DATE AS date, channel FROM generate_series((SELECT min(date) FROM a), (SELECT max(date) FROM a), INTERVAL 1 DAY) g(d), (SELECT DISTINCT channel FROM o)),
    j AS (SELECT date, channel, coalesce(orders, 0) AS orders, coalesce(recognised_orders, 0) AS recognised_orders, coalesce(customers, 0) AS customers, coalesce(revenue, 0) AS revenue FROM s LEFT JOIN a USING (date, channel))
    SELECT *, CASE WHEN recognised_orders > 0 THEN round(revenue / recognised_orders, 6) END AS nadd_aov, round(avg(revenue) OVER (PARTITION BY channel ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS nadd_revenue_7d FROM j""",
)
def mart_daily_sales(k: Lake) -> DataFrame:
    """Day by channel without gaps: spine, zeros, average order value, trailing average of seven rows."""
    r = F.col("recognised")
    daily = k.orders.groupBy(F.to_date("order_ts").alias("date"), "channel").agg(F.count("*").alias("orders"), F.count_if(r).alias("recognised_orders"), F.count_distinct("customer_id").alias("customers"), F.coalesce(F.sum(F.when(r, F.col("amount"))), F.lit(0)).cast("double").alias("revenue"))
    span = k.orders.agg(F.to_date(F.min("order_ts")).alias("a"), F.to_date(F.max("order_ts")).alias("b"))
    # days are a calendar's, channels a vocabulary's
    spine = span.select(F.explode(F.sequence("a", "b")).alias("date")).crossJoin(F.broadcast(k.orders.select("channel").distinct()))
    full = spine.join(daily, ["date", "channel"], "left").fillna(0, ["orders", "recognised_orders", "customers", "revenue"])
    week = Window.partitionBy("channel").orderBy("date").rowsBetween(-6, 0)
    return full.withColumn("nadd_aov", S.ratio(F.col("revenue"), F.col("recognised_orders"), 6)).withColumn("nadd_revenue_7d", F.round(F.avg("revenue").over(week), 6))


RFM = """WITH b AS (SELECT customer_id, max(order_ts)::DATE AS last_order, count(*) AS frequency, sum(amount)::DOUBLE AS monetary FROM o WHERE recognised GROUP BY 1),
    q AS (SELECT *, ntile(5) OVER (ORDER BY last_order, customer_id) AS r, ntile(5) OVER (ORDER BY frequency, customer_id) AS f, ntile(5) OVER (ORDER BY monetary, customer_id) AS m FROM b)"""
# The segments, the first that fits.
SEGMENT = """CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'champion' WHEN r >= 4 AND f >= 3 THEN 'loyal' WHEN r >= 4 THEN 'promising'
    WHEN r = 3 AND f >= 3 THEN 'needs_attention' WHEN r <= 2 AND f >= 4 THEN 'at_risk' WHEN r <= 2 AND m >= 4 THEN 'cant_lose' WHEN r <= 2 THEN 'hibernating' ELSE 'other' END"""


def ntiles(df: DataFrame, n: int, **by: str) -> DataFrame:
    """``ntile(n)`` over the whole frame for each (name, column), ties by customer; each is a parallel numbering, not a one-task window."""
    from tidewater.operators.conform import number_rows

    total = df.count()
    small, big = divmod(total, n)
    for name, col in by.items():
        df = number_rows(df, [col, "customer_id"], "_n")
        cut = big * (small + 1)
        i = F.col("_n") - 1
        df = df.withColumn(name, F.when(i < cut, F.floor(i / F.lit(small + 1))).otherwise(F.lit(big) + F.floor((i - cut) / F.lit(max(small, 1)))) + 1).withColumn(name, F.col(name).cast("bigint")).drop("_n")
    return df


def rfm_base(k: Lake) -> DataFrame:
    g = k.orders.where("recognised").groupBy("customer_id").agg(F.to_date(F.max("order_ts")).alias("last_order"), F.count("*").alias("frequency"), F.sum("amount").cast("double").alias("monetary"))
    return ntiles(g, 5, r="last_order", f="frequency", m="monetary")


@query(
    "o dim",
    f"""{RFM} SELECT customer_key, q.customer_id, loyalty_tier, segment, is_tombstone AS is_deleted, last_order, frequency, monetary, r, f, m, r + f + m AS rfm_score,
    {SEGMENT} AS rfm_segment, ((2 * (monetary::DECIMAL(18,2) * 100)::BIGINT + frequency) // (2 * frequency)) / 100.0::DOUBLE AS nadd_avg_order_value FROM q JOIN dim ON dim.customer_id = q.customer_id AND is_current""",
)
def mart_customer_rfm(k: Lake) -> DataFrame:
    """Scores with the current version of the customer, of those deleted too. Recent customers score 5, as the segment rules need."""
    now = dim_customer_frame(k).where("is_current").select("customer_key", "customer_id", "loyalty_tier", "segment", F.col("is_tombstone").alias("is_deleted"))
    # halves of cents go up, in whole numbers
    average = F.expr("((2 * cast(cast(monetary as decimal(18,2)) * 100 as bigint) + frequency) div (2 * frequency)) / 100.0D")
    scored = rfm_base(k).withColumns({"rfm_score": F.col("r") + F.col("f") + F.col("m"), "rfm_segment": F.expr(SEGMENT), "nadd_avg_order_value": average})
    return scored.join(now, "customer_id")


@query("o", f"{RFM} SELECT customer_id, r, f, m FROM q")
def win_ntile_rfm(k: Lake) -> DataFrame:
    return rfm_base(k).select("customer_id", "r", "f", "m")


@query("o", f"{RFM} SELECT customer_id, 6 - r AS r_score FROM q")
def rfm_reference_formula(k: Lake) -> DataFrame:
    """The formula as the reference has it, under which recent customers score 1."""
    return rfm_base(k).select("customer_id", (6 - F.col("r")).alias("r_score"))


@query("o", "WITH f AS (SELECT customer_id, date_trunc('month', min(order_ts))::DATE AS cohort FROM o WHERE recognised GROUP BY 1), s AS (SELECT cohort, count(*) AS cohort_size FROM f GROUP BY 1), x AS (SELECT cohort, datediff('month', cohort, date_trunc('month', order_ts)::DATE) AS months_since, count(DISTINCT customer_id) AS active FROM o JOIN f USING (customer_id) WHERE recognised GROUP BY 1, 2) SELECT cohort, months_since, active, cohort_size, round(100.0::DOUBLE * active / cohort_size, 2) AS nadd_retention_pct FROM x JOIN s USING (cohort)")
def mart_cohort_retention(k: Lake) -> DataFrame:
    o = k.orders.where("recognised").select("customer_id", F.trunc("order_ts", "month").alias("month"))
    first = o.groupBy("customer_id").agg(F.min("month").alias("cohort"))
    size = first.groupBy("cohort").agg(F.count("*").alias("cohort_size"))
    cells = o.join(first, "customer_id").groupBy("cohort", S.months_since(F.col("cohort"), F.col("month")).alias("months_since")).agg(F.count_distinct("customer_id").alias("active"))
    return cells.join(size, "cohort").select("cohort", "months_since", "active", "cohort_size", S.percent(F.col("active"), F.col("cohort_size")).alias("nadd_retention_pct"))


@query("o l p", "SELECT date_trunc('month', order_ts)::DATE AS month, l.product_id, coalesce(product_name, '(unknown product)') AS product_name, coalesce(category, '(unknown)') AS category, sum(quantity)::DOUBLE AS units, coalesce(sum(line_amount) FILTER (recognised), 0)::DOUBLE AS revenue, sum(line_amount - quantity * unit_cost)::DOUBLE AS margin, CASE WHEN coalesce(sum(line_amount) FILTER (recognised), 0) > 0 THEN round(100.0::DOUBLE * sum(line_amount - quantity * unit_cost)::DOUBLE / sum(line_amount) FILTER (recognised)::DOUBLE, 2) END AS nadd_margin_pct FROM l JOIN o USING (order_id) LEFT JOIN p ON p.product_id = l.product_id GROUP BY 1, 2, 3, 4")
def mart_product_performance(k: Lake) -> DataFrame:
    li = lines_with_products(k).join(k.orders.select("order_id", "order_ts", "recognised"), "order_id")
    g = li.groupBy(F.trunc("order_ts", "month").alias("month"), "product_id", F.coalesce("product_name", F.lit("(unknown product)")).alias("product_name"), F.coalesce("category", F.lit("(unknown)")).alias("category")).agg(F.sum("quantity").cast("double").alias("units"), F.coalesce(F.sum(F.when(F.col("recognised"), F.col("line_amount"))), F.lit(0)).cast("double").alias("revenue"), F.sum("margin").cast("double").alias("margin"))
    return g.withColumn("nadd_margin_pct", S.percent(F.col("margin"), F.col("revenue")))


@query("pay", "WITH a AS (SELECT processed_ts::DATE AS date, payment_method, count(*) AS attempts, count(*) FILTER (is_captured) AS captured, count(*) FILTER (is_failed) AS failed, count(DISTINCT order_id) FILTER (is_failed) AS failed_orders, coalesce(sum(amount) FILTER (is_captured), 0)::DOUBLE AS captured_amount FROM pay GROUP BY 1, 2), r AS (SELECT processed_ts::DATE AS date, payment_method, failure_reason, count(*) AS n FROM pay WHERE is_failed GROUP BY 1, 2, 3), rr AS (SELECT date, payment_method, arg_max(failure_reason, (n, failure_reason)) AS top_reason, '{' || string_agg('\"' || failure_reason || '\":' || n, ',' ORDER BY failure_reason) || '}' AS reasons FROM r GROUP BY 1, 2) SELECT a.*, top_reason, coalesce(reasons, '{}') AS reasons, round(100.0::DOUBLE * captured / attempts, 2) AS nadd_capture_pct FROM a LEFT JOIN rr USING (date, payment_method)")
def mart_payment_health(k: Lake) -> DataFrame:
    c, f = F.col("is_captured"), F.col("is_failed")
    day = F.to_date("processed_ts").alias("date")
    a = k.payments.groupBy(day, "payment_method").agg(F.count("*").alias("attempts"), F.count_if(c).alias("captured"), F.count_if(f).alias("failed"), F.count_distinct(F.when(f, F.col("order_id"))).alias("failed_orders"), F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0)).cast("double").alias("captured_amount"))
    n = k.payments.where(f).groupBy(day, "payment_method", "failure_reason").agg(F.count("*").alias("n"))
    r = n.groupBy("date", "payment_method").agg(F.max_by("failure_reason", F.struct("n", "failure_reason")).alias("top_reason"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("failure_reason", "n"))))).alias("reasons"))
    return a.join(r, ["date", "payment_method"], "left").withColumn("reasons", F.coalesce("reasons", F.lit("{}"))).withColumn("nadd_capture_pct", S.percent(F.col("captured"), F.col("attempts")))


@query(
    "ses",
    """WITH f AS (SELECT session_id, min(event_ts)::DATE AS date, arg_min(channel, (event_ts, event_id)) AS channel, arg_min(device_type, (event_ts, event_id)) AS device_type, count(*) AS n,
    bool_or(event_type = 'view') AS viewed, bool_or(event_type = 'click') AS clicked, bool_or(event_type = 'purchase') AS bought FROM ses GROUP BY session_id)
    SELECT date, channel, device_type, count(*) AS sessions, sum(n)::BIGINT AS events, count(*) FILTER (viewed) AS viewed, count(*) FILTER (clicked) AS clicked, count(*) FILTER (bought) AS bought,
    round(100.0::DOUBLE * count(*) FILTER (bought) / count(*), 2) AS nadd_conversion_pct FROM f GROUP BY 1, 2, 3""",
)
def mart_web_funnel(k: Lake) -> DataFrame:
    """Day by the channel and device that a session began with."""
    first, t = F.struct("event_ts", "event_id"), F.col("event_type")
    steps = {"viewed": "view", "clicked": "click", "bought": "purchase"}
    f = sessions(k).groupBy("session_id").agg(
        F.to_date(F.min("event_ts")).alias("date"),
        *[F.min_by(c, first).alias(c) for c in ("channel", "device_type")],
        F.count("*").alias("n"),
        *[F.bool_or(t == v).alias(c) for c, v in steps.items()],
    )
    g = f.groupBy("date", "channel", "device_type").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), *[F.count_if(c).alias(c) for c in steps])
    return g.withColumn("nadd_conversion_pct", S.percent(F.col("bought"), F.col("sessions")))


@query(
    "t en",
    """SELECT created_ts::DATE AS date, intent, priority, contact_channel, count(*) AS tickets, count(resolved_ts) AS resolved, count(*) FILTER (status = 'open') AS open_tickets,
    count(*) FILTER (status = 'pending') AS pending_tickets, count(DISTINCT customer_id) AS customers,
    round(quantile_cont(epoch(resolved_ts - created_ts) / 3600.0, 0.5), 4) AS nadd_median_hours, round(100.0::DOUBLE * count(resolved_ts) / count(*), 2) AS nadd_resolution_rate_pct,
    count(ai_label) AS labelled, count(*) FILTER (ai_label = truth) AS agreed, round(100.0::DOUBLE * count(ai_label) / count(*), 2) AS nadd_ai_coverage_pct,
    CASE WHEN count(ai_label) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (ai_label = truth) / count(ai_label), 2) END AS nadd_ai_accuracy_pct
    FROM t LEFT JOIN en USING (ticket_id) GROUP BY 1, 2, 3, 4""",
)
def mart_support_health(k: Lake) -> DataFrame:
    """Day by intent, priority and contact channel; accuracy is over the labelled, so that no labels mean no figure."""
    t = k.tickets.join(k.enrichment, "ticket_id", "left").withColumn("h", S.hours_between(F.col("created_ts"), F.col("resolved_ts")))
    g = t.groupBy(F.to_date("created_ts").alias("date"), "intent", "priority", "contact_channel").agg(
        F.count("*").alias("tickets"),
        F.count("resolved_ts").alias("resolved"),
        *[F.count_if(F.col("status") == x).alias(f"{x}_tickets") for x in ("open", "pending")],
        F.count_distinct("customer_id").alias("customers"),
        F.round(F.median("h"), 4).alias("nadd_median_hours"),
        F.count("ai_label").alias("labelled"),
        F.count_if(F.col("ai_label") == F.col("truth")).alias("agreed"),
    )
    shares = {"nadd_resolution_rate_pct": ("resolved", "tickets"), "nadd_ai_coverage_pct": ("labelled", "tickets"), "nadd_ai_accuracy_pct": ("agreed", "labelled")}
    return g.withColumns({name: S.percent(F.col(a), F.col(b)) for name, (a, b) in shares.items()})


# -- data quality -----------------------------------------------------------------


@query("l p", "SELECT count(*) AS scanned, count(*) FILTER (p.product_id IS NULL) AS failed FROM l LEFT JOIN p ON p.product_id = l.product_id")
def dq_referential(k: Lake) -> DataFrame:
    return Q.referential(k.lines.withColumnRenamed("product_id", "ref"), "ref", k.products, "product_id")


@query("pay", "SELECT count(*) AS scanned, count(*) FILTER (NOT (failure_reason <> 'reason_1')) AS failed FROM pay WHERE order_id % 2 = 0")
def dq_invariant_3vl(k: Lake) -> DataFrame:
    """A null predicate holds: payments without a reason are scanned and don't fail."""
    return Q.invariant(k.payments, F.col("failure_reason") != "reason_1", F.col("order_id") % 2 == 0)


#: Tables that must hold something, and how much.
VOLUMES = {"region": 5, "nation": 25, "customer": 100, "supplier": 10, "part": 100, "orders": 1000, "lineitem": 5000, "events": 1000, "documents": 100, "labels": 10, "conversations": 10, "pages": 10, "benchmark": 100_000}


@query("", " UNION ALL ".join(f"SELECT '{t}' AS table_name, 1::BIGINT AS scanned, CASE WHEN count(*) < {n} THEN 1 ELSE 0 END::BIGINT AS failed FROM {t}" for t, n in VOLUMES.items()))
def dq_not_empty(k: Lake) -> DataFrame:
    """Every table of the data model; the last bound is one that fails."""
    each = [Q.not_empty(k.raw(t), n).select(F.lit(t).alias("table_name"), "scanned", "failed") for t, n in VOLUMES.items()]
    return reduce(DataFrame.unionByName, each)


#: (child, its column, parent, its column) as the stand-ins have them.
LINKS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("events", "user_id", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"), ("customer", "c_nationkey", "nation", "n_nationkey")]


@query("", " UNION ALL ".join(f"SELECT '{c}.{x}' AS reference, count(*) AS scanned, count(*) FILTER (NOT EXISTS (SELECT 1 FROM {p} WHERE {p}.{y} = {c}.{x})) AS failed FROM {c} WHERE {c}.{x} IS NOT NULL" for c, x, p, y in LINKS))
def dq_references(k: Lake) -> DataFrame:
    """Every reference of the data model."""
    each = [Q.referential(k.raw(c).select(F.col(x).alias("ref")), "ref", k.raw(p), y).select(F.lit(f"{c}.{x}").alias("reference"), "scanned", "failed") for c, x, p, y in LINKS]
    return reduce(DataFrame.unionByName, each)


UNIQUE = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "part": ["p_partkey"], "documents": ["doc_id"], "events": ["event_id"], "pages": ["url"]}


@query("", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS scanned, count(*) - count(DISTINCT ({', '.join(f'coalesce({x}::VARCHAR, chr(0))' for x in c)})) AS failed FROM {t}" for t, c in UNIQUE.items()))
def dq_unique_keys(k: Lake) -> DataFrame:
    """The key of every table; pages repeat their URLs."""
    each = [Q.unique_key(k.raw(t), c).select(F.lit(t).alias("table_name"), "scanned", "failed") for t, c in UNIQUE.items()]
    return reduce(DataFrame.unionByName, each)


@query("l", "SELECT count(*) AS scanned, (count(*) - count(DISTINCT (order_id, line_number))) AS failed FROM l")
def dq_unique(k: Lake) -> DataFrame:
    return Q.unique_key(k.lines, ["order_id", "line_number"])


@query("e", "SELECT count(*) AS scanned, count(*) FILTER (last IS NULL OR epoch(TIMESTAMP '2024-01-31' - last) / 3600 > 24) AS failed FROM (SELECT event_type, max(event_ts) FILTER (user_id % 50 = 0) AS last FROM e GROUP BY 1)")
def dq_freshness(k: Lake) -> DataFrame:
    log = k.events.withColumn("status", F.when(F.col("user_id") % 50 == 0, "SUCCESS").otherwise("FAILED"))
    return Q.freshness(log, "event_type", "status", "event_ts", F.to_timestamp(F.lit("2024-01-31 00:00:00")), 24)


@query("o", "WITH v AS (SELECT count(*) FILTER (status = 'P')::DOUBLE / count(*) AS share_p, avg(amount::DOUBLE) AS mean_amount, count(DISTINCT channel)::DOUBLE AS channels FROM o) SELECT 'share_p' AS measure, round(share_p, 6) AS value, share_p BETWEEN 0.2 AND 0.5 AS ok FROM v UNION ALL SELECT 'mean_amount', round(mean_amount, 4), mean_amount >= 1 FROM v UNION ALL SELECT 'channels', channels, channels <= 4 FROM v")
def dq_distribution(k: Lake) -> DataFrame:
    share = F.count_if(F.col("status") == "P") / F.count("*")
    got = Q.distribution(k.orders, [("share_p", F.round(share, 6), 0.2, 0.5), ("mean_amount", F.round(F.avg(F.col("amount").cast("double")), 4), 1, None), ("channels", F.count_distinct("channel"), None, 4)])
    return got.select("measure", "value", "ok")


@query("e", "SELECT DISTINCT ON (event_type) event_type AS check_name, event_id AS run, user_id % 2 = 0 AS passed FROM e ORDER BY event_type, event_ts DESC, event_id DESC")
def dq_latest_per_check(k: Lake) -> DataFrame:
    h = k.events.select(F.col("event_type").alias("check_name"), F.struct("event_ts", "event_id").alias("at"), F.col("event_id").alias("run"), (F.col("user_id") % 2 == 0).alias("passed"))
    return Q.latest_results(h, "check_name", "at").select("check_name", "run", "passed")


@query("o l pay", "SELECT 'fact_orders' AS fact, (SELECT count(*) FROM o) AS rows_out, count(*) - count(DISTINCT order_id) AS surplus FROM o UNION ALL SELECT 'fact_order_items', (SELECT count(*) FROM l JOIN o USING (order_id)), (SELECT count(*) FROM l JOIN o USING (order_id)) - (SELECT count(*) FROM l) UNION ALL SELECT 'fact_payments', (SELECT count(*) FROM pay), 0")
def dq_union_fanout(k: Lake) -> DataFrame:
    """No fact has more rows than what it is made of."""
    n = lambda df, c: df.agg(F.count("*").alias(c))
    one = lambda name, fact, src: n(fact, "rows_out").crossJoin(F.broadcast(n(src, "src"))).select(F.lit(name).alias("fact"), "rows_out", (F.col("rows_out") - F.col("src")).alias("surplus"))
    return one("fact_orders", fact_orders(k), k.orders).unionByName(one("fact_order_items", fact_order_items(k), k.lines)).unionByName(one("fact_payments", fact_payments(k), k.payments))


@query("o l", "SELECT order_id, amount::DOUBLE AS header, coalesce(s, 0)::DOUBLE AS lines FROM o LEFT JOIN (SELECT order_id, sum(line_amount) AS s FROM l GROUP BY 1) USING (order_id) WHERE abs(amount - coalesce(s, 0)) > 100000")
def dq_reconcile_grains(k: Lake) -> DataFrame:
    """Orders whose lines are far from the header's amount."""
    s = k.lines.groupBy("order_id").agg(F.sum("line_amount").alias("s"))
    got = k.orders.join(s, "order_id", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    return got.where(F.abs(F.col("amount") - F.col("s")) > 100000).select("order_id", F.col("amount").cast("double").alias("header"), F.col("s").cast("double").alias("lines"))
