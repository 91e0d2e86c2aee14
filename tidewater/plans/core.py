"""Catalogue: scans, predicates, dedup and upserts, joins, aggregates, windows, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import scalar as S
from tidewater.operators import conform, serving
from tidewater.plans.base import Lake, query
from tidewater.spec import Entity, Field

# -- scans and predicates ---------------------------------------------------------


@query("o l", "SELECT l.order_id, line_number, line_amount::DOUBLE AS line_amount FROM l WHERE line_amount > 40000 AND discount >= 0.05")
def scan_project_filter(k: Lake) -> DataFrame:
    li = k.raw("lineitem").where((F.col("l_extendedprice") > 40000) & (F.col("l_discount") >= 0.05))
    return li.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("line_number"), S.money(F.col("l_extendedprice")).cast("double").alias("line_amount"))


@query("", "SELECT event_id, nullif(trim(CASE WHEN event_id % 7 = 0 THEN '  ' ELSE ' ' || event_type || ' ' END), '') AS event_type, CASE event_id % 3 WHEN 0 THEN event_id::INT WHEN 1 THEN NULL ELSE -5 END AS n, CASE WHEN event_id % 2 = 0 THEN DATE '2024-01-05' END AS d FROM events")
def normalise_try_cast(k: Lake) -> DataFrame:
    e = k.raw("events").withColumn("t", F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "))))
    number = F.element_at(F.array(F.col("event_id").cast("string"), F.lit("x1"), F.lit(" -5 ")), (F.col("event_id") % 3 + 1).cast("int"))
    day = F.when(F.col("event_id") % 2 == 0, "2024-01-05").otherwise("2026-13-45")
    return e.select("event_id", S.normalise(F.col("t")).alias("event_type"), S.safe_cast(number, "int").alias("n"), S.safe_cast(day, "date").alias("d"))


#: Events as a text feed with planted defects, to be conformed.
FEED = Entity("feed", "files", ("event_id",), (Field("event_id", "bigint"), Field("event_ts", "timestamp"), Field("event_type", allowed=("click", "purchase", "signup", "view")), Field("value", "double", minimum=0)), "event_ts")
_FEED_SQL = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'missing:event_id' WHEN event_id % 13 = 0 THEN 'bad_type:event_ts' WHEN event_id % 17 = 0 THEN 'missing:event_type' WHEN event_type NOT IN ('click','purchase','signup','view') THEN 'bad_enum:event_type' WHEN event_id % 19 = 0 THEN 'out_of_range:value' END AS reason FROM events"""


def feed(k: Lake) -> DataFrame:
    e, i = k.raw("events"), F.col("event_id")
    rows = e.select(
        i.alias("row_id"),
        F.when(i % 11 == 0, "").otherwise(i.cast("string")).alias("event_id"),
        F.when(i % 13 == 0, "31/02/2026").otherwise(F.col("ts").cast("string")).alias("event_ts"),
        F.when(i % 17 == 0, " ").otherwise(F.col("event_type")).alias("event_type"),
        F.when(i % 19 == 0, "-1").otherwise(F.abs("value").cast("string")).alias("value"),
    )
    return rows.withColumn("reason", conform.rules(FEED))


@query("", f"SELECT event_id AS row_id, reason FROM ({_FEED_SQL}) WHERE reason IS NOT NULL")
def quarantine_reason(k: Lake) -> DataFrame:
    return feed(k).where("reason IS NOT NULL").select("row_id", "reason")


@query("", f"SELECT coalesce(reason, 'good') AS verdict, count(*) AS n FROM ({_FEED_SQL}) GROUP BY 1")
def quarantine_split_counts(k: Lake) -> DataFrame:
    return feed(k).groupBy(F.coalesce("reason", F.lit("good")).alias("verdict")).agg(F.count("*").alias("n"))


@query("o", "SELECT order_id, order_ts FROM o WHERE order_ts > TIMESTAMP '2000-06-01'")
def incremental_watermark(k: Lake) -> DataFrame:
    return conform.incremental(k.orders.select("order_id", "order_ts"), "order_ts", "2000-06-01 00:00:00")


@query("", "SELECT event_id FROM events WHERE (event_id % 13 <> 0 AND ts > TIMESTAMP '2024-01-20') OR (event_id % 13 = 0 AND event_id % 2 = 1)")
def incremental_unparseable_once(k: Lake) -> DataFrame:
    """Rows after the watermark; of those without a readable time, only what was never captured."""
    e = k.raw("events").select("event_id", F.when(F.col("event_id") % 13 == 0, "not-a-date").otherwise(F.col("ts").cast("string")).alias("event_ts"))
    e = e.withColumn("_record_hash", S.record_hash(F.col("event_id"), F.col("event_ts")))
    return conform.incremental(e, "event_ts", "2024-01-20 00:00:00", e.where("event_id % 2 = 0")).select("event_id")


@query("o", "SELECT order_id, order_ts, (SELECT count(*) FROM o WHERE (order_ts, order_id) > (TIMESTAMP '1998-01-01', 100)) > 50 AS has_more FROM o WHERE (order_ts, order_id) > (TIMESTAMP '1998-01-01', 100) ORDER BY order_ts, order_id LIMIT 50")
def keyset_page(k: Lake) -> DataFrame:
    o = k.orders.select("order_id", "order_ts")
    return serving.keyset_page(o, "order_ts", "order_id", 50, ("1998-01-01 00:00:00", 100)).drop("cursor")


@query("o", "SELECT order_id, order_ts FROM o WHERE (order_ts, order_id) > (TIMESTAMP '1998-01-01', 100) ORDER BY order_ts, order_id LIMIT 50 OFFSET 50")
def keyset_next_page(k: Lake) -> DataFrame:
    """The page after the first, by the cursor that the first one's last row gives."""
    o = k.orders.select("order_id", "order_ts")
    last = serving.keyset_page(o, "order_ts", "order_id", 50, ("1998-01-01 00:00:00", 100)).orderBy(F.desc("order_ts"), F.desc("order_id")).first()
    return serving.keyset_page(o, "order_ts", "order_id", 50, last["cursor"]).select("order_id", "order_ts")


@query("o", "SELECT order_id, CASE WHEN order_id % 9 <> 0 THEN epoch_ms(order_ts) END AS millis FROM o")
def fn_iso_millis(k: Lake) -> DataFrame:
    iso = F.when(F.col("order_id") % 9 == 0, "31/12/1998").otherwise(F.date_format("order_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return k.orders.select("order_id", S.iso_millis(iso).alias("millis"))


@query("", "SELECT column_name FROM (VALUES ('c_name'), ('c_acctbal')) v(column_name)")
def restricted_columns(k: Lake) -> DataFrame:
    """Columns of the customer table that a restricted list names."""
    bad = sorted({"c_name", "c_acctbal", "email"} & set(k.raw("customer").columns))
    return k.spark.createDataFrame([(c,) for c in bad], "column_name string")


@query("", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'trade' ELSE 'other' END AS bucket, c_acctbal BETWEEN 0 AND 5000 AS in_range, coalesce(nullif(c_mktsegment, 'BUILDING'), '(none)') AS segment FROM customer")
def predicates_and_labels(k: Lake) -> DataFrame:
    b = F.col("c_acctbal")
    bucket = F.when(b < 0, "debt").when(b < 1000, "low").when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "trade").otherwise("other")
    return k.raw("customer").select("c_custkey", bucket.alias("bucket"), b.between(0, 5000).alias("in_range"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("(none)")).alias("segment"))


@query("", "SELECT s_suppkey, r_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_geography(k: Lake) -> DataFrame:
    s, n, r = k.raw("supplier"), k.raw("nation"), k.raw("region")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("s_suppkey", "r_name", "n_name")


# -- dedup and upserts ------------------------------------------------------------


@query("", r"SELECT n_nationkey, sha256(n_nationkey::VARCHAR || chr(31) || coalesce(CASE WHEN n_nationkey % 3 > 0 THEN n_name END, '\x1FNULL')) AS record_hash FROM nation")
def record_hash(k: Lake) -> DataFrame:
    name = F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name"))
    return k.raw("nation").select("n_nationkey", S.record_hash(F.col("n_nationkey"), name).alias("record_hash"))


@query("", "SELECT event_type, user_id, max(event_id) AS event_id FROM events GROUP BY ALL")
def hash_dedup(k: Lake) -> DataFrame:
    """Of events equal in type and user the one captured last."""
    e = k.raw("events").select("event_id", "event_type", "user_id").withColumn("_record_hash", S.record_hash(F.col("event_type"), F.col("user_id")))
    return conform.hash_dedup(e, order=[F.col("event_id").desc()]).drop("_record_hash")


@query("l", "SELECT order_id, line_number, product_id, line_amount::DOUBLE AS line_amount FROM (SELECT *, row_number() OVER (PARTITION BY order_id, line_number ORDER BY line_amount DESC, product_id, quantity) AS rn FROM l) WHERE rn = 1")
def latest_per_key(k: Lake) -> DataFrame:
    got = conform.latest_per_key(k.lines, ["order_id", "line_number"], F.col("line_amount").desc_nulls_last(), F.col("product_id").asc_nulls_last(), F.col("quantity").asc_nulls_last())
    return got.select("order_id", "line_number", "product_id", F.col("line_amount").cast("double").alias("line_amount"))


@query("", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'stream' ELSE 'files' END AS origin FROM events")
def multi_source_reconcile(k: Lake) -> DataFrame:
    """Two feeds of the same events; where both have one, the later capture (the stream) wins."""
    e = k.raw("events").select("event_id")
    both = e.withColumn("origin", F.lit("files")).unionByName(e.where("event_id % 3 = 0").withColumn("origin", F.lit("stream")))
    return conform.latest_per_key(both, ["event_id"], F.col("origin").desc())


@query("", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation WHERE n_nationkey < 20 OR n_nationkey % 4 = 0")
def upsert_replace(k: Lake) -> DataFrame:
    n = k.raw("nation").select("n_nationkey", "n_name")
    return conform.upsert(n.where("n_nationkey < 20"), n.where("n_nationkey % 4 = 0").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!"))), ["n_nationkey"])


@query("", "SELECT event_type, count(*) + count(*) FILTER (user_id % 2 = 0) AS n FROM events GROUP BY event_type")
def upsert_additive(k: Lake) -> DataFrame:
    e = k.raw("events")
    count = lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"))
    return conform.upsert_adding(count(e), count(e.where("user_id % 2 = 0")), ["event_type"], "n")


@query("e", "SELECT event_type, max(event_ts) AS watermark FROM e GROUP BY event_type")
def watermark_greatest(k: Lake) -> DataFrame:
    return conform.upsert_greatest(k.events.select("event_type", F.col("event_ts").alias("watermark")), ["event_type"], "watermark")


@query("", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def orphan_reconcile(k: Lake) -> DataFrame:
    current = k.raw("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return conform.drop_orphans(k.raw("lineitem"), current, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("", "SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name) AS batch_seq FROM nation")
def batch_sequence(k: Lake) -> DataFrame:
    return conform.number_rows(k.raw("nation").select("n_nationkey", "n_name"), ["n_name"], "batch_seq")


# -- joins ------------------------------------------------------------------------


@query("o l", "SELECT l.order_id, line_number, order_ts, product_id FROM l JOIN o USING (order_id)")
def join_inner(k: Lake) -> DataFrame:
    return k.lines.join(k.orders, "order_id").select("order_id", "line_number", "order_ts", "product_id")


@query("l p", "SELECT coalesce(category, '(unknown product)') AS category, count(*) AS n, count(*) FILTER (p.product_id IS NULL) AS orphans FROM l LEFT JOIN p USING (product_id) GROUP BY 1")
def join_left_orphans(k: Lake) -> DataFrame:
    got = k.lines.join(k.products.withColumn("found", F.lit(1)), "product_id", "left")
    return got.groupBy(F.coalesce("category", F.lit("(unknown product)")).alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("found").isNull()).alias("orphans"))


@query("o", "SELECT coalesce(a.customer_id, b.customer_id) AS customer_id, a.n AS n_p, b.n AS n_f FROM (SELECT customer_id, count(*) AS n FROM o WHERE status = 'P' GROUP BY 1) a FULL JOIN (SELECT customer_id, count(*) AS n FROM o WHERE status = 'F' GROUP BY 1) b ON a.customer_id = b.customer_id")
def join_full_outer(k: Lake) -> DataFrame:
    n = lambda s, c: k.orders.where(F.col("status") == s).groupBy("customer_id").agg(F.count("*").alias(c))
    return n("P", "n_p").join(n("F", "n_f"), "customer_id", "full")


@query("o", "SELECT d.day::DATE AS day, ch.channel FROM generate_series((SELECT min(order_ts)::DATE FROM o), (SELECT min(order_ts)::DATE FROM o) + INTERVAL 29 DAY, INTERVAL 1 DAY) d(day), (SELECT DISTINCT channel FROM o) ch")
def join_cross_spine(k: Lake) -> DataFrame:
    first = k.orders.agg(F.to_date(F.min("order_ts")).alias("d"))
    days = first.select(F.explode(F.sequence("d", F.date_add("d", 29))).alias("day"))
    return days.crossJoin(F.broadcast(k.orders.select("channel").distinct()))


@query("", "SELECT count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND abs(l_extendedprice - o_totalprice) <= 5000)")
def join_semi_exists(k: Lake) -> DataFrame:
    o, li = k.raw("orders"), k.raw("lineitem")
    return o.join(li, (o["o_orderkey"] == li["l_orderkey"]) & (F.abs(li["l_extendedprice"] - o["o_totalprice"]) <= 5000), "left_semi").agg(F.count("*").alias("n"))


@query("l p", "SELECT order_id, line_number, product_id FROM l WHERE product_id NOT IN (SELECT product_id FROM p)")
def join_anti_fk(k: Lake) -> DataFrame:
    return k.lines.join(k.products, "product_id", "left_anti").select("order_id", "line_number", "product_id")


@query("o", "SELECT a.order_id AS a_id, b.order_id AS b_id FROM o a JOIN o b ON a.customer_id = b.customer_id AND a.order_id < b.order_id AND a.order_ts < b.order_ts + INTERVAL 3 DAY AND b.order_ts < a.order_ts + INTERVAL 3 DAY")
def join_theta_overlap(k: Lake) -> DataFrame:
    """Orders of a customer within three days of each other: equal keys, range as residual."""
    a, b = k.orders.alias("a"), k.orders.alias("b")
    three = F.expr("interval 3 days")
    near = (F.col("a.order_ts") < F.col("b.order_ts") + three) & (F.col("b.order_ts") < F.col("a.order_ts") + three)
    return a.join(b, (F.col("a.customer_id") == F.col("b.customer_id")) & (F.col("a.order_id") < F.col("b.order_id")) & near).select(F.col("a.order_id").alias("a_id"), F.col("b.order_id").alias("b_id"))


@query("o", "SELECT n_name, x.n_customers FROM nation, LATERAL (SELECT count(*) AS n_customers FROM customer WHERE c_nationkey = n_nationkey) x WHERE x.n_customers > 0")
def join_lateral_df(k: Lake) -> DataFrame:
    counts = k.raw("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_customers"))
    return k.raw("nation").join(counts, "n_nationkey").select("n_name", "n_customers")


# -- aggregates -------------------------------------------------------------------


@query("pay", "SELECT payment_method, count(*) FILTER (is_captured) AS captured, sum(amount) FILTER (is_captured)::DOUBLE AS captured_amount, min(processed_ts) FILTER (is_failed) AS first_failure, round(avg(amount) FILTER (is_failed), 4)::DOUBLE AS avg_failed FROM pay GROUP BY 1")
def agg_filtered(k: Lake) -> DataFrame:
    a, c, f = F.col("amount"), F.col("is_captured"), F.col("is_failed")
    return k.payments.groupBy("payment_method").agg(F.count_if(c).alias("captured"), F.sum(F.when(c, a)).cast("double").alias("captured_amount"), F.min(F.when(f, F.col("processed_ts"))).alias("first_failure"), F.round(F.sum(F.when(f, a)).cast("double") / F.count_if(f), 4).alias("avg_failed"))


@query("pay", "SELECT payment_method, count(DISTINCT order_id) AS orders, count(DISTINCT order_id) FILTER (is_captured) AS captured_orders FROM pay GROUP BY 1")
def agg_distinct_filtered(k: Lake) -> DataFrame:
    return k.payments.groupBy("payment_method").agg(F.count_distinct("order_id").alias("orders"), F.count_distinct(F.when(F.col("is_captured"), F.col("order_id"))).alias("captured_orders"))


@query("pay", "SELECT order_id, bool_or(is_captured) AS any_captured, bool_and(is_failed) AS all_failed FROM pay GROUP BY 1")
def agg_bool(k: Lake) -> DataFrame:
    return k.payments.groupBy("order_id").agg(F.bool_or("is_captured").alias("any_captured"), F.bool_and("is_failed").alias("all_failed"))


@query("pay", "SELECT order_id, arg_min(payment_method, (processed_ts, attempt_number, seq)) AS first_method, arg_max(failure_reason, (processed_ts, attempt_number, seq)) FILTER (is_failed) AS last_reason FROM pay GROUP BY 1")
def agg_first_by(k: Lake) -> DataFrame:
    at = F.struct("processed_ts", "attempt_number", "seq")
    return k.payments.groupBy("order_id").agg(F.min_by("payment_method", at).alias("first_method"), F.max_by(F.when(F.col("is_failed"), F.col("failure_reason")), F.when(F.col("is_failed"), at)).alias("last_reason"))


@query("pay", "SELECT payment_method, arg_max(failure_reason, (n, failure_reason)) AS top_reason, '{' || string_agg('\"' || failure_reason || '\":' || n, ',' ORDER BY failure_reason) || '}' AS reasons FROM (SELECT payment_method, failure_reason, count(*) AS n FROM pay WHERE is_failed GROUP BY 1, 2) GROUP BY 1")
def agg_mode_json(k: Lake) -> DataFrame:
    n = k.payments.where("is_failed").groupBy("payment_method", "failure_reason").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("failure_reason", "n")))
    return n.groupBy("payment_method").agg(F.max_by("failure_reason", F.struct("n", "failure_reason")).alias("top_reason"), F.to_json(F.map_from_entries(entries)).alias("reasons"))


@query("t", "SELECT intent, round(quantile_cont(epoch(resolved_ts - created_ts) / 3600.0, 0.5), 4) AS median_hours, round(quantile_cont(epoch(resolved_ts - created_ts) / 3600.0, 0.5) FILTER (ticket_id % 2 = 0), 4) AS median_even FROM t GROUP BY 1")
def agg_median(k: Lake) -> DataFrame:
    h = S.hours_between(F.col("created_ts"), F.col("resolved_ts"))
    return k.tickets.withColumn("h", h).groupBy("intent").agg(F.round(F.median("h"), 4).alias("median_hours"), F.round(F.median(F.when(F.col("ticket_id") % 2 == 0, F.col("h"))), 4).alias("median_even"))


@query("", "SELECT conv_id, string_agg(role, '>' ORDER BY turn, role, text) AS roles, count(*) AS turns FROM conversations GROUP BY 1")
def agg_string(k: Lake) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return k.raw("conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["role"]), ">").alias("roles"), F.count("*").alias("turns"))


@query("o", "SELECT customer_id, sum(CASE WHEN status = 'F' THEN amount ELSE 0 END)::DOUBLE AS f, sum(CASE WHEN status = 'O' THEN amount ELSE 0 END)::DOUBLE AS o, sum(CASE WHEN status = 'P' THEN amount ELSE 0 END)::DOUBLE AS p FROM o GROUP BY 1")
def agg_pivot_case(k: Lake) -> DataFrame:
    wide = k.orders.groupBy("customer_id").pivot("status", ["F", "O", "P"]).agg(F.sum("amount"))
    return wide.select("customer_id", *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s.lower()) for s in "FOP"])


@query("l", "SELECT order_id, line_number, count(*) AS n FROM l GROUP BY 1, 2 HAVING count(*) > 2")
def agg_having(k: Lake) -> DataFrame:
    return k.lines.groupBy("order_id", "line_number").agg(F.count("*").alias("n")).where("n > 2")


@query("l", "SELECT sum(n)::BIGINT AS in_groups, (sum(n) - count(*))::BIGINT AS surplus FROM (SELECT count(*) AS n FROM l GROUP BY order_id, line_number HAVING count(*) > 1)")
def agg_surplus_rows(k: Lake) -> DataFrame:
    dup = k.lines.groupBy("order_id", "line_number").agg(F.count("*").alias("n")).where("n > 1")
    return dup.agg(F.sum("n").alias("in_groups"), (F.sum("n") - F.count("*")).alias("surplus"))


@query("o", "SELECT customer_id, CASE WHEN count(*) FILTER (recognised) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (status = 'F') / count(*) FILTER (recognised), 2) END AS nadd_pct FROM o GROUP BY 1")
def ratio_null_safe(k: Lake) -> DataFrame:
    return k.orders.groupBy("customer_id").agg(S.percent(F.count_if(F.col("status") == "F"), F.count_if(F.col("recognised"))).alias("nadd_pct"))


@query("o", "SELECT channel, round(sum(amount)::DOUBLE / count(*), 2) AS aov, count(*) AS orders FROM o WHERE recognised GROUP BY 1")
def recompute_vs_sum_ratio(k: Lake) -> DataFrame:
    """An average recomputed from sums of daily rows, never the sum of daily averages."""
    daily = k.orders.where("recognised").groupBy(F.to_date("order_ts").alias("day"), "channel").agg(F.sum("amount").alias("revenue"), F.count("*").alias("orders"))
    return daily.groupBy("channel").agg(S.ratio(F.sum("revenue"), F.sum("orders")).alias("aov"), F.sum("orders").alias("orders"))


@query("", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labelled, (SELECT count(DISTINCT source) FROM documents) AS sources")
def agg_scalar_row(k: Lake) -> DataFrame:
    d = k.raw("documents").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"))
    return d.crossJoin(F.broadcast(k.raw("labels").agg(F.count("*").alias("labelled")))).select("documents", "labelled", "sources")


# -- windows ----------------------------------------------------------------------


@query("o", "SELECT day, channel, round(avg(revenue) OVER (PARTITION BY channel ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS avg_7 FROM (SELECT order_ts::DATE AS day, channel, sum(amount)::DOUBLE AS revenue FROM o GROUP BY 1, 2)")
def win_rolling_7(k: Lake) -> DataFrame:
    daily = k.orders.groupBy(F.to_date("order_ts").alias("day"), "channel").agg(F.sum("amount").cast("double").alias("revenue"))
    return daily.select("day", "channel", F.round(F.avg("revenue").over(Window.partitionBy("channel").orderBy("day").rowsBetween(-6, 0)), 4).alias("avg_7"))


@query("ver dim", "SELECT customer_id, version, valid_from FROM dim")
def win_version(k: Lake) -> DataFrame:
    from tidewater.plans.marts import dim_customer_frame

    return dim_customer_frame(k).select("customer_id", "version", "valid_from")


@query("o", "SELECT DISTINCT ON (customer_id) customer_id, order_id FROM o ORDER BY customer_id, order_ts DESC, order_id DESC")
def win_distinct_on(k: Lake) -> DataFrame:
    return k.orders.groupBy("customer_id").agg(F.max_by("order_id", F.struct("order_ts", "order_id")).alias("order_id"))


@query("e", "WITH s AS (SELECT count(DISTINCT user_id) FILTER (event_type = 'view') AS view, count(DISTINCT user_id) FILTER (event_type = 'click') AS click, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS purchase FROM e), f AS (SELECT 1::BIGINT AS step_number, 'view' AS step, view AS sessions FROM s UNION ALL SELECT 2, 'click', click FROM s UNION ALL SELECT 3, 'purchase', purchase FROM s) SELECT *, round(100.0::DOUBLE * sessions / first_value(sessions) OVER (ORDER BY step_number), 2) AS pct_of_top, round(100.0::DOUBLE * sessions / lag(sessions) OVER (ORDER BY step_number), 2) AS pct_of_previous FROM f")
def win_funnel_pct_previous(k: Lake) -> DataFrame:
    steps = ["view", "click", "purchase"]
    return serving.funnel(k.events.agg(*[F.count_distinct(F.when(F.col("event_type") == s, F.col("user_id"))).alias(s) for s in steps]), steps)


# -- scalar functions -------------------------------------------------------------


@query("", "SELECT c_custkey, md5(c_custkey::VARCHAR || '|' || coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, '<null>')) AS key FROM customer")
def fn_surrogate_key(k: Lake) -> DataFrame:
    return k.raw("customer").select("c_custkey", S.surrogate_key(F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))).alias("key"))


@query("o", "SELECT DISTINCT order_ts::DATE AS d, strftime(order_ts, '%Y%m%d')::BIGINT AS date_key, isodow(order_ts)::BIGINT AS iso_dow, weekofyear(order_ts)::BIGINT AS iso_week, last_day(order_ts::DATE) AS month_end, monthname(order_ts) AS month_name, dayname(order_ts) AS day_name, date_trunc('quarter', order_ts)::DATE AS quarter_start FROM o")
def fn_calendar(k: Lake) -> DataFrame:
    d = F.col("d")
    days = k.orders.select(F.to_date("order_ts").alias("d")).distinct()
    return days.select("d", S.date_key(d).alias("date_key"), (F.weekday(d) + 1).cast("bigint").alias("iso_dow"), F.weekofyear(d).cast("bigint").alias("iso_week"), F.last_day(d).alias("month_end"), F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "EEEE").alias("day_name"), F.trunc(d, "quarter").alias("quarter_start"))


@query("o", "SELECT customer_id, datediff('month', min(order_ts)::DATE, max(order_ts)::DATE)::BIGINT AS months FROM o GROUP BY 1")
def fn_months_between(k: Lake) -> DataFrame:
    g = k.orders.groupBy("customer_id").agg(F.min("order_ts").alias("a"), F.max("order_ts").alias("b"))
    return g.select("customer_id", S.months_since(F.trunc("a", "month"), F.trunc("b", "month")).alias("months"))


@query("", "SELECT c_custkey, regexp_extract_all('order O' || lpad(c_custkey::VARCHAR, 7, '0') || ' of T000123, not O12', '\\b(O\\d{7})\\b', 1)[1] AS order_ref, len(regexp_extract_all(c_name || ' T000001 T000002', '\\b(T\\d{6})\\b', 1))::BIGINT AS n FROM customer")
def fn_regex_ids(k: Lake) -> DataFrame:
    text = F.concat(F.lit("order O"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"), F.lit(" of T000123, not O12"))
    return k.raw("customer").select("c_custkey", F.try_element_at(S.identifiers(text, "O", 7), F.lit(1)).alias("order_ref"), F.size(S.identifiers(F.concat("c_name", F.lit(" T000001 T000002")), "T", 6)).cast("bigint").alias("n"))


@query("e", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM e")
def fn_json_props(k: Lake) -> DataFrame:
    return k.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("", "SELECT 'T' || lpad((max(substring('T' || lpad(c_custkey::VARCHAR, 6, '0'), 2)::BIGINT) + 1)::VARCHAR, 6, '0') AS next_id FROM customer")
def fn_next_id_lpad(k: Lake) -> DataFrame:
    ids = k.raw("customer").select(F.concat(F.lit("T"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("id"))
    return ids.agg(S.next_id(F.col("id")).alias("next_id"))
