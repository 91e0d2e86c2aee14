"""The catalogue's registry, and the entities of the data model over the given tables.

Orders stand for orders (priority as channel), lineitem for order lines and
payment attempts, part for products, customer for customers, events for web
events, documents for tickets and labels for their enrichment.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import spec
from tidewater.functions.scalar import money

# Lists, as both Python and the SQL below write them.
CHANNELS = list(spec.CHANNEL)
DEVICES = list(spec.DEVICE)
PRIORITIES = list(spec.PRIORITY)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Lake:
    """Typed frames of the tables of a folder."""

    #: The instant of the last snapshot of the customers.
    end = "2002-01-01 00:00:00"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def customer_inputs(self) -> list[str]:
        """Files that the customers' history is made of."""
        return [f"{self.folder}/{t}.parquet" for t in ("orders", "customer")]

    @cached_property
    def orders(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("timestamp").alias("order_ts"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("channel"), money(F.col("o_totalprice")).alias("amount"), (F.col("o_orderstatus") != "P").alias("recognised"))

    @cached_property
    def lines(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("line_number"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("decimal(12,2)").alias("quantity"), money(F.col("l_extendedprice")).alias("line_amount"), F.col("l_discount").alias("discount"))

    @cached_property
    def payments(self) -> DataFrame:
        """Attempts: returnflag A is captured, R failed, N authorized; the failure reason is the supplier modulo four."""
        li = self.raw("lineitem")
        failed = F.col("l_returnflag") == "R"
        return li.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("attempt_number"), F.col("l_linestatus").alias("payment_method"), F.col("l_returnflag").alias("status"), money(F.col("l_extendedprice")).alias("amount"), F.col("l_shipdate").cast("timestamp").alias("processed_ts"), failed.alias("is_failed"), (F.col("l_returnflag") == "A").alias("is_captured"), F.when(failed, F.concat(F.lit("reason_"), (F.col("l_suppkey") % 4).cast("string"))).alias("failure_reason"), F.col("l_partkey").alias("seq"))

    @cached_property
    def products(self) -> DataFrame:
        """Parts, but for every fiftieth, so that some lines have no product; cost is 0.6 of the price."""
        p = self.raw("part").where(F.col("p_partkey") % 50 != 0)
        return p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("category"), F.col("p_type").alias("subcategory"), money(F.col("p_retailprice")).alias("unit_price"), (money(F.col("p_retailprice")) * F.lit(6) / F.lit(10)).cast("decimal(18,2)").alias("unit_cost"))

    @cached_property
    def change_log(self) -> DataFrame:
        """Priority changes between a customer's orders as tier changes; every 97th customer is deleted 30 days after the last."""
        from pyspark.sql import Window

        w = Window.partitionBy("customer_id").orderBy("order_ts", "order_id")
        moved = self.orders.withColumn("old_value", F.lag("channel").over(w)).where("old_value <> channel")
        tiers = moved.select("customer_id", F.col("order_ts").alias("changed_at"), F.lit("loyalty_tier").alias("field"), "old_value", F.col("channel").alias("new_value"), F.col("order_id").alias("seq"))
        gone = self.orders.where("customer_id % 97 = 0").groupBy("customer_id").agg((F.max("order_ts") + F.expr("interval 30 days")).alias("changed_at"))
        return tiers.unionByName(gone.select("customer_id", "changed_at", F.lit("is_deleted").alias("field"), F.lit("false").alias("old_value"), F.lit("true").alias("new_value"), F.lit(0).cast("bigint").alias("seq")))

    @cached_property
    def customers(self) -> DataFrame:
        """Customers with orders: tier of the last, sign-up at the first."""
        last = self.orders.groupBy("customer_id").agg(F.max_by("channel", F.struct("order_ts", "order_id")).alias("loyalty_tier"), F.to_date(F.min("order_ts")).alias("signup_date"))
        c = self.raw("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation_id"), F.col("c_mktsegment").alias("segment"))
        return c.join(last, "customer_id").withColumn("is_deleted", (F.col("customer_id") % 97 == 0).cast("string"))

    @cached_property
    def events(self) -> DataFrame:
        """Events; channel and device are the user's."""
        e = self.raw("events")
        of_user = {c: F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % len(names) + 1).cast("int")) for c, names in (("channel", CHANNELS), ("device_type", DEVICES))}
        return e.select("event_id", F.col("ts").cast("timestamp").alias("event_ts"), "user_id", "event_type", "value", "props", *[v.alias(c) for c, v in of_user.items()])

    @cached_property
    def tickets(self) -> DataFrame:
        """Documents: created on day id mod 28, resolved after n_chars minutes unless divisible by 5; of the others the even ones are open."""
        d = self.raw("documents")
        priority = F.element_at(F.array(*map(F.lit, PRIORITIES)), (F.col("doc_id") % len(PRIORITIES) + 1).cast("int"))
        status = F.when(F.col("doc_id") % 5 != 0, "resolved").when(F.col("doc_id") % 2 == 0, "open").otherwise("pending")
        start = F.timestamp_add("DAY", (F.col("doc_id") % 28).cast("int"), F.to_timestamp(F.lit("2024-01-01 00:00:00")))
        return d.select(F.col("doc_id").alias("ticket_id"), "text", F.col("lang").alias("intent"), F.col("source").alias("contact_channel"), start.alias("created_ts"), F.when(F.col("doc_id") % 5 != 0, F.timestamp_add("MINUTE", F.col("n_chars").cast("int"), start)).alias("resolved_ts"), (F.col("doc_id") % 150).alias("customer_id"), priority.alias("priority"), status.alias("status"))

    @cached_property
    def enrichment(self) -> DataFrame:
        return self.raw("labels").select(F.col("doc_id").alias("ticket_id"), F.col("quality").cast("bigint").alias("ai_label"), F.col("toxic").cast("bigint").alias("truth"))


# The same entities in the oracle's SQL.
VIEWS = {
    "o": "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate::TIMESTAMP AS order_ts, o_orderstatus AS status, o_orderpriority AS channel, o_totalprice::DECIMAL(18,2) AS amount, o_orderstatus <> 'P' AS recognised FROM orders",
    "l": "SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line_number, l_partkey AS product_id, l_quantity::DECIMAL(12,2) AS quantity, l_extendedprice::DECIMAL(18,2) AS line_amount, l_discount AS discount FROM lineitem",
    "pay": "SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS attempt_number, l_linestatus AS payment_method, l_returnflag AS status, l_extendedprice::DECIMAL(18,2) AS amount, l_shipdate::TIMESTAMP AS processed_ts, l_returnflag = 'R' AS is_failed, l_returnflag = 'A' AS is_captured, CASE WHEN l_returnflag = 'R' THEN 'reason_' || (l_suppkey % 4)::VARCHAR END AS failure_reason, l_partkey AS seq FROM lineitem",
    "p": "SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS category, p_type AS subcategory, p_retailprice::DECIMAL(18,2) AS unit_price, round(p_retailprice::DECIMAL(18,2) * 0.6, 2)::DECIMAL(18,2) AS unit_cost FROM part WHERE p_partkey % 50 <> 0",
    "log": "SELECT customer_id, order_ts AS changed_at, 'loyalty_tier' AS field, old_value, channel AS new_value, order_id AS seq FROM (SELECT *, lag(channel) OVER (PARTITION BY customer_id ORDER BY order_ts, order_id) AS old_value FROM o) WHERE old_value <> channel UNION ALL SELECT customer_id, max(order_ts) + INTERVAL 30 DAY, 'is_deleted', 'false', 'true', 0 FROM o WHERE customer_id % 97 = 0 GROUP BY customer_id",
    "c": "SELECT c_custkey AS customer_id, c_name AS name, c_nationkey AS nation_id, c_mktsegment AS segment, loyalty_tier, signup_date, (c_custkey % 97 = 0)::VARCHAR AS is_deleted FROM customer JOIN (SELECT customer_id, arg_max(channel, (order_ts, order_id)) AS loyalty_tier, min(order_ts)::DATE AS signup_date FROM o GROUP BY customer_id) ON customer_id = c_custkey",
    "e": f"SELECT event_id, ts::TIMESTAMP AS event_ts, user_id, event_type, value, props, {CHANNELS}[user_id % 6 + 1] AS channel, {DEVICES}[user_id % 3 + 1] AS device_type FROM events",
    "t": f"SELECT {PRIORITIES}[doc_id % 4 + 1] AS priority, CASE WHEN doc_id % 5 <> 0 THEN 'resolved' WHEN doc_id % 2 = 0 THEN 'open' ELSE 'pending' END AS status, doc_id AS ticket_id, text, lang AS intent, source AS contact_channel, TIMESTAMP '2024-01-01' + to_days((doc_id % 28)::INTEGER) AS created_ts, CASE WHEN doc_id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((doc_id % 28)::INTEGER) + to_minutes(n_chars) END AS resolved_ts, doc_id % 150 AS customer_id FROM documents",
    "en": "SELECT doc_id AS ticket_id, quality::BIGINT AS ai_label, toxic::BIGINT AS truth FROM labels",
    # The history as a snapshot at every instant of the whole log would record it: customers x instants, then changes.
    "inst": "SELECT DISTINCT changed_at AS moment FROM log UNION SELECT TIMESTAMP '2002-01-01'",
    "tl": "SELECT customer_id, changed_at, arg_max(new_value, seq) AS v FROM log WHERE field = 'loyalty_tier' GROUP BY ALL",
    "tf": "SELECT customer_id, arg_min(old_value, (changed_at, seq)) AS v0 FROM log WHERE field = 'loyalty_tier' GROUP BY ALL",
    "snap": "SELECT c.customer_id, i.moment, c.segment, coalesce(tl.v, tf.v0, c.loyalty_tier) AS loyalty_tier, coalesce(i.moment >= d.changed_at, false) AS gone FROM c JOIN inst i ON c.signup_date <= i.moment::DATE ASOF LEFT JOIN tl ON c.customer_id = tl.customer_id AND i.moment >= tl.changed_at LEFT JOIN tf ON tf.customer_id = c.customer_id LEFT JOIN (SELECT customer_id, changed_at FROM log WHERE field = 'is_deleted') d ON d.customer_id = c.customer_id",
    "live": "SELECT customer_id, moment, gone, last_value(CASE WHEN NOT gone THEN loyalty_tier END IGNORE NULLS) OVER w AS loyalty_tier, last_value(CASE WHEN NOT gone THEN segment END IGNORE NULLS) OVER w AS segment, max(CASE WHEN NOT gone THEN 1 END) OVER w AS seen FROM snap WINDOW w AS (PARTITION BY customer_id ORDER BY moment)",
    "ver": "SELECT customer_id, loyalty_tier, segment, moment AS opened_at, gone AS is_tombstone FROM (SELECT *, lag(moment) OVER w AS before_at, lag(loyalty_tier) OVER w AS lt, lag(segment) OVER w AS sg, lag(gone) OVER w AS gn FROM live WHERE seen = 1 WINDOW w AS (PARTITION BY customer_id ORDER BY moment)) WHERE before_at IS NULL OR lt <> loyalty_tier OR sg <> segment OR gn <> gone",
    "dim": "SELECT md5(customer_id::VARCHAR || '|' || version::VARCHAR) AS customer_key, customer_id, loyalty_tier, segment, version, CASE WHEN version = 1 THEN TIMESTAMP '1900-01-01' ELSE opened_at END AS valid_from, coalesce(nxt, TIMESTAMP '9999-12-31') AS valid_to, nxt IS NULL AS is_current, is_tombstone FROM (SELECT *, row_number() OVER w AS version, lead(opened_at) OVER w AS nxt FROM ver WINDOW w AS (PARTITION BY customer_id ORDER BY opened_at))",
    "ses": "SELECT *, user_id::VARCHAR || '-' || sum(fresh) OVER (PARTITION BY user_id ORDER BY event_ts, event_id)::BIGINT::VARCHAR AS session_id FROM (SELECT *, CASE WHEN event_ts - lag(event_ts) OVER (PARTITION BY user_id ORDER BY event_ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e)",
}
NEEDS = {"log": "o", "c": "o", "inst": "log", "tl": "log", "tf": "log", "snap": "c inst tl tf log", "live": "snap", "ver": "live", "dim": "ver", "ses": "e"}


def views(names: str) -> list[str]:
    out: list[str] = []
    for n in names.split():
        out += [x for x in [*views(NEEDS.get(n, "")), n] if x not in out]
    return out


def query(uses: str = "", sql: str | None = None) -> Callable:
    """Register a function of a ``Lake``, with its SQL over the views it names."""

    def add(f: Callable[[Lake], DataFrame]) -> Callable[[Lake], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Lake(spark, folder))
        if sql:
            body = sql.strip()
            with_ = ", ".join(f"{n} AS ({VIEWS[n]})" for n in views(uses))
            glue = ", " + body[5:] if body.startswith("WITH ") else " " + body
            SQL[f.__name__] = (f"WITH {with_}" + glue) if with_ else body
        return f

    return add
