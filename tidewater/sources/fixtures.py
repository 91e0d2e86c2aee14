"""Deterministic retail data for tests and demonstrations, with defects planted at known rates.

Everything derives from hashes of row numbers and a seed, so a table of any size
is made in parallel and comes out the same each time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import spec

ANCHOR = "2026-08-01"


def pick(values: Sequence[str], *by: Column | str) -> Column:
    """One of the values, by a hash."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(*by), F.lit(len(values))) + 1).cast("int"))


def spread(n: int, *by: Column | str) -> Column:
    """A number from 0 to n - 1, by a hash."""
    return F.pmod(F.xxhash64(*by), F.lit(n))


class Generator:
    """Tables of the data model for a seed, an anchor date, months of history and numbers of customers and products."""

    def __init__(self, spark: SparkSession, seed: int = 7, anchor: str = ANCHOR, months: int = 24, customers: int = 300, products: int = 60) -> None:
        self.spark, self.seed, self.anchor, self.days = spark, F.lit(seed), F.lit(anchor).cast("date"), 30 * months
        self.n_customers, self.n_products = customers, products

    def _rows(self, n: int, what: str) -> DataFrame:
        return self.spark.range(1, n + 1).withColumn("h", F.xxhash64("id", self.seed, F.lit(what)))

    def _id(self, prefix: str, width: int, number: Column) -> Column:
        return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))

    def customers(self) -> DataFrame:
        signup = F.date_sub(self.anchor, (spread(self.days, "h", F.lit("signup"))).cast("int"))
        return self._rows(self.n_customers, "customer").select(self._id("C", 6, F.col("id")).alias("customer_id"), pick(["London", "Lyon", "Berlin", "Madrid"], "h").alias("city"), pick(["GB", "FR", "DE", "ES"], "h").alias("country"), signup.alias("signup_date"), pick(spec.TIER, "h", F.lit("t")).alias("loyalty_tier"), pick(spec.SEGMENT, "h", F.lit("s")).alias("segment"), F.lit(False).alias("is_deleted"), signup.cast("timestamp").alias("updated_at"))

    def products(self) -> DataFrame:
        price = (spread(9900, "h", F.lit("p")) + 100) / 100
        return self._rows(self.n_products, "product").select(self._id("P", 5, F.col("id")).alias("product_id"), self._id("SKU", 5, F.col("id")).alias("sku"), F.concat(F.lit("product "), "id").alias("product_name"), pick(["home", "garden", "toys"], "h").alias("category"), pick(["a", "b"], "h", F.lit("sub")).alias("subcategory"), price.cast("decimal(12,2)").alias("unit_price"), (price * 0.57).cast("decimal(12,2)").alias("unit_cost"), (spread(10, "h", F.lit("act")) > 0).alias("is_active"))

    def order_items(self, orders: int) -> DataFrame:
        """One to three lines an order; prices are the products'."""
        rows = self._rows(orders, "order").select(self._id("O", 7, F.col("id")).alias("order_id"), "h", F.explode(F.sequence(F.lit(1), (spread(3, "h", F.lit("n")) + 1).cast("int"))).alias("line_number"))
        lines = rows.select("order_id", "line_number", self._id("P", 5, spread(self.n_products, "h", "line_number") + 1).alias("product_id"), (spread(4, "h", "line_number", F.lit("q")) + 1).cast("int").alias("quantity"))
        got = lines.join(F.broadcast(self.products().select("product_id", "unit_price")), "product_id")  # as many rows as the generator's products
        return got.select(F.concat_ws("-", "order_id", "line_number").alias("order_item_id"), "order_id", "line_number", "product_id", "quantity", "unit_price", (F.col("quantity") * F.col("unit_price")).cast("decimal(12,2)").alias("line_amount"))

    def orders(self, n: int) -> DataFrame:
        """Headers whose gross amount is the sum of their lines."""
        gross = self.order_items(n).groupBy("order_id").agg(F.sum("line_amount").cast("decimal(12,2)").alias("gross_amount"))
        ts = F.timestamp_seconds(F.unix_timestamp(self.anchor.cast("timestamp")) - spread(86_400 * self.days, "h", F.lit("ts")))
        head = self._rows(n, "order").select(self._id("O", 7, F.col("id")).alias("order_id"), self._id("C", 6, spread(self.n_customers, "h", F.lit("c")) + 1).alias("customer_id"), ts.alias("order_ts"), pick(spec.ORDER_STATUS, "h", F.lit("st")).alias("status"), pick(spec.CHANNEL, "h", F.lit("ch")).alias("channel"), pick(spec.DEVICE, "h", F.lit("d")).alias("device_type"))
        zero = F.lit(0).cast("decimal(12,2)")
        return head.join(gross, "order_id").select("order_id", "customer_id", "order_ts", F.to_date("order_ts").alias("order_date"), "status", "channel", "device_type", "gross_amount", zero.alias("discount_amount"), zero.alias("shipping_amount"), zero.alias("tax_amount"), F.col("gross_amount").alias("total_amount"))

    def payments(self, orders: int) -> DataFrame:
        o = self.orders(orders).select("order_id", "order_ts", "total_amount", F.xxhash64("order_id", self.seed).alias("h"))
        status = pick(spec.PAYMENT_STATUS, "h", F.lit("ps"))
        return o.select(F.concat(F.lit("PAY"), F.substring("order_id", 2, 7)).alias("payment_id"), "order_id", F.lit(1).alias("attempt_number"), pick(spec.PAYMENT_METHOD, "h").alias("payment_method"), status.alias("status"), F.col("total_amount").alias("amount"), (F.col("order_ts") + F.expr("interval 5 minutes")).alias("processed_ts"), F.when(status == "failed", pick(["declined", "expired"], "h", F.lit("r"))).alias("failure_reason"))


# What a defect looks like.
BAD_ENUM = ("UNKNOWN", "n/a", "PENDING_REVIEW", "")
BAD_DATE = ("2026-13-45", "not-a-date", "31/02/2026", "")


def with_defects(df: DataFrame, entity: spec.Entity, permille: int = 18, duplicate_permille: int = 6) -> DataFrame:
    """``df`` as text with defects: missing values, unknown words, negative numbers, impossible dates, repeated rows.

    A hash of the key chooses the rows and the kind, so the same rows are spoilt
    each time; ``_defect`` names what was done (null: nothing).
    """
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    h = F.xxhash64(*entity.key, F.lit("defect"))
    kinds: list[tuple[str, str, Column]] = []
    for f in entity.fields:
        if f.name not in df.columns:
            continue
        if not f.nullable and f.name not in entity.key:
            kinds.append(("missing", f.name, F.lit(None).cast("string")))
        if f.allowed:
            kinds.append(("bad_enum", f.name, pick(BAD_ENUM, h)))
        if f.minimum is not None and f.kind.startswith("decimal"):
            kinds.append(("negative", f.name, F.concat(F.lit("-"), F.col(f.name))))
        if f.kind in ("date", "timestamp"):
            kinds.append(("bad_date", f.name, pick(BAD_DATE, h)))
    chosen = F.when(F.pmod(h, F.lit(1000)) < permille, F.pmod(F.shiftright(h, 12), F.lit(len(kinds))).cast("int"))
    marked = text.withColumn("_kind", chosen)
    spoilt = {c: F.col(c) for c in df.columns}
    for i, (_, name, value) in enumerate(kinds):
        spoilt[name] = F.when(F.col("_kind") == i, value).otherwise(spoilt[name])
    label = F.when(F.col("_kind").isNotNull(), F.element_at(F.array(*[F.lit(f"{a}:{b}") for a, b, _ in kinds]), F.col("_kind") + 1))
    out = marked.select(*[c.alias(n) for n, c in spoilt.items()], label.alias("_defect"))
    again = out.where(F.pmod(F.xxhash64(*entity.key, F.lit("twice")), F.lit(1000)) < duplicate_permille)
    return out.unionByName(again)


def corrupted(message: bytes, how: int) -> bytes:
    """A stream message made unreadable: 0 no Avro, 1 cut short, 2 another schema's fingerprint."""
    return (b"not avro", message[:-3], message[:2] + bytes(8) + message[10:])[how % 3]
