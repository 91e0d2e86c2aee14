"""Gold from the silver tables, and the whole batch in order of dependence.

``Silver`` shows silver tables as the frames that facts and marts are built from.
``batch`` declares the steps of a run (capture, conform, checks, dimensions,
facts, marts, checks over them, the text index), each with what it needs.
``execute`` runs them so that every step comes after its needs; a step that has
succeeded for the batch isn't run again, so a run that failed goes on from the
first step without a success, and a failed step leaves later tables alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import cached_property
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import analyse
from tidewater.operators import quality as Q
from tidewater.operators import suites
from tidewater.operators.textindex import Outcome, TextIndex
from tidewater.plans import marts, medallion
from tidewater.plans.base import Lake
from tidewater.sources import readers, writers
from tidewater.spec import ENTITIES

# Orders that never become revenue.
NO_REVENUE = ("cancelled", "returned")


class Silver(Lake):
    """The frames of a ``Lake`` from the silver tables under a root, customers as of the end of ``day``."""

    def __init__(self, spark: SparkSession, root: str, day: date) -> None:
        super().__init__(spark, root)
        self.end = f"{day + timedelta(days=1)} 00:00:00"

    def silver(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/silver/{name}")

    def inputs(self, *names: str) -> list[str]:
        return [p for n in names if readers.exists(self.spark, p := f"{self.folder}/silver/{n}")]

    @property
    def customer_inputs(self) -> list[str]:
        return self.inputs("customers", "customer_change_log")

    @cached_property
    def orders(self) -> DataFrame:
        o = self.silver("orders")
        return o.select("order_id", "customer_id", "order_ts", "status", "channel", F.col("total_amount").cast("decimal(18,2)").alias("amount"), (~F.col("status").isin(*NO_REVENUE)).alias("recognised"))

    @cached_property
    def lines(self) -> DataFrame:
        li = self.silver("order_items")
        return li.select("order_id", F.col("line_number").cast("bigint").alias("line_number"), "product_id", F.col("quantity").cast("decimal(12,2)").alias("quantity"), F.col("line_amount").cast("decimal(18,2)").alias("line_amount"))

    @cached_property
    def payments(self) -> DataFrame:
        p = self.silver("payments")
        return p.select(
            "order_id", F.col("attempt_number").cast("bigint").alias("attempt_number"), "payment_method", "status", F.col("amount").cast("decimal(18,2)").alias("amount"), F.col("processed_ts"),
            (F.col("status") == "failed").alias("is_failed"), (F.col("status") == "captured").alias("is_captured"), F.col("failure_reason"), F.col("payment_id").alias("seq"),
        )

    @cached_property
    def products(self) -> DataFrame:
        p = self.silver("products")
        return p.select("product_id", "product_name", "category", "subcategory", *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("unit_price", "unit_cost")])

    @cached_property
    def customers(self) -> DataFrame:
        c = self.silver("customers")
        return c.select("customer_id", "loyalty_tier", "segment", "signup_date", F.col("is_deleted").cast("string").alias("is_deleted"))

    @cached_property
    def change_log(self) -> DataFrame:
        schema = "customer_id string, changed_at timestamp, field string, old_value string, new_value string, seq bigint"
        if not self.inputs("customer_change_log"):
            return self.spark.createDataFrame([], schema)
        log = self.silver("customer_change_log")
        return log.select("customer_id", "changed_at", "field", "old_value", "new_value", F.xxhash64("field", "old_value", "new_value").alias("seq"))


#: Each gold table, the silver tables that it needs, and how it is built.
GOLD: dict[str, tuple[tuple[str, ...], Callable[[Lake], DataFrame]]] = {
    "dim_customer": (("customers",), marts.dim_customer),
    "dim_product": (("products",), marts.dim_product),
    "fact_orders": (("customers", "orders", "order_items", "payments"), marts.fact_orders),
    "fact_order_items": (("customers", "orders", "order_items", "products"), marts.fact_order_items),
    "fact_payments": (("customers", "orders", "payments"), marts.fact_payments),
    "mart_daily_sales": (("orders",), marts.mart_daily_sales),
    "mart_customer_rfm": (("customers", "orders"), marts.mart_customer_rfm),
    "mart_cohort_retention": (("orders",), marts.mart_cohort_retention),
    "mart_product_performance": (("orders", "order_items", "products"), marts.mart_product_performance),
    "mart_payment_health": (("payments",), marts.mart_payment_health),
}
# What identifies a row of gold, and what its rows must refer to.
KEYS = {"dim_customer": ["customer_key"], "dim_product": ["product_key"], "fact_orders": ["order_id"], "fact_order_items": ["order_id", "line_number"], "mart_daily_sales": ["date", "channel"], "mart_customer_rfm": ["customer_id"]}
REFERENCES = [("fact_orders", "customer_key", "dim_customer"), ("fact_order_items", "customer_key", "dim_customer"), ("fact_order_items", "product_key", "dim_product"), ("fact_payments", "customer_key", "dim_customer")]


def gold_checks(tables: dict[str, DataFrame]) -> list[Q.Check]:
    """Checks of the gold tables that there are: not empty, keys, references, one current version, revenue of facts and marts."""
    out = [Q.Check(f"{t}:not_empty", lambda t=t: Q.not_empty(tables[t])) for t in tables]
    out += [Q.Check(f"{t}:unique", lambda t=t, k=k: Q.unique_key(tables[t], k), repro=lambda t=t, k=k: tables[t].groupBy(*k).count().where("count > 1")) for t, k in KEYS.items() if t in tables]
    out += [Q.Check(f"{a}.{c}->{b}", lambda a=a, c=c, b=b: Q.referential(tables[a], c, tables[b], c), repro=lambda a=a, c=c, b=b: tables[a].where(F.col(c).isNotNull()).join(tables[b], c, "left_anti")) for a, c, b in REFERENCES if {a, b} <= tables.keys()]
    if "dim_customer" in tables:
        current = lambda: tables["dim_customer"].groupBy("customer_id").agg(F.count_if("is_current").alias("n"))
        out.append(Q.Check("dim_customer:one_current", lambda: Q.invariant(current(), F.col("n") == 1), repro=lambda: current().where("n <> 1")))
    if {"fact_orders", "mart_daily_sales"} <= tables.keys():

        def revenue() -> DataFrame:
            total = lambda t, c: tables[t].agg(F.sum(F.col(c).cast("decimal(38,2)")).alias(c))
            one = total("fact_orders", "recognised_amount").crossJoin(F.broadcast(total("mart_daily_sales", "revenue")))  # a row each
            return Q.invariant(one, F.col("recognised_amount") == F.col("revenue"))

        out.append(Q.Check("mart_daily_sales:revenue_of_facts", revenue))
    return out


@dataclass(frozen=True)
class Step:
    name: str
    needs: tuple[str, ...]
    work: Callable[[], int]


def succeeded(spark: SparkSession, log: str, batch: str) -> set[str]:
    """Steps of a batch that have a success."""
    if not readers.exists(spark, log):
        return set()
    runs = spark.read.schema(writers.RUN_LOG).parquet(log)
    return {r[0] for r in runs.where((F.col("status") == "SUCCESS") & F.col("run_id").startswith(f"{batch}:")).select("step").distinct().collect()}


def execute(spark: SparkSession, root: str, steps: Iterable[Step], batch: str, now: Callable[[], datetime]) -> list[str]:
    """Run what the batch still lacks, needs first; gives the names of the steps that ran."""
    log, by_name = f"{root}/meta/runs", {s.name: s for s in steps}
    order = TopologicalSorter({s.name: [n for n in s.needs if n in by_name] for s in by_name.values()}).static_order()
    done, ran = succeeded(spark, log, batch), []
    for name in order:
        if name not in done:
            writers.logged_run(spark, log, name, by_name[name].work, now, batch)
            ran.append(name)
    return ran


def checked(spark: SparkSession, root: str, checks: list[Q.Check]) -> int:
    """Run checks, append results and the rows that failed ones offer; a failed blocking check raises."""
    got = Q.run(spark, checks)
    writers.append_log(spark, [tuple(r) for r in got.collect()], Q.RESULT, f"{root}/meta/checks")  # a row a check
    failed = {r["check"] for r in got.where("status = 'FAIL'").collect()}
    samples = Q.samples(spark, [c for c in checks if c.name in failed])
    if samples is not None:
        samples.write.mode("append").parquet(f"{root}/meta/check_rows")
    if Q.exit_code(got):
        raise Q.QualityError("a blocking check failed")
    return len(checks)


def batch(spark: SparkSession, root: str, captures: dict[str, DataFrame], now: Callable[[], datetime], name: str = "batch", declared: Callable[..., list[Q.Check]] = suites.declared) -> list[Step]:
    """The steps of a batch over the entities captured; ``declared`` gives the checks over silver."""
    steps = []
    for entity, df in captures.items():
        spec = ENTITIES[entity]

        def capture(df: DataFrame = df, spec=spec) -> int:  # noqa: ANN001
            path = writers.bronze(df, root, spec.source, spec.name, name, "capture", now(), [df.columns[0]])
            return spark.read.parquet(path).count()

        steps.append(Step(f"ingest:{entity}", (), capture))
        steps.append(Step(f"silver:{entity}", (f"ingest:{entity}",), lambda spec=spec: medallion.build_silver(spark, root, spec, f"{root}/meta/checks")))

    def silver_checks() -> int:
        tables = {n: spark.read.parquet(f"{root}/silver/{n}") for n in ENTITIES if readers.exists(spark, f"{root}/silver/{n}")}
        return checked(spark, root, declared(tables, spark.read.parquet(f"{root}/meta/runs"), F.lit(now())))

    steps.append(Step("dq:silver", tuple(f"silver:{e}" for e in captures), silver_checks))
    there = {g: build for g, (needs, build) in GOLD.items() if set(needs) <= captures.keys()}
    for g, build in there.items():

        def make(g: str = g, build: Callable[[Lake], DataFrame] = build) -> int:
            writers.rebuild(build(Silver(spark, root, now().date())), path := f"{root}/gold/{g}")
            return spark.read.parquet(path).count()

        steps.append(Step(f"gold:{g}", ("dq:silver",), make))
    steps.append(Step("dq:gold", tuple(f"gold:{g}" for g in there), lambda: checked(spark, root, gold_checks({g: spark.read.parquet(f"{root}/gold/{g}") for g in there}))))
    if "support_tickets" in captures:
        steps.append(Step("index", ("dq:silver",), lambda: index_tickets(spark, root).chunks))
    return steps


def index_tickets(spark: SparkSession, root: str, size: int = 220, overlap: int = 40) -> Outcome:
    """Bring the index of chunks up to the tickets in silver."""
    from tidewater.operators.textindex import fingerprint

    t = spark.read.parquet(f"{root}/silver/support_tickets")
    text = F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    parts = t.select(F.col("ticket_id").alias("doc_id"), F.inline(analyse.chunks(text, size, overlap)))
    units = parts.select("doc_id", F.concat_ws("#", "doc_id", F.col("ordinal").cast("string")).alias("id"), "content")
    return TextIndex(spark, f"{root}/index").refresh(units, fp=fingerprint(size=size, overlap=overlap), model="none")
