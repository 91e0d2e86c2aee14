"""The batch run: capture, conform with gates, load, check, in one order for all entities."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import conform, quality, suites
from tidewater.operators.materialise import written
from tidewater.operators.quality import QualityError
from tidewater.sources import readers, writers
from tidewater.spec import ENTITIES, Entity

#: A build with more rejected rows than this share (per cent) is stopped.
MAX_QUARANTINE_PCT = 10.0


def gates(judged: DataFrame, captured: int, spec: Entity) -> list[tuple]:
    """Result rows of a build: one for each reason, one for duplicates, one for the rate of rejects."""
    counts = {r["_quarantine_reason"]: r["count"] for r in judged.groupBy("_quarantine_reason").count().collect()}  # as many rows as rules
    kept = sum(counts.values())
    bad = kept - counts.pop(None, 0)
    rows = [(f"{spec.name}:{reason}", quality.QUARANTINE, kept, n, *quality.outcome(kept, n, 0)) for reason, n in sorted(counts.items())]
    rows.append((f"{spec.name}:duplicates", quality.WARN, captured, captured - kept, *quality.outcome(captured, captured - kept, 0)))
    rows.append((f"{spec.name}:quarantine_rate", quality.BLOCK, kept, bad, *quality.outcome(kept, bad, MAX_QUARANTINE_PCT)))
    return rows


def build_silver(spark: SparkSession, root: str, spec: Entity, results: str) -> int:
    """Conform one entity from all its sources; the judged rows are written once and split from there. Returns the rows kept."""
    paths = [f"{root}/bronze/{s}/{spec.name}" for s in (spec.source, *spec.also_from)]
    bronze = readers.parquet(spark, *paths).drop("ingest_date")
    captured = bronze.count()
    judged = written(conform.judge(bronze, spec), f"judged-{spec.name}")
    rows = gates(judged, captured, spec)
    writers.append_log(spark, rows, quality.RESULT, results)
    if any(r[1] == quality.BLOCK and r[5] == "FAIL" for r in rows):
        raise QualityError(f"{spec.name}: too many rejected rows")
    writers.rebuild(conform.good_rows(judged, spec), path := f"{root}/silver/{spec.name}")
    writers.quarantine(conform.quarantined(judged), f"{root}/quarantine/{spec.name}")
    return spark.read.parquet(path).count()


def run(spark: SparkSession, root: str, captures: dict[str, DataFrame], now: Callable[[], datetime], batch: str = "batch") -> dict[str, int]:
    """Capture each entity from its owner, then build each; steps and checks are logged, an error stops the run after its log row."""
    log, results, out = f"{root}/meta/runs", f"{root}/meta/checks", {}
    for name, df in captures.items():
        spec = ENTITIES[name]

        def capture(df: DataFrame = df, spec: Entity = spec) -> int:
            path = writers.bronze(df, root, spec.source, spec.name, batch, "capture", now(), [df.columns[0]])
            return spark.read.parquet(path).count()

        writers.logged_run(spark, log, f"ingest:{name}", capture, now)
    for name in captures:

        def build(name: str = name) -> int:
            out[name] = build_silver(spark, root, ENTITIES[name], results)
            return out[name]

        writers.logged_run(spark, log, f"silver:{name}", build, now)
    return out


def check(spark: SparkSession, root: str, now: Callable[[], datetime]) -> DataFrame:
    """Run the declared checks over the silver tables that there are and the run log; results go to the history, then a failed blocking one raises."""
    log, results = f"{root}/meta/runs", f"{root}/meta/checks"
    rows: list[DataFrame] = []

    def work() -> int:
        tables = {name: spark.read.parquet(f"{root}/silver/{name}") for name in ENTITIES if readers.exists(spark, f"{root}/silver/{name}")}
        rows.append(got := quality.run(spark, suites.declared(tables, spark.read.parquet(log), F.lit(now()))))
        writers.append_log(spark, [tuple(r) for r in got.collect()], quality.RESULT, results)  # a row a check
        if quality.exit_code(got):
            raise QualityError("a blocking check failed")
        return got.count()

    writers.logged_run(spark, log, "dq:declared", work, now)
    return rows[0]


def reconciled(spark: SparkSession, root: str, results: str) -> DataFrame:
    """Latest outcome of each check of a run's history."""
    h = spark.read.parquet(results).withColumn("at", F.monotonically_increasing_id())
    return quality.latest_results(h, "check", "at")


def topic_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``(topic, expected_partitions, actual_partitions, state)``: missing, unexpected, different or ok."""
    e = expected.select("topic", F.col("partitions").alias("expected_partitions"))
    a = actual.select("topic", F.col("partitions").alias("actual_partitions"))
    state = F.when(F.col("actual_partitions").isNull(), "missing").when(F.col("expected_partitions").isNull(), "unexpected").when(F.col("expected_partitions") != F.col("actual_partitions"), "different").otherwise("ok")
    return e.join(a, "topic", "full").withColumn("state", state)


def evaluation_rows(ranked: DataFrame, run_id: str) -> DataFrame:
    """One row a question with its ranked chunks as a JSON payload, to append to an evaluation log."""
    found = F.array_sort(F.collect_list(F.struct("rank", "id", "score")))
    return ranked.groupBy("query_id").agg(F.to_json(found).alias("payload")).withColumn("run_id", F.lit(run_id))
