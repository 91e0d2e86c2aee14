"""Data quality as data: checks that return one row (scanned, failed), severities, tolerances, history."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, QUARANTINE, WARN = "BLOCK", "QUARANTINE", "WARN"
RESULT = "check string, severity string, scanned bigint, failed bigint, failure_pct double, status string"


@dataclass(frozen=True)
class Check:
    """``frame`` gives one row (scanned, failed); ``repro`` the offending rows."""

    name: str
    frame: Callable[[], DataFrame]
    severity: str = BLOCK
    max_failure_pct: float = 0.0
    repro: Callable[[], DataFrame] | None = None


def outcome(scanned: int, failed: int, max_failure_pct: float) -> tuple[float, str]:
    """Failure percentage and PASS or FAIL; nothing scanned passes; more failed than scanned is a broken check."""
    if failed > scanned:
        raise ValueError(f"{failed} failed of {scanned} scanned")
    pct = 100.0 * failed / scanned if scanned else 0.0
    return pct, "FAIL" if pct > max_failure_pct else "PASS"


def run(spark: SparkSession, checks: Sequence[Check]) -> DataFrame:
    """Results of all checks, passes too, as rows to append to a history."""
    rows = []
    for c in checks:
        got = c.frame().first()
        scanned, failed = int(got["scanned"] or 0), int(got["failed"] or 0)
        rows.append((c.name, c.severity, scanned, failed, *outcome(scanned, failed, c.max_failure_pct)))
    return spark.createDataFrame(rows, RESULT)


#: Offending rows that are kept of a failed check.
SAMPLE = 20


def samples(spark: SparkSession, failed: Sequence[Check], limit: int = SAMPLE) -> DataFrame | None:
    """``(check, row)`` for checks that failed and can show their rows: ``limit`` of each as JSON; none: None."""
    out = None
    for c in failed:
        if c.repro is not None:
            rows = c.repro()
            rows = rows.limit(limit).select(F.lit(c.name).alias("check"), F.to_json(F.struct(*rows.columns)).alias("row"))
            out = rows if out is None else out.union(rows)
    return out


# What a run's exit code tells.
EXIT_OK, EXIT_ERROR, EXIT_BLOCKED, EXIT_UPSTREAM = 0, 1, 2, 3


class QualityError(RuntimeError):
    """A blocking gate failed."""


def exit_code_of(error: BaseException | None) -> int:
    """The exit code of a run that ended so: a blocked gate, a source that can't be reached, any other error."""
    if error is None:
        return EXIT_OK
    if isinstance(error, QualityError):
        return EXIT_BLOCKED
    return EXIT_UPSTREAM if isinstance(error, (ConnectionError, TimeoutError)) else EXIT_ERROR


def exit_code(results: DataFrame, fail_on_warn: bool = False) -> int:
    """0 passed, 2 a blocking check failed (or a warning, if asked for)."""
    bad = [BLOCK, *[WARN, QUARANTINE] * fail_on_warn]
    return EXIT_BLOCKED if results.where((F.col("status") == "FAIL") & F.col("severity").isin(*bad)).limit(1).count() else EXIT_OK


def referential(child: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Non-null references without a parent."""
    keys = parent.select(F.col(parent_col).alias("_k")).distinct()
    return child.where(F.col(col).isNotNull()).join(keys, F.col(col) == F.col("_k"), "left").agg(F.count("*").alias("scanned"), F.count_if(F.col("_k").isNull()).alias("failed"))


def invariant(df: DataFrame, holds: Column, scope: Column | None = None) -> DataFrame:
    """Rows in scope where the predicate is false; where it is null it counts as holding."""
    return (df if scope is None else df.where(scope)).agg(F.count("*").alias("scanned"), F.count_if(~holds).alias("failed"))


def not_empty(df: DataFrame, minimum: int = 1) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(F.lit(1).cast("bigint").alias("scanned"), F.when(F.col("n") < minimum, 1).otherwise(0).cast("bigint").alias("failed"))


def unique_key(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.groupBy(*cols).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("scanned"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("failed"))


def accepted(df: DataFrame, col: str, values: Sequence[object]) -> DataFrame:
    return invariant(df, F.col(col).isin(*values), F.col(col).isNotNull())


def not_null(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count("*").alias("scanned"), F.count_if(F.col(col).isNull()).alias("failed"))


def freshness(log: DataFrame, step: str, status: str, done_at: str, now: Column, hours: float) -> DataFrame:
    """Steps whose latest success is older than ``hours``; a step that never succeeded is stale."""
    last = log.groupBy(step).agg(F.max(F.when(F.col(status) == "SUCCESS", F.col(done_at))).alias("last"))
    late = F.coalesce((F.unix_micros(now) - F.unix_micros(F.col("last").cast("timestamp"))) / F.lit(3.6e9) > hours, F.lit(True))
    return last.agg(F.count("*").alias("scanned"), F.count_if(late).alias("failed"))


def distribution(df: DataFrame, bounds: Sequence[tuple[str, Column, float | None, float | None]]) -> DataFrame:
    """``(measure, value, low, high, ok)`` for each (name, aggregate, low, high), all in one pass over the frame."""
    one = df.agg(*[c.cast("double").alias(n) for n, c, _, _ in bounds])
    inside = lambda c, low, high: (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high)
    rows = [F.struct(F.lit(n).alias("measure"), F.col(n).alias("value"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"), F.coalesce(inside(F.col(n), low, high), F.lit(False)).alias("ok")) for n, _, low, high in bounds]
    return one.select(F.inline(F.array(*rows)))


def latest_results(history: DataFrame, key: str, at: str) -> DataFrame:
    """The newest result of each check."""
    return history.groupBy(key).agg(F.max_by(F.struct(*[c for c in history.columns if c != key]), F.struct(at)).alias("_r")).select(key, "_r.*")


# How outcomes of transform tests count here.
STATUS = {"pass": ("PASS", BLOCK), "success": ("PASS", BLOCK), "fail": ("FAIL", BLOCK), "error": ("FAIL", BLOCK), "warn": ("FAIL", WARN), "skipped": ("FAIL", BLOCK), "runtime error": ("FAIL", BLOCK)}


def transform_status(status: str) -> tuple[str, str]:
    """What a transform tool's test status means; an unknown one blocks."""
    return STATUS.get(status, ("FAIL", BLOCK))
