"""Sinks: append-only capture, rebuilt tables, quarantine, reconciled loads, upserts of files, logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.conform import upsert, with_lineage
from tidewater.spec import check_names, check_owner


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def swap_in(spark: SparkSession, staged: str, path: str) -> None:
    """Put a staged folder in a table's place; the old contents go only when the new ones are whole."""
    fs, target = _fs(spark, path)
    _, source = _fs(spark, staged)
    _, old = _fs(spark, f"{path}.old-{uuid.uuid4().hex}")
    if fs.exists(target):
        fs.rename(target, old)
    else:
        fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        if fs.exists(old):
            fs.rename(old, target)
        raise OSError(f"{staged} can't be moved to {path}")
    fs.delete(old, True)


def bronze(df: DataFrame, root: str, source: str, entity: str, run_id: str, source_file: str, at: datetime, order_by: Sequence[str]) -> str:
    """Append a capture with its lineage under ``bronze/source/entity/ingest_date=...``; returns that table's path."""
    check_names(source, entity)
    check_owner(source, entity)
    path = f"{root}/bronze/{source}/{entity}"
    rows = with_lineage(df, run_id, source, source_file, F.lit(at), order_by).withColumn("ingest_date", F.lit(at.date()))
    rows.write.mode("append").option("compression", "zstd").partitionBy("ingest_date").parquet(path)
    return path


def rebuild(df: DataFrame, path: str) -> None:
    """Replace a table by a new generation; readers see the old or the new one, never a mixture."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(staged := f"{path}.new-{uuid.uuid4().hex}")
    swap_in(spark, staged, path)


def quarantine(df: DataFrame, path: str) -> bool:
    """Write this build's rejected rows in place of the last build's, none as well; tells whether there were any."""
    rebuild(df, path)
    return not df.sparkSession.read.schema(df.schema).parquet(path).isEmpty()


def load_reconciled(df: DataFrame, path: str, expected_schema: str) -> int:
    """Truncate and load: the schema must be the declared one and the rows written as many as read, else the old contents stay."""
    from pyspark.sql.types import StructType

    spark = df.sparkSession
    want = StructType.fromDDL(expected_schema)
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in want]:
        raise TypeError(f"{df.schema.simpleString()} is not {want.simpleString()}")
    n = df.count()
    df.write.parquet(staged := f"{path}.new-{uuid.uuid4().hex}")
    got = spark.read.parquet(staged).count()
    if got != n:
        raise ValueError(f"{got} rows were written of {n}")
    swap_in(spark, staged, path)
    return n


def upsert_table(new: DataFrame, path: str, key: Sequence[str]) -> None:
    """Replace rows of equal key and keep the others."""
    spark = new.sparkSession
    fs, target = _fs(spark, path)
    rebuild(upsert(spark.read.parquet(path), new, key) if fs.exists(target) else new, path)


def append_log(spark: SparkSession, rows: Sequence[tuple], schema: str, path: str) -> None:
    """Append rows (check results, runs, watermarks, lag) to a log table."""
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(path)


RUN_LOG = "run_id string, step string, status string, at timestamp, rows bigint, error string"


def logged_run(spark: SparkSession, path: str, step: str, work: Callable[[], int], now: Callable[[], datetime], batch: str = "") -> str:
    """Run a step between a RUNNING row and a SUCCESS or FAILED row; errors are logged and raised again. Run ids of a batch begin with its name."""
    run_id = f"{batch}:{uuid.uuid4().hex}" if batch else uuid.uuid4().hex
    append_log(spark, [(run_id, step, "RUNNING", now(), None, None)], RUN_LOG, path)
    try:
        rows = work()
    except Exception as e:
        append_log(spark, [(run_id, step, "FAILED", now(), None, str(e)[:500])], RUN_LOG, path)
        raise
    append_log(spark, [(run_id, step, "SUCCESS", now(), rows, None)], RUN_LOG, path)
    return run_id


def add_ticket(tickets: DataFrame, customers: DataFrame, row: dict) -> DataFrame:
    """The one row of a new ticket, its id the next after the largest; an unknown customer raises."""
    from tidewater.functions.scalar import next_id

    spark = tickets.sparkSession
    if not customers.where(F.col("customer_id") == row["customer_id"]).limit(1).count():
        raise LookupError(f"no customer {row['customer_id']}")
    new = tickets.agg(F.coalesce(next_id(F.col("ticket_id")), F.lit("T000001")).alias("ticket_id"))
    return new.select("ticket_id", *[F.lit(row.get(c)).cast(tickets.schema[c].dataType).alias(c) for c in tickets.columns if c != "ticket_id"]).select(*tickets.columns)


def patch_ticket(tickets: DataFrame, ticket_id: str, now: datetime, **changes: str) -> DataFrame:
    """All tickets with one changed; becoming resolved stamps ``resolved_ts``, any other status clears it."""
    mine = F.col("ticket_id") == ticket_id
    new = {c: F.when(mine, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()}
    if "status" in changes:
        stamp = F.coalesce(F.col("resolved_ts"), F.lit(now)) if changes["status"] == "resolved" else F.lit(None).cast("timestamp")
        new["resolved_ts"] = F.when(mine, stamp).otherwise(F.col("resolved_ts"))
    return tickets.withColumns(new)


def feeds(df: DataFrame, folder: str, page_size: int = 500) -> None:
    """A table as CSV, JSON lines and cursor-linked pages: what the readers take."""
    import json
    from pathlib import Path

    rows = [{k: None if v is None else str(v) for k, v in r.asDict().items()} for r in df.toLocalIterator()]
    top = Path(folder)
    top.mkdir(parents=True, exist_ok=True)
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    df.coalesce(1).write.mode("overwrite").json(f"{folder}/jsonl")
    (top / "array.json").write_text(json.dumps(rows))
    pages = [rows[i : i + page_size] for i in range(0, len(rows), page_size)] or [[]]
    for i, data in enumerate(pages, 1):
        more = i < len(pages)
        body = {"object": "list", "page": i, "page_size": page_size, "has_more": more, "next_cursor": f"page-{i + 1:04d}.json" if more else None, "data": data}
        (top / f"page-{i:04d}.json").write_text(json.dumps(body))
