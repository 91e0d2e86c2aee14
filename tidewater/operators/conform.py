"""Capture and conformance: lineage, hash dedup, verdicts, quarantine, one row a key, incremental capture, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.scalar import normalise, record_hash, safe_cast
from tidewater.operators.materialise import written
from tidewater.spec import KEPT_LINEAGE, LINEAGE, Entity, check_owner, check_unrestricted


def with_lineage(df: DataFrame, run_id: str, source: str, source_file: str, at: Column, order_by: Sequence[str]) -> DataFrame:
    """``df`` with the six lineage columns. ``_batch_seq`` numbers the rows of a capture in the order given.

    The number is a global one; it is made without a one-task window: partitions
    are range-sorted, counted, and each adds the rows before it.
    """
    clash = set(df.columns) & set(LINEAGE)
    if clash:
        raise ValueError(f"columns clash with lineage: {sorted(clash)}")
    hashed = df.withColumn("_record_hash", record_hash(*[F.col(c) for c in df.columns]))
    numbered = number_rows(hashed, [*order_by, "_record_hash"], "_batch_seq")
    return numbered.withColumns({"_ingested_at": at, "_ingest_run_id": F.lit(run_id), "_source_system": F.lit(source), "_source_file": F.lit(source_file)}).select(*df.columns, *LINEAGE)


def number_rows(df: DataFrame, order_by: Sequence[str], name: str) -> DataFrame:
    """1, 2, ... in the given order, in parallel; rows that tie on all of ``order_by`` are told apart arbitrarily."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c).asc_nulls_last() for c in order_by]
    dealt = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_part", F.spark_partition_id()).withColumn("_in_part", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    # ranges are sampled: counts and rows must come from one run
    dealt = written(dealt, "numbered")
    counts = dealt.groupBy("_part").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    # one row a partition
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in_part") + 1).drop("_part", "_in_part", "_before")


def hash_dedup(df: DataFrame, hash_col: str = "_record_hash", order: Sequence[Column] | None = None) -> DataFrame:
    """One row for each hash: the latest captured."""
    order = order or [F.col("_ingested_at").desc_nulls_last(), F.col("_batch_seq").desc_nulls_last()]
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(hash_col).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def latest_per_key(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key: the first in ``order`` (nulls are spelt out by the caller)."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def rules(spec: Entity) -> Column:
    """The first rule that a row breaks, as ``rule:column``, or null: missing, bad_type, bad_enum, out_of_range, column by column."""
    found = []
    for f in spec.fields:
        text, typed = normalise(F.col(f.name)), safe_cast(F.col(f.name), f.kind)
        if not f.nullable:
            found.append(F.when(text.isNull(), F.lit(f"missing:{f.name}")))
        if f.kind != "string":
            found.append(F.when(text.isNotNull() & typed.isNull(), F.lit(f"bad_type:{f.name}")))
        if f.allowed:
            found.append(F.when(text.isNotNull() & ~text.isin(*f.allowed), F.lit(f"bad_enum:{f.name}")))
        if f.minimum is not None:
            found.append(F.when(typed < f.minimum, F.lit(f"out_of_range:{f.name}")))
    return F.coalesce(*found, F.lit(None).cast("string"))


def judge(bronze: DataFrame, spec: Entity) -> DataFrame:
    """Deduplicated rows with ``_quarantine_reason``; original values stay."""
    check_unrestricted(bronze.columns)
    return hash_dedup(bronze).withColumn("_quarantine_reason", rules(spec))


def good_rows(judged: DataFrame, spec: Entity) -> DataFrame:
    """Valid rows, one a key, typed; of the lineage four columns stay. Typing follows the ranking."""
    recency = safe_cast(F.col(spec.recency), "timestamp") if spec.recency in spec.columns else F.col(spec.recency)
    best = latest_per_key(judged.where("_quarantine_reason IS NULL"), spec.key, recency.desc_nulls_last(), F.col("_ingested_at").desc_nulls_last(), F.col("_batch_seq").desc_nulls_last(), F.col("_record_hash").asc_nulls_last())
    return best.select(*[safe_cast(F.col(f.name), f.kind).alias(f.name) for f in spec.fields if f.name not in spec.drop], *KEPT_LINEAGE)


def quarantined(judged: DataFrame) -> DataFrame:
    return judged.where("_quarantine_reason IS NOT NULL")


def reasons(judged: DataFrame) -> DataFrame:
    """How often each rule was the first broken, commonest first."""
    return quarantined(judged).groupBy("_quarantine_reason").count().orderBy(F.desc("count"), "_quarantine_reason")


def incremental(source: DataFrame, ts_col: str, watermark: object, captured: DataFrame | None = None, hash_col: str = "_record_hash") -> DataFrame:
    """Rows after the watermark, and those whose time can't be read unless their hash was captured before; no watermark: all."""
    if watermark is None:
        return source
    ts = safe_cast(F.col(ts_col), "timestamp")
    late = source.where(ts > F.lit(watermark))
    unread = source.where(ts.isNull())
    if captured is not None:
        unread = unread.join(captured.select(hash_col).distinct(), hash_col, "left_anti").select(*source.columns)
    return late.unionByName(unread)


def watermark_of(df: DataFrame, ts_col: str) -> DataFrame:
    return df.agg(F.max(safe_cast(F.col(ts_col), "timestamp")).alias("watermark"))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key ``new`` lacks."""
    return new.unionByName(old.join(new.select(*key), list(key), "left_anti").select(*new.columns))


def upsert_adding(old: DataFrame, new: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    return old.unionByName(new).groupBy(*key).agg(F.sum(value).alias(value))


def upsert_greatest(log: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """A watermark that never retreats: the largest value of an append-only log for each key."""
    return log.groupBy(*key).agg(F.max(value).alias(value))


def drop_orphans(df: DataFrame, current: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(current.select(*key).distinct(), list(key), "left_semi")


def capture_check(source: str, entity: str) -> None:
    check_owner(source, entity)
