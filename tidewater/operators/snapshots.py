"""A versioned dimension on disk that snapshots are merged into one by one.

The table is partitioned by a hash of the key. A snapshot compares each row with
its key's current version; keys whose state differs get their current version
closed and a new one opened, and only their partitions are rewritten, in one
dynamic partition overwrite. Snapshots without a change write nothing. Taken
twice, after a crash say, a snapshot finds its own versions and changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidewater.operators.materialise import forget, replace_partitions, written
from tidewater.operators.scd2 import FIRST, LAST


class Snapshots:
    """``buckets``: partitions of the table, fixed for its life."""

    def __init__(self, spark: SparkSession, path: str, key: str, fields: Sequence[str], buckets: int = 32):
        self.spark, self.path, self.key, self.fields, self.buckets = spark, path.rstrip("/"), key, list(fields), buckets

    def _table(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:  # nothing is written yet
            return None

    def versions(self) -> DataFrame:
        """``(key, fields, version, opened_at, valid_from, valid_to, is_current, is_tombstone)``."""
        return self._table().drop("bucket")

    def take(self, state: DataFrame, at: Column, deleted: Column | None = None) -> int:
        """Merge the state at an instant; gives the number of keys that changed.

        ``deleted`` tells the rows that are gone: they close what was seen of a
        key with a tombstone of its last fields; a key never seen otherwise leaves
        nothing. Keys without a row stay as they are. Null keys are left out, null
        fields are empty strings; of a key's repeated rows the least counts. An
        instant before the last one merged is refused.
        """
        gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
        fields = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in self.fields]
        rows = state.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(F.struct(gone.alias("gone"), *fields)).alias("now"))
        moment = self.spark.range(1).select(at.cast("timestamp").alias("at")).first()["at"]
        known = self._table()
        if known is None:
            both = rows.where("NOT now.gone").withColumns({"was": F.lit(None).cast(f"struct<{', '.join(f'{f}: string' for f in self.fields)}, is_tombstone: boolean, version: bigint>")})
        else:
            last = known.agg(F.max("opened_at")).first()[0]
            if last is not None and last > moment:
                raise ValueError(f"a snapshot of {moment} comes after one of {last}")
            current = known.where("is_current").select(self.key, F.struct(*self.fields, "is_tombstone", "version").alias("was"))
            both = rows.join(current, self.key, "left")
        differs = F.col("was.is_tombstone") | F.lit(False)
        for f in self.fields:
            differs = differs | (F.col(f"was.{f}") != F.col(f"now.{f}"))
        opens = F.when(F.col("was").isNull(), ~F.col("now.gone")).when(F.col("now.gone"), ~F.col("was.is_tombstone")).otherwise(differs)
        # a tombstone keeps the fields that were last seen
        kept = [F.when(F.col("now.gone"), F.col(f"was.{f}")).otherwise(F.col(f"now.{f}")).alias(f) for f in self.fields]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        first, end, now = F.to_timestamp(F.lit(FIRST)), F.to_timestamp(F.lit(LAST)), F.lit(moment).cast("timestamp")
        opened = written(
            both.where(opens).select(
                self.key, *kept, (F.coalesce("was.version", F.lit(0)) + 1).cast("bigint").alias("version"), now.alias("opened_at"),
                F.when(F.col("was").isNull(), first).otherwise(now).alias("valid_from"), end.alias("valid_to"), F.lit(True).alias("is_current"), F.col("now.gone").alias("is_tombstone"), bucket,
            ),
            "opened",
        )
        touched = {r["bucket"]: r["count"] for r in opened.groupBy("bucket").count().collect()}  # `buckets` rows
        if touched:
            new = opened
            if known is not None:
                mark = opened.select(self.key, F.lit(True).alias("moved"))
                old = known.where(F.col("bucket").isin(list(touched))).join(mark, self.key, "left")
                closes = F.col("is_current") & F.coalesce("moved", F.lit(False))
                old = old.withColumn("valid_to", F.when(closes, now).otherwise(F.col("valid_to"))).withColumn("is_current", F.col("is_current") & ~closes)
                new = old.select(*opened.columns).union(opened)
            replace_partitions(new, self.path, "bucket", touched)
        forget(self.spark, opened.scratch_path)
        return sum(touched.values())
