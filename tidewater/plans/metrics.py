"""The dashboards' readers over gold, the logs and the streams' tables, with parameters and a cache.

A reader's result is written under the watermark, its name and its parameters,
and the same question is answered from that table until data has become
complete anew; then the watermark moves, and the results of older ones go.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import serving
from tidewater.operators.materialise import forget
from tidewater.operators.quality import latest_results
from tidewater.sources import readers, writers


class Metrics:
    """``table`` gives a gold table by its name, ``log`` the run log; cached results lie under ``cache``."""

    def __init__(self, spark: SparkSession, cache: str, table: Callable[[str], DataFrame], log: Callable[[], DataFrame]):
        self.spark, self.cache, self.table, self.log = spark, cache.rstrip("/"), table, log

    @classmethod
    def of(cls, spark: SparkSession, root: str) -> Metrics:
        """Over what a batch run left under ``root``."""
        return cls(spark, f"{root}/cache", lambda name: spark.read.parquet(f"{root}/gold/{name}"), lambda: spark.read.schema(writers.RUN_LOG).parquet(f"{root}/meta/runs"))

    def watermark(self) -> DataFrame:
        """When and with which step data last became complete, and how many runs are under way: read each time, never cached."""
        return serving.watermark(self.log())

    def _cached(self, name: str, build: Callable[[], DataFrame], **params: object) -> DataFrame:
        mark = self.watermark().first()
        now = hashlib.sha256(f"{mark['watermark']}/{mark['latest_step']}".encode()).hexdigest()[:16]
        key = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
        path = f"{self.cache}/watermark={now}/{name}-{key}"
        if not readers.exists(self.spark, f"{path}/_SUCCESS"):
            self._drop_but(now)
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _drop_but(self, now: str) -> None:
        """Results of other watermarks go."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.cache}/watermark=*")
        found = pattern.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(pattern)
        forget(self.spark, *(p for s in found or [] if not (p := s.getPath().toString()).endswith(f"={now}")))

    @staticmethod
    def _between(col: str, start: date, end: date) -> Column:
        if start > end:
            raise ValueError(f"{start} is after {end}")
        return F.col(col).between(F.lit(start), F.lit(end))

    def _ranged(self, mart: str, day: str, start: date, end: date, only: dict[str, str | None] | None = None) -> DataFrame:
        only = {c: v for c, v in (only or {}).items() if v is not None}
        inside = self._between(day, start, end)

        def build() -> DataFrame:
            df = self.table(mart).where(inside)
            for c, v in only.items():
                df = df.where(F.col(c) == F.lit(v))
            return df

        return self._cached(mart, build, start=start, end=end, **only)

    def date_bounds(self) -> tuple[date, date]:
        """First and last day of the daily sales; none: an error."""
        row = self._cached("date_bounds", lambda: self.table("mart_daily_sales").agg(F.min("date").alias("first"), F.max("date").alias("last"))).first()
        if row["first"] is None:
            raise LookupError("no daily sales yet")
        return row["first"], row["last"]

    def channels(self) -> DataFrame:
        return self._cached("channels", lambda: self.table("mart_daily_sales").select("channel").distinct()).orderBy("channel")

    def daily_sales(self, start: date, end: date, channel: str | None = None) -> DataFrame:
        return self._ranged("mart_daily_sales", "date", start, end, {"channel": channel}).orderBy("date", "channel")

    def customer_rfm(self) -> DataFrame:
        return self._cached("customer_rfm", lambda: self.table("mart_customer_rfm"))

    def cohort_retention(self, max_periods: int = 12) -> DataFrame:
        if max_periods < 0:
            raise ValueError("periods count from 0")
        return self._cached("cohort_retention", lambda: self.table("mart_cohort_retention").where(F.col("months_since") <= max_periods), max_periods=max_periods).orderBy("cohort", "months_since")

    def product_performance(self, start: date, end: date) -> DataFrame:
        return self._ranged("mart_product_performance", "month", start, end)

    def payment_health(self, start: date, end: date) -> DataFrame:
        return self._ranged("mart_payment_health", "date", start, end).orderBy("date")

    def web_funnel(self, start: date, end: date) -> DataFrame:
        return self._ranged("mart_web_funnel", "date", start, end)

    def support_health(self, start: date, end: date) -> DataFrame:
        return self._ranged("mart_support_health", "date", start, end)


def data_quality_summary(history: DataFrame, key: Sequence[str] = ("source", "check"), at: str = "at", limit: int = 40) -> DataFrame:
    """The newest result of each check, ``limit`` of them by name."""
    name = F.struct(*key).alias("_k")
    return latest_results(history.withColumn("_k", name), "_k", at).drop("_k").orderBy(*key).limit(limit)


def stream_metrics(windows: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Windows that began in the last ``hours`` before ``now``."""
    return windows.where((F.col("window_start") > now - F.make_interval(hours=F.lit(hours))) & (F.col("window_start") <= now)).orderBy("window_start")


def consumer_lag(series: DataFrame) -> DataFrame:
    """The last known position of every group, topic and partition of a lag series."""
    last = F.max_by(F.struct("current_offset", "log_end_offset", "lag", "observed_at"), "epoch").alias("p")
    return series.groupBy("consumer_group", "topic", "partition").agg(last).select("consumer_group", "topic", "partition", "p.*")
