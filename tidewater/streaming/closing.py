"""Tumbling counts that know when they are over.

Keyed state holds a window's count; each batch emits the windows it changed as
open, and an event-time timer emits a window once more, closed, when the
watermark passes its end. State then goes. Rows of a closed window are dropped.
A window's key is dealt over shards by a hash of the row, so that a dimension
that all rows have isn't one task's; ``latest`` adds the shards up.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewater.streaming import flows

SHARDS = 8
KEY = ["metric", "dimension", "window_start", "window_end", "shard"]
OUT = "metric string, dimension string, window_start timestamp, window_end timestamp, shard int, value bigint, is_closed boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Counter(StatefulProcessor):
    """The count of one key's rows, and a timer at its window's end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n bigint")

    @staticmethod
    def end_of(key: tuple) -> int:
        return int(pd.Timestamp(key[3]).tz_localize("UTC").timestamp() * 1000) if pd.Timestamp(key[3]).tzinfo is None else int(pd.Timestamp(key[3]).timestamp() * 1000)

    def row(self, key: tuple, n: int, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({c: [v] for c, v in zip(KEY, key, strict=True)} | {"value": [n], "is_closed": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        n = sum(map(len, rows))
        end = self.end_of(key)
        if end <= timerValues.getCurrentWatermarkInMs():  # over already
            return
        before = self.count.get()
        if before is None:
            self.handle.registerTimer(end)
        total = n + (before[0] if before else 0)
        self.count.update((total,))
        yield self.row(key, total, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        before = self.count.get()
        if before:
            self.count.clear()
            yield self.row(key, before[0], True)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def closing(rows: DataFrame, width: str = flows.WINDOW, lateness: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """``rows(ts, metric, dimension)`` as updates ``OUT``. A window closes once a row has come whose window ends ``lateness`` and one ``width`` after its end."""
    w = F.window("ts", width)
    dealt = F.pmod(F.xxhash64(*rows.columns), F.lit(shards)).cast("int")
    keyed = rows.select("metric", "dimension", w.start.alias("window_start"), w.end.alias("window_end"), dealt.alias("shard"))
    # the watermark runs on the windows' ends, so what is late is a whole window and not a row of an open one
    marked = keyed.withColumn("event_time", F.col("window_end")).withWatermark("event_time", f"{lateness} {width}")
    return marked.groupBy(*KEY).transformWithStateInPandas(Counter(), OUT, "update", "eventTime")


def latest(updates: DataFrame) -> DataFrame:
    """The state of every window after some updates: its count, and whether all of it is closed."""
    shard = updates.groupBy(*KEY).agg(F.max("value").alias("value"), F.bool_or("is_closed").alias("is_closed"))
    return shard.groupBy("window_start", "window_end", "metric", "dimension").agg(F.sum("value").alias("value"), F.bool_and("is_closed").alias("is_closed"))


def run(rows: DataFrame, path: str, width: str = flows.WINDOW, lateness: str = "0 seconds") -> DataFrame:
    """All that there is now, from where the last run under ``path`` stopped; gives ``latest`` of all runs."""
    with rocks(rows.sparkSession):
        query = closing(rows, width, lateness).writeStream.outputMode("update").foreachBatch(flows.epoch_writer(f"{path}/updates")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    flows.finish(query)
    return latest(rows.sparkSession.read.schema(OUT).option("pathGlobFilter", "*.parquet").parquet(f"{path}/updates/epoch=*"))
