"""Streams: tumbling metrics, capture with dead letters, sessions, lag. A topic is any streaming frame; files stand in for a broker."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.streaming import avro

WINDOW = "60 seconds"


def from_files(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """A streaming frame over Parquet files as they come."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def from_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """A topic's records; needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load()


def tail(records: DataFrame, n: int, by: str = "failed_at") -> DataFrame:
    """The last ``n`` records of a batch frame."""
    return records.orderBy(F.desc(by)).limit(n)


def keyed(df: DataFrame, key: str) -> DataFrame:
    """Rows with their message key; a null key is refused, for it has no order."""
    return df.withColumn("key", F.when(F.col(key).isNull(), F.raise_error(F.lit(f"{key} is null"))).otherwise(F.col(key).cast("string")))


def metric_rows(events: DataFrame, ts: str, dims: dict[str, Column], identified: Column) -> DataFrame:
    """Each event as rows (ts, metric, dimension): the total, one for each non-empty dimension, one if it is identified."""
    pair = lambda m, d: F.struct(F.lit(m).alias("metric"), d.cast("string").alias("dimension"))
    pairs = [pair("events", F.lit("_total")), *(F.when(F.coalesce(c.cast("string"), F.lit("")) != "", pair(f"events_by_{n}", c)) for n, c in dims.items()), F.when(identified, pair("identified_events", F.lit("_total")))]
    return events.select(F.col(ts).alias("ts"), F.inline(F.filter(F.array(*pairs), lambda p: p.isNotNull())))


def tumbling(rows: DataFrame, width: str = WINDOW, lateness: str | None = None) -> DataFrame:
    """Counts by event-time window, metric and dimension. Any lateness counts, unless ``lateness`` sets a watermark."""
    if lateness:
        rows = rows.withWatermark("ts", lateness)
    g = rows.groupBy(F.window("ts", width).alias("w"), "metric", "dimension").agg(F.count("*").alias("value"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "metric", "dimension", "value")


def decoded(messages: DataFrame, schema: dict, columns: str, payload: str = "value") -> DataFrame:
    """Messages with ``record`` (a struct of ``columns``), ``error_type`` and ``error_detail``; a message is either one or the other."""
    names = [c.split()[0] for c in columns.split(", ")]
    expected = avro.fingerprint(schema)

    @F.pandas_udf(f"record struct<{', '.join(f'{a}: {b}' for a, b in (c.split() for c in columns.split(', ')))}>, error_type string, error_detail string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for payloads in batches:
            rows = []
            for p in payloads:
                try:
                    got = avro.decode(schema, None if p is None else bytes(p), expected)
                    rows.append(({n: got[n] for n in names}, None, None))
                except avro.DecodeError as e:
                    rows.append((dict.fromkeys(names), e.kind, str(e)))
            record = pd.DataFrame([r[0] for r in rows], columns=names)
            yield pd.DataFrame({"record": list(record.to_dict("records")), "error_type": [r[1] for r in rows], "error_detail": [r[2] for r in rows]}) if len(rows) else pd.DataFrame({"record": [], "error_type": [], "error_detail": []})

    return messages.withColumn("_d", run(F.col(payload))).select(*messages.columns, "_d.*")


def split_writer(good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None], error: str = "error_type") -> Callable[[DataFrame, int], None]:
    """A foreachBatch that writes dead letters first and then good rows; the batch commits after both."""

    def write(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        try:
            bad(held.where(F.col(error).isNotNull()), epoch)
            good(held.where(F.col(error).isNull()).drop("error_type", "error_detail"), epoch)
        finally:
            held.unpersist()

    return write


def epoch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each epoch to a folder of its own, so that a repeated epoch replaces itself: effectively once."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def finish(query: StreamingQuery, seconds: float | None = None) -> None:
    """Wait for a run over what is there now, however long it takes unless ``seconds`` limits it; raise what stopped it."""
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream took over {seconds} s")
    if query.exception():
        raise query.exception()


def run_to_table(df: DataFrame, mode: str, path: str) -> DataFrame:
    """All of a finite stream of any output mode as Parquet, a folder an epoch: of ``complete`` the last, else all of them. Nothing gathers on the driver."""
    seen, write = [], epoch_writer(f"{path}/out")

    def each(batch: DataFrame, epoch: int) -> None:
        write(batch, epoch)
        seen.append(epoch)

    finish(df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    if not seen:
        return df.sparkSession.createDataFrame([], df.schema)
    epochs = [max(seen)] if mode == "complete" else sorted(set(seen))
    return df.sparkSession.read.schema(df.schema).parquet(*[f"{path}/out/epoch={e}" for e in epochs])


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All of a finite append stream as Parquet files, read back."""
    finish(df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return df.sparkSession.read.schema(df.schema).parquet(path)


def offsets_lag(progress: dict) -> list[tuple[str, int]]:
    """(source, records behind) from a progress report's latest and end offsets."""
    out = []
    for s in progress.get("sources", []):
        load = lambda x: json.loads(x) if isinstance(x, str) else (x or {})
        flat = lambda o: {(t, p): n for t, ps in o.items() if isinstance(ps, dict) for p, n in ps.items()}
        end, latest = flat(load(s.get("endOffset"))), flat(load(s.get("latestOffset")))
        out.append((s.get("description", ""), sum(max(0, n - end.get(k, 0)) for k, n in latest.items())))
    return out
