"""Topics of files, their consumers, dead letters and lag.

A topic is a folder of records (topic, partition, offset, key, value); a batch of
records is one append. A consumer group is a stream over it with a checkpoint of
its own, so groups read the topic independently. Each batch is written by its
number before its offsets are committed: a batch that is repeated after a crash
replaces itself, and every record counts once. Records that can't be parsed go,
with their coordinates and raw bytes, to the group's dead letters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from tidewater.streaming import flows

RECORD = "topic string, partition int, offset bigint, key string, value binary"
ENVELOPE = "topic string, partition int, offset bigint, key string, consumer_group string, error_type string, error_detail string, raw binary, failed_at timestamp"
SERIES = "consumer_group string, topic string, partition int, consumed bigint, log_end bigint, observed_at timestamp, epoch bigint"
EXIT_OK, EXIT_LAGGING = 0, 2


def produce(df: DataFrame, path: str, topic: str, key: str, offset: str, value: Column, partitions: int = 3, files: int | None = None) -> None:
    """Append ``df`` to a topic as one batch of records; a null key is refused, for it has no order."""
    records = flows.keyed(df, key).select(F.lit(topic).alias("topic"), F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int").alias("partition"), F.col(offset).cast("bigint").alias("offset"), "key", value.cast("binary").alias("value"))
    (records.repartition(files) if files else records).write.mode("append").parquet(path)


def parsed(records: DataFrame, schema: str, required: list[str], rules: dict[str, Column] | None = None) -> DataFrame:
    """``records`` with ``record``, ``error_type`` and ``error_detail``; one of the first two is null.

    JSON is parsed by Spark. A value is ``empty``, ``not_json`` (or cut short),
    ``missing_field``, or breaks the first of ``rules`` that is false or null; the
    rules' columns are fields of ``record``.
    """
    text = F.decode("value", "UTF-8")
    fields = StructType.fromDDL(f"{schema}, _corrupt string")
    got = records.withColumn("record", F.from_json(text, fields, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    missing = F.filter(F.array(*[F.when(F.col(f"record.{n}").isNull(), F.lit(n)) for n in required]), lambda n: n.isNotNull())
    kind = F.when(F.col("value").isNull() | (F.length("value") == 0), "empty").when(F.col("record").isNull() | F.col("record._corrupt").isNotNull(), "not_json").when(F.size(missing) > 0, "missing_field")
    for name, rule in (rules or {}).items():
        kind = kind.when(~F.coalesce(rule, F.lit(False)), name)
    got = got.withColumn("error_type", kind).withColumn("error_detail", F.when(F.col("error_type") == "missing_field", F.array_join(missing, ",")))
    return got.withColumn("record", F.when(F.col("error_type").isNull(), F.struct(*[F.col(f"record.{f.name}").alias(f.name) for f in fields[:-1]])))


def envelopes(bad: DataFrame, group: str) -> DataFrame:
    """Dead letters with where they came from and what they were."""
    return bad.select("topic", "partition", "offset", "key", F.lit(group).alias("consumer_group"), "error_type", "error_detail", F.col("value").alias("raw"), F.current_timestamp().alias("failed_at"))


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that epochs wrote; none is written: no rows."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


class Group:
    """A consumer group of one topic; ``home`` holds its checkpoint, its rows, its dead letters and its lag."""

    def __init__(self, spark: SparkSession, topic: str, home: str, name: str):
        self.spark, self.topic, self.home, self.name = spark, topic.rstrip("/"), home.rstrip("/"), name

    def consume(self, parse: Callable[[DataFrame], DataFrame], max_files: int | None = None, hook: Callable[[int], None] | None = None) -> None:
        """Read what there is now from where the group stopped. ``hook`` is called with the batch's number after its rows are written and before it commits."""
        write = {n: flows.epoch_writer(f"{self.home}/{n}") for n in ("rows", "dead", "lag")}

        def each(batch: DataFrame, epoch: int) -> None:
            held = parse(batch).persist()
            try:
                write["dead"](envelopes(held.where("error_type IS NOT NULL"), self.name), epoch)
                write["rows"](held.where("error_type IS NULL").select("topic", "partition", "offset", "record.*"), epoch)
                write["lag"](self._observed(held), epoch)
            finally:
                held.unpersist()
            if hook:
                hook(epoch)

        stream = flows.from_files(self.spark, self.topic, RECORD, max_files)
        flows.finish(stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.home}/checkpoint").trigger(availableNow=True).start())

    def _observed(self, batch: DataFrame) -> DataFrame:
        """A row a partition: what this batch read of it, and all that the topic has; read from the topic as it is now."""
        end = self.spark.read.schema(RECORD).parquet(self.topic).groupBy("topic", "partition").agg(F.count("*").alias("log_end"))
        now = batch.groupBy("topic", "partition").agg(F.count("*").alias("consumed"))
        both = end.join(now, ["topic", "partition"], "left")
        return both.select(F.lit(self.name).alias("consumer_group"), "topic", "partition", F.coalesce("consumed", F.lit(0).cast("bigint")).alias("consumed"), "log_end", F.current_timestamp().alias("observed_at"))

    def rows(self, schema: str) -> DataFrame:
        return read(self.spark, f"{self.home}/rows", f"topic string, partition int, offset bigint, {schema}")

    def dead(self) -> DataFrame:
        return read(self.spark, f"{self.home}/dead", ENVELOPE)

    def lag(self) -> DataFrame:
        """The series ``(consumer_group, topic, partition, epoch, current_offset, log_end_offset, lag, observed_at)``; a partition that a group hasn't read stands at 0."""
        from pyspark.sql import Window

        seen = read(self.spark, f"{self.home}/lag", SERIES)
        so_far = F.sum("consumed").over(Window.partitionBy("consumer_group", "topic", "partition").orderBy("epoch"))  # a row a batch
        rows = seen.withColumn("current_offset", so_far)
        return rows.select("consumer_group", "topic", "partition", "epoch", "current_offset", F.col("log_end").alias("log_end_offset"), F.greatest(F.col("log_end") - F.col("current_offset"), F.lit(0)).alias("lag"), "observed_at")


def exit_code(series: DataFrame, ceiling: int) -> int:
    """2 if the last known lag of any group and topic, added over its partitions, is above ``ceiling``."""
    last = series.groupBy("consumer_group", "topic", "partition").agg(F.max_by("lag", "epoch").alias("lag"))
    worst = last.groupBy("consumer_group", "topic").agg(F.sum("lag").alias("lag")).agg(F.max("lag")).first()[0]
    return EXIT_LAGGING if worst is not None and worst > ceiling else EXIT_OK


def report(dead: DataFrame) -> DataFrame:
    """Dead letters by error and group; a record that several groups refuse counts once for each."""
    return dead.groupBy("error_type", "consumer_group").agg(F.count("*").alias("n"))
