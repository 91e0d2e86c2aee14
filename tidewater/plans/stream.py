"""Catalogue: finite runs of the streams, and the dashboards' readings."""

from __future__ import annotations

from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import scalar as S
from tidewater.operators import materialise, serving
from tidewater.plans import marts
from tidewater.plans.base import Lake, query
from tidewater.plans.metrics import Metrics, consumer_lag
from tidewater.streaming import avro, closing, flows, topics


def scratch(k: Lake) -> str:
    return materialise.scratch(k.spark, "stream")


def events_stream(k: Lake) -> DataFrame:
    """The events table as a stream of files."""
    folder, name = flow_folder(k)
    df = k.spark.readStream.schema(k.raw("events").schema).option("pathGlobFilter", name).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def flow_folder(k: Lake) -> tuple[str, str]:
    """Folder and file pattern of the table, which may be a file or a folder; a stream reads folders."""
    path = k.spark._jvm.org.apache.hadoop.fs.Path(f"{k.folder}/events.parquet")
    fs = path.getFileSystem(k.spark.sparkContext._jsc.hadoopConfiguration())
    return (path.toString(), "*.parquet") if fs.getFileStatus(path).isDirectory() else (path.getParent().toString(), "events.parquet")


def metric_stream(k: Lake) -> DataFrame:
    user = F.col("user_id")
    return flows.metric_rows(events_stream(k), "ts", {"type": F.col("event_type"), "group": F.when(user % 3 > 0, (user % 3).cast("string"))}, user % 2 == 0)


@query("e", "SELECT time_bucket(INTERVAL 60 SECOND, event_ts) AS window_start, time_bucket(INTERVAL 60 SECOND, event_ts) + INTERVAL 60 SECOND AS window_end, 'events' AS metric, '_total' AS dimension, count(*) AS value FROM e GROUP BY 1, 2")
def stream_tumbling_counts(k: Lake) -> DataFrame:
    rows = events_stream(k).select("ts", F.lit("events").alias("metric"), F.lit("_total").alias("dimension"))
    return flows.run_to_table(flows.tumbling(rows), "complete", scratch(k))


@query("e", "WITH m AS (SELECT event_ts, unnest([{'m': 'events', 'd': '_total'}, {'m': 'events_by_type', 'd': event_type}, {'m': 'events_by_group', 'd': CASE WHEN user_id % 3 > 0 THEN (user_id % 3)::VARCHAR END}, CASE WHEN user_id % 2 = 0 THEN {'m': 'identified_events', 'd': '_total'} END]) AS x FROM e) SELECT time_bucket(INTERVAL 1 DAY, event_ts) AS window_start, x.m AS metric, x.d AS dimension, count(*) AS value FROM m WHERE x.m IS NOT NULL AND coalesce(x.d, '') <> '' GROUP BY ALL")
def stream_metrics_long(k: Lake) -> DataFrame:
    got = flows.run_to_table(flows.tumbling(metric_stream(k), "1 day"), "update", scratch(k))
    # every update of a window is a row; the last one holds
    return got.groupBy("window_start", "metric", "dimension").agg(F.max("value").alias("value"))


@query("e", "SELECT event_type, user_id, min(event_ts) AS event_ts FROM e GROUP BY 1, 2")
def stream_bronze_dedup(k: Lake) -> DataFrame:
    """A stream captured with duplicates of a natural key, one row a key afterwards."""
    got = flows.run_to_files(events_stream(k).select("event_type", "user_id", "ts"), f"{(at := scratch(k))}/out", f"{at}/checkpoint")
    return got.groupBy("event_type", "user_id").agg(F.min("ts").alias("event_ts"))


_EVENT = "event_id string, session_id string, customer_id string, event_ts long, event_type string"


def messages(k: Lake) -> DataFrame:
    """Events as encoded messages; of every twenty one is not Avro, one cut short, one of another schema."""
    @F.pandas_udf("binary")
    def encode(event_id: pd.Series, user: pd.Series, kind: pd.Series) -> pd.Series:
        out = []
        for i, u, t in zip(event_id, user, kind):
            row = {"event_id": f"E{i:08d}", "session_id": f"S{u}", "customer_id": f"C{u}" if u % 2 else None, "event_ts": 1_700_000_000_000 + i, "event_type": "purchase" if t == "purchase" else "page_view", "product_id": None, "order_id": None, "channel": avro.CHANNELS[u % 6], "device_type": avro.DEVICES[u % 3]}
            m = avro.encode(avro.WEB_EVENT, row)
            out.append({0: b"{}", 1: m[:-3], 2: m[:2] + bytes(8) + m[10:]}.get(i % 20, m))
        return pd.Series(out)

    return k.raw("events").select(F.col("event_id").alias("offset"), encode("event_id", "user_id", "event_type").alias("value"))


@query("", "SELECT CASE event_id % 20 WHEN 0 THEN 'not_avro' WHEN 1 THEN 'truncated' WHEN 2 THEN 'wrong_schema' ELSE 'good' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def stream_dlq_split(k: Lake) -> DataFrame:
    """Messages through a stream that writes what it can't decode to a dead-letter table before it commits."""
    at = scratch(k)
    messages(k).write.parquet(f"{at}/topic")
    stream = flows.decoded(flows.from_files(k.spark, f"{at}/topic", "offset bigint, value binary"), avro.WEB_EVENT, _EVENT)
    write = flows.split_writer(flows.epoch_writer(f"{at}/bronze"), flows.epoch_writer(f"{at}/dead"))
    flows.finish(stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start())
    good = k.spark.read.parquet(f"{at}/bronze").select(F.lit("good").alias("outcome"))
    return good.unionByName(k.spark.read.parquet(f"{at}/dead").select(F.col("error_type").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("ses", "SELECT user_id, min(event_ts) AS session_start, count(*) AS n FROM ses GROUP BY user_id, session_id")
def stream_session_windows(k: Lake) -> DataFrame:
    """Gap sessions of thirty minutes (and a microsecond: at exactly thirty minutes a session goes on)."""
    s = events_stream(k).groupBy("user_id", F.session_window("ts", "30 minutes 1 microsecond").alias("w")).agg(F.count("*").alias("n"))
    got = s.select("user_id", F.col("w.start").alias("session_start"), "n")
    return flows.run_to_table(got, "complete", scratch(k))


# Records of the topics below: of every twenty events one is no JSON, one cut short, one lacks its type, one has an unknown one; a quarter of them a batch.
_JSON = "event_id bigint, user_id bigint, event_type string"
_FILES = 4


def topic(k: Lake, batches: int = 1) -> str:
    """The events as a topic of files, appended in ``batches`` by their ids."""
    e = k.raw("events")
    whole = F.to_json(F.struct("event_id", "user_id", F.when(F.col("event_id") % 20 == 3, F.lit("unheard_of")).otherwise(F.col("event_type")).alias("event_type")))
    value = F.when(F.col("event_id") % 20 == 0, F.lit("not json")).when(F.col("event_id") % 20 == 1, F.substring(whole, 1, 12)).when(F.col("event_id") % 20 == 2, F.to_json(F.struct("event_id", "user_id"))).otherwise(whole)
    path = f"{scratch(k)}/topic"
    last = e.agg(F.max("event_id")).first()[0] + 1
    for b in range(batches):
        part = e.where((F.col("event_id") * batches >= b * last) & (F.col("event_id") * batches < (b + 1) * last))
        topics.produce(part, path, "events", "user_id", "event_id", value, files=_FILES)
    return path


def strict(records: DataFrame) -> DataFrame:
    return topics.parsed(records, _JSON, ["event_id", "user_id", "event_type"], {"unknown_type": F.col("record.event_type") != "unheard_of"})


def lenient(records: DataFrame) -> DataFrame:
    """Metrics need no known type."""
    return topics.parsed(records, _JSON, ["event_id", "user_id", "event_type"])


_KINDS = "CASE event_id % 20 WHEN 0 THEN 'not_json' WHEN 1 THEN 'not_json' WHEN 2 THEN 'missing_field'"


@query("", f"SELECT g AS consumer_group, coalesce(error_type, 'good') AS outcome, count(*) AS n, count(DISTINCT event_id) AS records FROM (SELECT 'bronze' AS g, event_id, {_KINDS} WHEN 3 THEN 'unknown_type' END AS error_type FROM events UNION ALL SELECT 'metrics', event_id, {_KINDS} END FROM events) GROUP BY 1, 2")
def stream_two_groups(k: Lake) -> DataFrame:
    """Two consumer groups of one topic, each with its checkpoint, rows and dead letters: how each record ended in each group."""
    at, path = scratch(k), topic(k)
    out = None
    for name, parse in (("bronze", strict), ("metrics", lenient)):
        group = topics.Group(k.spark, path, f"{at}/{name}", name)
        group.consume(parse)
        rows = group.rows(_JSON).select(F.lit(name).alias("consumer_group"), F.lit("good").alias("outcome"), "offset")
        both = rows.union(group.dead().select("consumer_group", "error_type", "offset"))
        out = both if out is None else out.union(both)
    return out.groupBy("consumer_group", "outcome").agg(F.count("*").alias("n"), F.count_distinct("offset").alias("records"))


@query("", f"SELECT {_KINDS} WHEN 3 THEN 'unknown_type' END AS error_type, 'bronze' AS consumer_group, 'events' AS topic, event_id AS \"offset\" FROM events WHERE event_id % 20 < 4")
def stream_dead_letters(k: Lake) -> DataFrame:
    """The envelopes of one group."""
    group = topics.Group(k.spark, topic(k), scratch(k), "bronze")
    group.consume(strict)
    return group.dead().select("error_type", "consumer_group", "topic", "offset")


@query("", "WITH b AS (SELECT floor(event_id * 4 / (SELECT max(event_id) + 1 FROM events))::BIGINT AS epoch, count(*) AS n FROM events GROUP BY 1) SELECT 'events' AS topic, epoch, (sum(n) OVER (ORDER BY epoch))::BIGINT AS current_offset, (SELECT count(*) FROM events) AS log_end_offset, ((SELECT count(*) FROM events) - sum(n) OVER (ORDER BY epoch))::BIGINT AS lag FROM b")
def stream_lag(k: Lake) -> DataFrame:
    """The lag series of a group that reads a batch of the topic at a time, from what it wrote after each; added over partitions."""
    group = topics.Group(k.spark, topic(k, batches=4), scratch(k), "bronze")
    group.consume(strict, max_files=_FILES)
    return group.lag().groupBy("topic", "epoch").agg(*[F.sum(c).alias(c) for c in ("current_offset", "log_end_offset", "lag")])


@query("e", "WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, event_ts) AS window_start, event_type, count(*) AS value FROM e GROUP BY 1, 2) SELECT window_start, 'events_by_type' AS metric, event_type AS dimension, value, window_start + INTERVAL 1 DAY <= (SELECT max(window_start) FROM w) - INTERVAL 1 DAY AS is_closed FROM w")
def stream_closed_windows(k: Lake) -> DataFrame:
    """Daily counts with whether their window is over: state and timers, closed a day and a window after its end."""
    rows = events_stream(k).select("ts", F.lit("events_by_type").alias("metric"), F.col("event_type").alias("dimension"))
    return closing.run(rows, scratch(k), "1 day", "1 day").select("window_start", "metric", "dimension", "value", "is_closed")


# -- dashboards -------------------------------------------------------------------


@query("o", "SELECT channel, sum(amount) FILTER (recognised)::DOUBLE AS revenue, count(*) FILTER (recognised) AS recognised_orders, round(sum(amount) FILTER (recognised)::DOUBLE / count(*) FILTER (recognised), 2) AS nadd_aov FROM o WHERE order_ts >= TIMESTAMP '1998-01-01' AND order_ts < TIMESTAMP '1999-01-01' GROUP BY 1")
def metric_revenue_by_channel(k: Lake) -> DataFrame:
    m = marts.mart_daily_sales(k).where(F.col("date").between("1998-01-01", "1998-12-31"))
    g = m.groupBy("channel").agg(F.round(F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double"), 2).alias("revenue"), F.sum("recognised_orders").alias("recognised_orders"))
    return g.withColumn("nadd_aov", S.ratio(F.col("revenue"), F.col("recognised_orders")))


@query("o l p", "SELECT l.product_id, sum(line_amount) FILTER (recognised)::DOUBLE AS revenue FROM l JOIN o USING (order_id) GROUP BY 1 HAVING sum(line_amount) FILTER (recognised) > 0 ORDER BY revenue DESC, 1 LIMIT 15")
def metric_top_products(k: Lake) -> DataFrame:
    g = marts.mart_product_performance(k).groupBy("product_id").agg(F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double").alias("revenue"))
    return g.orderBy(F.desc("revenue"), "product_id").limit(15)


@query("o", f"{marts.RFM} SELECT r, f, count(*) AS customers, round(sum(monetary), 2) AS monetary FROM q GROUP BY 1, 2")
def metric_rfm_grid(k: Lake) -> DataFrame:
    return marts.rfm_base(k).groupBy("r", "f").agg(F.count("*").alias("customers"), F.sum(F.col("monetary").cast("decimal(18,2)")).cast("double").alias("monetary"))


@query(
    "o",
    """WITH f AS (SELECT customer_id, date_trunc('month', min(order_ts))::DATE AS cohort FROM o WHERE recognised GROUP BY 1), s AS (SELECT cohort, count(*) AS size FROM f GROUP BY 1),
    x AS (SELECT cohort, datediff('month', cohort, date_trunc('month', order_ts)::DATE) AS m, count(DISTINCT customer_id) AS n FROM o JOIN f USING (customer_id) WHERE recognised GROUP BY 1, 2)
    SELECT cohort, string_agg(m || ':' || round(100.0::DOUBLE * n / size, 2)::DECIMAL(5, 2), ' ' ORDER BY m) AS retention FROM x JOIN s USING (cohort) GROUP BY cohort""",
)
def metric_cohort_heatmap(k: Lake) -> DataFrame:
    """A row of the heat map for each cohort: the percentage retained in every month that there is, as month:percentage."""
    cell = F.struct("months_since", F.concat_ws(":", F.col("months_since").cast("string"), F.col("nadd_retention_pct").cast("decimal(5,2)").cast("string")).alias("cell"))
    rows = marts.mart_cohort_retention(k).groupBy("cohort").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.select("cohort", F.array_join("cells.cell", " ").alias("retention"))


@query("pay", "SELECT payment_method, failure_reason, count(*) AS n FROM pay WHERE is_failed GROUP BY 1, 2")
def metric_failure_mix(k: Lake) -> DataFrame:
    """Daily maps of failure reasons merged by adding their counts."""
    m = marts.mart_payment_health(k).select("payment_method", F.from_json("reasons", "map<string, bigint>").alias("reasons"))
    return serving.merge_counts(m, ["payment_method"], "reasons").withColumnRenamed("key", "failure_reason")


@query("e", "SELECT max(event_ts) FILTER (event_type = 'purchase') AS watermark, arg_max(user_id, (event_ts, user_id)) FILTER (event_type = 'purchase') AS latest_step, count(*) FILTER (event_type = 'view') AS in_flight FROM e")
def metric_watermark(k: Lake) -> DataFrame:
    runs = k.events.select(F.col("user_id").alias("step"), F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "view", "RUNNING").otherwise("FAILED").alias("status"), F.col("event_ts").alias("at"))
    return serving.watermark(runs)


@query("e", "SELECT event_type, count(*) AS n FROM e WHERE event_ts > TIMESTAMP '2024-01-20' - INTERVAL 48 HOUR AND event_ts <= TIMESTAMP '2024-01-20' GROUP BY 1")
def metric_recent_stream(k: Lake) -> DataFrame:
    """Counts of the last hours before an explicit now."""
    now = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    recent = (F.col("event_ts") > now - F.make_interval(hours=F.lit(48))) & (F.col("event_ts") <= now)
    return k.events.where(recent).groupBy("event_type").agg(F.count("*").alias("n"))


def metrics_over(k: Lake) -> Metrics:
    """The readers over marts built from the tables; the events stand for the run log."""
    log = k.events.select(F.col("event_id").cast("string").alias("step"), F.when(F.col("event_type") == "purchase", "SUCCESS").otherwise("FAILED").alias("status"), F.col("event_ts").alias("at"))
    return Metrics(k.spark, scratch(k), lambda name: getattr(marts, name)(k), lambda: log)


_DAILY = "SELECT order_ts::DATE AS date, channel, count(*) AS orders, coalesce(sum(amount) FILTER (recognised), 0)::DOUBLE AS revenue FROM o GROUP BY 1, 2"


@query("o", f"SELECT date, channel, orders, revenue FROM ({_DAILY}) WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-02-28' AND channel = '1-URGENT'")
def metric_daily_sales(k: Lake) -> DataFrame:
    """Days of a year of one channel that had orders."""
    got = metrics_over(k).daily_sales(date(1996, 3, 1), date(1997, 2, 28), "1-URGENT")
    return got.where("orders > 0").select("date", "channel", "orders", "revenue")


@query("o", "SELECT DISTINCT channel FROM o")
def metric_channels(k: Lake) -> DataFrame:
    return metrics_over(k).channels()


@query("o", "WITH f AS (SELECT customer_id, date_trunc('month', min(order_ts))::DATE AS cohort FROM o WHERE recognised GROUP BY 1) SELECT cohort, datediff('month', cohort, date_trunc('month', order_ts)::DATE) AS months_since, count(DISTINCT customer_id) AS active FROM o JOIN f USING (customer_id) WHERE recognised GROUP BY 1, 2 HAVING months_since <= 6")
def metric_cohort_retention(k: Lake) -> DataFrame:
    return metrics_over(k).cohort_retention(6).select("cohort", "months_since", "active")


@query("pay", "SELECT processed_ts::DATE AS date, payment_method, count(*) AS attempts FROM pay WHERE processed_ts::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' GROUP BY 1, 2")
def metric_payment_health(k: Lake) -> DataFrame:
    return metrics_over(k).payment_health(date(1996, 1, 1), date(1996, 6, 30)).select("date", "payment_method", "attempts")


@query("", "SELECT 'bronze' AS consumer_group, 'events' AS topic, count(*) AS current_offset, count(*) AS log_end_offset, 0::BIGINT AS lag FROM events")
def metric_consumer_lag(k: Lake) -> DataFrame:
    """Where a group stands after it has read all, added over partitions."""
    group = topics.Group(k.spark, topic(k), scratch(k), "bronze")
    group.consume(strict)
    return consumer_lag(group.lag()).groupBy("consumer_group", "topic").agg(*[F.sum(c).alias(c) for c in ("current_offset", "log_end_offset", "lag")])
