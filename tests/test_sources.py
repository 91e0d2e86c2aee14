"""Readers, writers and streams on small files."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.sources import readers, writers
from tidewater.streaming import flows

COLUMNS = ["id", "name"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("feeds"))
    writers.feeds(spark.range(7).select(F.col("id"), F.concat(F.lit("n"), "id").alias("name")), top, page_size=3)
    return top


def test_feeds_come_back(spark, folder):
    want = {(str(i), f"n{i}") for i in range(7)}
    for df in (readers.csv_text(spark, f"{folder}/csv", COLUMNS), readers.json_lines(spark, f"{folder}/jsonl", COLUMNS), readers.json_array(spark, f"{folder}/array.json", COLUMNS), readers.paged(spark, folder, "page-0001.json", COLUMNS)):
        assert {tuple(r) for r in df.select(*COLUMNS).collect()} == want
        assert [t for _, t in df.dtypes] == ["string", "string"]


@pytest.mark.parametrize(("pages", "error"), [({"a": '{"has_more": true, "next_cursor": "b"}'}, FileNotFoundError), ({"a": '{"has_more": true, "next_cursor": "a"}'}, ValueError)])
def test_broken_cursors(pages, error):
    def read(path):
        name = path.split("/")[-1]
        if name not in pages:
            raise FileNotFoundError(path)
        return pages[name]

    with pytest.raises(error):
        readers.page_paths("x", "a", read)


def fetch(after, since):
    at = 0 if after is None else after
    rows = [(i, f"r{i}") for i in range(at, min(at + 3, 8)) if i >= int(since or 0)]
    return rows, at + 3 if at + 3 < 8 else None


def test_keyset_source(spark):
    spark.dataSource.register(readers.KeysetSource)
    df = spark.read.format("keyset").options(module="tests.test_sources", function="fetch", schema="id long, name string", since="4").load()
    assert sorted(r["id"] for r in df.collect()) == [4, 5, 6, 7]


def test_parquet_probe(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    assert readers.parquet(spark, f"{tmp_path}/a", f"{tmp_path}/none*").count() == 3
    with pytest.raises(FileNotFoundError):
        readers.parquet(spark, f"{tmp_path}/none*")


def test_bronze_and_rebuild(spark, tmp_path):
    at = dt.datetime(2024, 1, 2, 3)
    df = spark.createDataFrame([("1",), ("2",)], "order_id string")
    for _ in range(2):
        path = writers.bronze(df, str(tmp_path), "oltp", "orders", "run", "f", at, ["order_id"])
    got = spark.read.parquet(path)
    assert got.count() == 4 and got.select("_record_hash").distinct().count() == 2
    writers.rebuild(spark.range(5), f"{tmp_path}/t")
    writers.rebuild(spark.range(2), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    writers.upsert_table(spark.range(1, 4), f"{tmp_path}/t", ["id"])
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [0, 1, 2, 3]
    assert writers.load_reconciled(spark.range(3), f"{tmp_path}/t", "id bigint") == 3
    with pytest.raises(TypeError):
        writers.load_reconciled(spark.range(3), f"{tmp_path}/t", "id int")
    assert not writers.quarantine(spark.range(0), f"{tmp_path}/q") and writers.quarantine(spark.range(1), f"{tmp_path}/q")
    assert not writers.quarantine(spark.range(0), f"{tmp_path}/q") and spark.read.schema("id long").parquet(f"{tmp_path}/q").count() == 0


def test_run_log(spark, tmp_path):
    now = iter(dt.datetime(2024, 1, 1, h) for h in range(9)).__next__
    writers.logged_run(spark, f"{tmp_path}/log", "build", lambda: 3, now)
    with pytest.raises(ZeroDivisionError):
        writers.logged_run(spark, f"{tmp_path}/log", "build", lambda: 1 // 0, now)
    log = spark.read.parquet(f"{tmp_path}/log")
    assert sorted(r["status"] for r in log.collect()) == ["FAILED", "RUNNING", "RUNNING", "SUCCESS"]


def test_tickets(spark):
    schema = "ticket_id string, customer_id string, status string, resolved_ts timestamp"
    t = spark.createDataFrame([("T000009", "C1", "open", None), ("T000002", "C1", "resolved", dt.datetime(2024, 1, 1))], schema)
    c = spark.createDataFrame([("C1",)], "customer_id string")
    assert writers.add_ticket(t, c, {"customer_id": "C1", "status": "open"}).first()["ticket_id"] == "T000010"
    with pytest.raises(LookupError):
        writers.add_ticket(t, c, {"customer_id": "C2"})
    now = dt.datetime(2024, 5, 5)
    assert {r["ticket_id"]: r["resolved_ts"] for r in writers.patch_ticket(t, "T000009", now, status="resolved").collect()}["T000009"] == now
    assert {r["ticket_id"]: r["resolved_ts"] for r in writers.patch_ticket(t, "T000002", now, status="open").collect()}["T000002"] is None


def test_transform_results():
    results = {"results": [{"unique_id": "test.p.unique_orders", "status": "fail", "failures": 3}, {"unique_id": "model.p.orders", "status": "success"}]}
    manifest = {"nodes": {"test.p.unique_orders": {"resource_type": "test", "name": "unique_orders", "depends_on": {"nodes": ["model.p.orders"]}}, "model.p.orders": {"resource_type": "model"}}}
    assert readers.transform_results(results, manifest) == [{"name": "unique_orders", "target": "orders", "status": "fail", "failures": 3, "message": ""}]


def test_keys_and_offsets(spark):
    with pytest.raises(Exception, match="id is null"):
        flows.keyed(spark.createDataFrame([(None,)], "id long"), "id").collect()
    progress = {"sources": [{"description": "k", "endOffset": '{"t": {"0": 5, "1": 7}}', "latestOffset": '{"t": {"0": 9, "1": 7}}'}]}
    assert flows.offsets_lag(progress) == [("k", 4)]


def test_watermarked_counts_close(spark, tmp_path):
    schema = "ts timestamp, metric string, dimension string"
    for i, n in enumerate((0, 600)):
        spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n), "events", "_total")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = flows.tumbling(flows.from_files(spark, f"{tmp_path}/in", schema, 1), "60 seconds", "10 seconds")
    got = flows.run_to_table(s, "append", f"{tmp_path}/cp")
    assert got.count() <= 1
