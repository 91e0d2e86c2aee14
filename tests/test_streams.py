"""Closed windows with late rows and a restart; two consumer groups with a crash between write and commit; lag as a series."""

from __future__ import annotations

import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewater.streaming import closing, flows, topics

ROWS = "ts timestamp, metric string, dimension string"
DAY = dt.datetime(2024, 1, 1)


def put(spark, path, seconds, dimension="a"):
    rows = [(DAY + dt.timedelta(seconds=s), "events", dimension) for s in seconds]
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(path)


def now_at(df):
    return {(int((r["window_start"] - DAY).total_seconds()), r["dimension"]): (r["value"], r["is_closed"]) for r in df.collect()}


def test_windows_close_with_late_rows_and_a_restart(spark, tmp_path):
    topic, home = f"{tmp_path}/in", f"{tmp_path}/home"
    go = lambda: now_at(closing.run(flows.from_files(spark, topic, ROWS, 1), home, "60 seconds", "30 seconds"))
    put(spark, topic, [0, 10, 59, 61, 62])
    assert go() == {(0, "a"): (3, False), (60, "a"): (2, False)}
    # a late row of an open window counts; the rows at 200 s put the watermark at 240 - 90 = 150 s
    put(spark, topic, [30, 125])
    put(spark, topic, [200])
    assert go() == {(0, "a"): (4, True), (60, "a"): (2, True), (120, "a"): (1, False), (180, "a"): (1, False)}
    # after the restart: rows of closed windows are dropped, those of open ones count, closed counts stay
    put(spark, topic, [5, 100, 130, 140])
    assert go() == {(0, "a"): (4, True), (60, "a"): (2, True), (120, "a"): (3, False), (180, "a"): (1, False)}
    put(spark, topic, [3600], "b")
    assert go() == {(0, "a"): (4, True), (60, "a"): (2, True), (120, "a"): (3, True), (180, "a"): (1, True), (3600, "b"): (1, False)}
    # each shard of a window is emitted closed once
    updates = spark.read.schema(closing.OUT).parquet(f"{home}/updates/epoch=*")
    assert updates.where("is_closed").groupBy(*closing.KEY).count().agg(F.max("count")).first()[0] == 1


def test_a_hot_dimension_is_dealt_over_shards(spark, tmp_path):
    put(spark, f"{tmp_path}/in", range(0, 50))
    got = closing.run(flows.from_files(spark, f"{tmp_path}/in", ROWS), f"{tmp_path}/home")
    assert now_at(got) == {(0, "a"): (50, False)}
    assert spark.read.schema(closing.OUT).parquet(f"{tmp_path}/home/updates/epoch=*").select("shard").distinct().count() > 3


def test_the_sessions_state_store_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with closing.rocks(spark):
        assert spark.conf.get(name) == closing.ROCKS
    assert spark.conf.get(name, None) == before


# -- groups -----------------------------------------------------------------------

SCHEMA = "n bigint, kind string"


def parse(records):
    return topics.parsed(records, SCHEMA, ["n", "kind"], {"bad_kind": F.col("record.kind").isin("x", "y")})


def fill(spark, path, numbers):
    value = {0: None, 1: "", 2: "{", 3: "[1]", 4: '{"n": "five", "kind": "x"}', 5: '{"n": 5}', 6: '{"n": 6, "kind": "z"}', 7: '{"kind": "y", "n": 7, "more": 1}'}
    rows = [(i, f"k{i % 5}", value[i] if i in value else json.dumps({"n": i, "kind": "xy"[i % 2]})) for i in numbers]
    topics.produce(spark.createDataFrame(rows, "i bigint, k string, v string").coalesce(1), path, "t", "k", "i", F.col("v"))


ERRORS = {0: "empty", 1: "empty", 2: "not_json", 3: "not_json", 4: "not_json", 5: "missing_field", 6: "bad_kind"}


def test_what_is_wrong_with_a_record(spark, tmp_path):
    fill(spark, f"{tmp_path}/t", range(12))
    got = {r["offset"]: (r["error_type"], r["record"]) for r in parse(spark.read.parquet(f"{tmp_path}/t")).collect()}
    assert {i: e for i, (e, _) in got.items() if e} == ERRORS
    assert all((e is None) != (r is None) for e, r in got.values()) and tuple(got[7][1]) == (7, "y")


def test_each_group_sees_every_record_once_through_a_crash(spark, tmp_path):
    topic = f"{tmp_path}/t"
    fill(spark, topic, range(20))
    fill(spark, topic, range(20, 40))
    fill(spark, topic, range(40, 60))
    one, two = (topics.Group(spark, topic, f"{tmp_path}/{n}", n) for n in ("one", "two"))

    def crash(epoch):
        if epoch == 1:
            raise RuntimeError("lost between write and commit")

    with pytest.raises(Exception, match="lost between write and commit"):
        one.consume(parse, max_files=1, hook=crash)
    assert {r["offset"] for r in one.rows(SCHEMA).collect()} | {r["offset"] for r in one.dead().collect()} == set(range(40))  # written, not committed
    two.consume(parse)  # goes its own way
    again = []
    one.consume(parse, max_files=1, hook=again.append)
    assert again == [1, 2]  # the batch is repeated, then the rest
    for group in (one, two):
        seen = Counter(r["offset"] for r in group.rows(SCHEMA).collect()) + Counter(r["offset"] for r in group.dead().collect())
        assert seen == Counter(range(60))
    fill(spark, topic, range(60, 70))
    two.consume(parse)
    assert {r["offset"] for r in two.rows(SCHEMA).collect()} == set(range(7, 70)) and one.rows(SCHEMA).count() == 53
    letters = {r["offset"]: r for r in one.dead().collect()}
    assert {i: r["error_type"] for i, r in letters.items()} == ERRORS
    assert (letters[2]["topic"], letters[2]["consumer_group"], bytes(letters[2]["raw"]), letters[5]["error_detail"]) == ("t", "one", b"{", "kind")
    assert letters[2]["partition"] == spark.read.parquet(topic).where("offset = 2").first()["partition"] and letters[0]["raw"] is None
    counts = {(r["error_type"], r["consumer_group"]): r["n"] for r in topics.report(one.dead().union(two.dead())).collect()}
    assert counts == {(e, g): n for e, n in Counter(ERRORS.values()).items() for g in ("one", "two")}


def test_lag_falls_and_has_a_ceiling(spark, tmp_path):
    topic = f"{tmp_path}/t"
    for b in range(4):
        fill(spark, topic, range(b * 25, b * 25 + 25))
    group = topics.Group(spark, topic, f"{tmp_path}/g", "g")
    codes = []
    group.consume(parse, max_files=1, hook=lambda epoch: codes.append(topics.exit_code(group.lag(), 30)))
    by_epoch = {r["epoch"]: r["lag"] for r in group.lag().groupBy("epoch").agg(F.sum("lag").alias("lag")).collect()}
    assert by_epoch == {0: 75, 1: 50, 2: 25, 3: 0} and codes == [2, 2, 0, 0]
    partitions = {(r["partition"], r["epoch"]): (r["current_offset"], r["log_end_offset"]) for r in group.lag().collect()}
    sizes = {r["partition"]: r["count"] for r in spark.read.parquet(topic).groupBy("partition").count().collect()}
    assert {p: partitions[p, 3] for p in sizes} == {p: (n, n) for p, n in sizes.items()}
    fill(spark, topic, range(100, 140))  # a batch later the group is behind what it knew
    group.consume(parse)
    assert group.lag().agg(F.max("epoch"), F.max("log_end_offset")).first()[0] == 4
    assert topics.exit_code(spark.createDataFrame([], "consumer_group string, topic string, partition int, epoch bigint, lag bigint"), 0) == 0


def test_finish_has_no_limit_of_its_own(spark, tmp_path):
    class Slow:
        def awaitTermination(self, *seconds):  # noqa: N802
            assert not seconds
            return None

        def exception(self):
            return None

    flows.finish(Slow())
    stuck = flows.from_files(spark, str(tmp_path), ROWS).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").start()
    with pytest.raises(TimeoutError):
        flows.finish(stuck, 1)
    assert not stuck.isActive
