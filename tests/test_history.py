"""As-of joins on hot keys, and snapshots merged one by one against the history from the whole log."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import materialise, scd2
from tidewater.operators.snapshots import Snapshots

VERSIONS = "vk long, region string, name string, valid_from timestamp, valid_to timestamp"
day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def ranged(fact, versions):
    """The join as a condition."""
    cond = (fact["k"] == versions["vk"]) & (fact["r"] == versions["region"]) & (fact["at"] >= versions["valid_from"]) & (fact["at"] < versions["valid_to"])
    return fact.join(versions, cond, "left")


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(8)
    versions = []
    for k in range(60):
        for r in "ab":
            at = sorted(rng.sample(range(400), 120 if k == 7 else rng.randint(1, 5)))
            versions += [(k, r, f"{k}{r}{i}", day(x), day(y)) for i, (x, y) in enumerate(zip(at, [*at[1:], 500])) if rng.random() < 0.9]
    facts = [(i, 7 if rng.random() < 0.4 else rng.choice([None, *range(70)]), rng.choice("ab"), None if i % 50 == 0 else day(rng.randint(0, 520) if i % 3 else 100), "x") for i in range(20_000)]
    return spark.createDataFrame(facts, "id long, k long, r string, at timestamp, _x string"), spark.createDataFrame(versions, VERSIONS)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_as_of_is_the_range_join(frames, how):
    fact, versions = frames
    got = scd2.as_of(fact, versions, [("k", "vk"), ("r", "region")], "at", how)
    assert got.columns == fact.columns + versions.columns
    want = ranged(fact, versions)
    want = want if how == "left" else want.where("vk IS NOT NULL")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_a_hot_key_is_cut_into_even_pieces(frames):
    """A key with four tenths of the facts, a third of its facts at one instant: no piece above a task's mean."""
    fact, _ = frames
    row = fact.select(F.col("k").alias("_k0"), F.col("at").alias("_t"))
    cuts = scd2.hot_cuts(row, ["_k0"]).collect()
    assert {7} <= {r["_k0"] for r in cuts} and all(len(r["_cuts"]) == scd2.CUTS - 1 for r in cuts)
    plan = scd2.as_of(fact, frames[1], [("k", "vk"), ("r", "region")], "at")
    exploded = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in exploded and "Window" in exploded
    mean = fact.count() / 8
    hot = next(r["_cuts"] for r in cuts if r["_k0"] == 7)
    pieces = {}
    for r in fact.where("k = 7 AND at IS NOT NULL").select("id", "at").collect():
        low, high = sum(c < r["at"] for c in hot), sum(c <= r["at"] for c in hot)
        p = low + r["id"] % (high - low + 1)
        pieces[p] = pieces.get(p, 0) + 1
    assert max(pieces.values()) < mean / 2 and len(pieces) > 50


def test_no_versions_and_no_facts(spark, frames):
    fact, versions = frames
    keys = [("k", "vk"), ("r", "region")]
    assert scd2.as_of(fact.limit(0), versions, keys, "at").collect() == []
    none = scd2.as_of(fact, versions.limit(0), keys, "at")
    assert none.count() == fact.count() and none.where("name IS NOT NULL").isEmpty()


# -- snapshots --------------------------------------------------------------------


def log_of(spark, seed=4, n=40):
    rng = random.Random(seed)
    customers, log = [], []
    for i in range(n):
        state = {"tier": "t0", "segment": "s0", "is_deleted": "false"}
        for j, when in enumerate(sorted(rng.sample(range(12), rng.randint(0, 5)))):
            f = rng.choice(["tier", "segment", "is_deleted"])
            new = {"is_deleted": "false" if state["is_deleted"] == "true" else "true"}.get(f, f"v{rng.randint(0, 2)}")
            log.append((i, day(when), f, state[f], new, j))
            state[f] = new
        customers.append((i, state["tier"], state["segment"], state["is_deleted"], day(rng.randint(0, 8)).date()))
    return spark.createDataFrame(customers, "customer_id long, tier string, segment string, is_deleted string, signup_date date"), spark.createDataFrame(log, "customer_id long, changed_at timestamp, field string, old_value string, new_value string, seq long")


def test_snapshots_one_by_one_are_the_history(spark, tmp_path):
    customers, log = log_of(spark)
    end = day(20)
    instants = [r[0] for r in log.select("changed_at").distinct().orderBy("changed_at").collect()] + [end]
    store = Snapshots(spark, str(tmp_path / "dim"), "customer_id", ["tier", "segment"], buckets=4)
    for at in instants:
        store.take(scd2.point_in_time(customers, log, F.lit(at), "customer_id", ["tier", "segment", "is_deleted"], "signup_date"), F.lit(at), F.col("is_deleted") == "true")
    whole = scd2.close_versions(scd2.history(customers, log, F.lit(end), fields=("tier", "segment")), "customer_id", "opened_at")
    got = store.versions().select(*whole.columns)
    assert got.count() == whole.count() > 50 and got.exceptAll(whole).isEmpty()
    assert scd2.overlaps(got, "customer_id").isEmpty()


def test_only_changed_partitions_are_written(spark, tmp_path):
    path = tmp_path / "dim"
    store = Snapshots(spark, str(path), "k", ["v"], buckets=8)
    state = {k: "a" for k in range(40)}
    frame = lambda s: spark.createDataFrame(list(s.items()), "k long, v string")
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    assert store.take(frame(state), F.lit(day(1))) == 40
    before = files()
    assert store.take(frame(state), F.lit(day(2))) == 0 and files() == before
    state[3] = "b"
    assert store.take(frame(state), F.lit(day(3))) == 1
    new = files() - before
    assert {f.split("bucket=")[1].split("/")[0] for f in new} == {str(spark.sql("SELECT pmod(xxhash64(3L), 8)").first()[0])}
    assert store.take(frame(state), F.lit(day(3))) == 0  # taken twice
    with pytest.raises(ValueError):
        store.take(frame(state), F.lit(day(2)))
    got = {(r["k"], r["v"], r["version"], r["valid_from"], r["valid_to"], r["is_current"]) for r in store.versions().where("k IN (3, 4)").collect()}
    first, last = dt.datetime(1900, 1, 1), dt.datetime(9999, 12, 31)
    assert got == {(3, "a", 1, first, day(3), False), (3, "b", 2, day(3), last, True), (4, "a", 1, first, last, True)}


def test_odd_states(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "dim"), "k", ["v"], buckets=2)
    rows = [(1, None, False), (1, None, False), (2, "x", True), (None, "y", False)]
    state = spark.createDataFrame(rows, "k long, v string, d boolean").withColumn("bucket", F.lit("extra"))
    assert store.take(state, F.lit(day(1)), F.col("d")) == 1  # gone from the start: never seen
    assert [(r["k"], r["v"]) for r in store.versions().collect()] == [(1, "")]


def test_a_table_is_written_once_until_its_input_changes(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(f"{tmp_path}/in").agg(F.count("*").alias("n"))

    read = lambda: materialise.once(spark, "t", [f"{tmp_path}/in"], build).first()["n"]
    assert (read(), read(), len(built)) == (3, 3, 1)
    spark.range(2).write.mode("append").parquet(f"{tmp_path}/in")
    assert (read(), len(built)) == (5, 2)


@pytest.mark.parametrize(("name", "unused"), [("fact_payments", "l_partkey"), ("join_asof_scd2", "o_totalprice")])
def test_as_of_carries_what_is_shown(spark, sf, name, unused):
    from tidewater.plans import catalogue

    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert unused not in plan
