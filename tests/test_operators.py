"""Conformance, history, quality, retrieval, serving: controls that pass and mutations that fail."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalar as S
from tidewater.operators import conform, quality, retrieval, scd2, serving
from tidewater.spec import ENTITIES, Entity, Field, check_names, check_owner, check_unrestricted


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_record_hash_tells_null_places_and_borders(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("ab", "c", None), ("a", "bc", None), ("a", None, "b")], "x string, y string, z string")
    got = [r[0] for r in df.select(S.record_hash(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert len(set(got)) == 4 and got[0] == got[4]


def test_safe_cast_is_strict(spark):
    df = spark.createDataFrame([("3.7",), ("1e2",), ("2026",), ("12:30",), ("2026-13-45",), (" 7 ",), ("",), (None,)], "v string")
    got = rows(df.select(S.safe_cast(F.col("v"), "int"), S.safe_cast(F.col("v"), "date").cast("string"), S.safe_cast(F.col("v"), "timestamp").cast("string")))
    assert got == [(None, None, None), (None, None, None), (2026, None, None), (None,) * 3, (None,) * 3, (7, None, None), (None,) * 3, (None,) * 3]


SPEC = Entity("payments", "vendor", ("id",), (Field("id"), Field("amount", "decimal(12,2)", minimum=0), Field("kind", allowed=("a", "b")), Field("at", "timestamp", nullable=True)), "at")


@pytest.mark.parametrize(
    ("row", "reason"),
    [(("1", "2.50", "a", "2024-01-01"), None), (("", "2.50", "a", None), "missing:id"), (("1", "x", "a", None), "bad_type:amount"), (("1", "-1", "a", None), "out_of_range:amount"), (("1", "1", "c", None), "bad_enum:kind"), (("1", "1", " ", None), "missing:kind"), (("1", "1", "b", "31/02/2026"), "bad_type:at"), (("1", "-1", "c", "x"), "out_of_range:amount")],
)
def test_first_failing_rule(spark, row, reason):
    df = spark.createDataFrame([row], "id string, amount string, kind string, at string")
    assert df.select(conform.rules(SPEC)).first()[0] == reason


@pytest.mark.parametrize("name", sorted(ENTITIES))
def test_every_entity_can_be_judged(spark, name):
    spec = ENTITIES[name]
    bronze = spark.createDataFrame([], ", ".join(f"{c} string" for c in spec.columns))
    bronze = conform.with_lineage(bronze, "run", spec.source, "f", F.current_timestamp(), [spec.columns[0]])
    judged = conform.judge(bronze, spec)
    assert conform.good_rows(judged, spec).count() == conform.quarantined(judged).count() == 0


def test_conform_end_to_end(spark):
    raw = spark.createDataFrame([("1", "2", "a", "2024-01-01"), ("1", "2", "a", "2024-01-01"), ("1", "3", "a", "2024-01-02"), ("2", "x", "a", None)], "id string, amount string, kind string, at string")
    bronze = conform.with_lineage(raw, "r", "vendor", "f", F.lit(dt.datetime(2024, 2, 1)), ["id"])
    assert sorted(r["_batch_seq"] for r in bronze.collect()) == [1, 2, 3, 4]
    judged = conform.judge(bronze, SPEC)
    assert judged.count() == 3
    good = conform.good_rows(judged, SPEC)
    assert [(r["id"], str(r["amount"])) for r in good.collect()] == [("1", "3.00")]
    assert rows(conform.reasons(judged)) == [("bad_type:amount", 1)]


def test_incremental_twice_adds_nothing(spark):
    df = spark.createDataFrame([("1", "2024-01-01"), ("2", "bad"), ("3", "2024-03-01")], "id string, at string").withColumn("_record_hash", S.record_hash(F.col("id"), F.col("at")))
    first = conform.incremental(df, "at", "2024-02-01 00:00:00", df.limit(0))
    assert {r["id"] for r in first.collect()} == {"2", "3"}
    assert conform.incremental(df, "at", "2024-03-01 00:00:00", first).count() == 0


def test_numbering_is_gapless_with_ties(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    got = conform.number_rows(df, ["k", "id"], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))
    assert [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)


def test_guards():
    with pytest.raises(PermissionError):
        check_owner("files", "orders")
    check_owner("stream", "web_events")
    with pytest.raises(ValueError):
        check_names("files", "Orders; drop")
    with pytest.raises(PermissionError):
        check_unrestricted(["id", "email"])


def replay(customers, log, end):
    """A snapshot at every change instant and the end; new rows where state or liveness changes."""
    out = []
    instants = sorted({r["changed_at"] for r in log} | {end})
    for c in customers:
        mine = sorted((r for r in log if r["customer_id"] == c["customer_id"]), key=lambda r: (r["changed_at"], r["seq"]))
        last = None
        for at in instants:
            if c["signup_date"] > at.date():
                continue
            state = {}
            for f in ("loyalty_tier", "segment", "is_deleted"):
                past = [r for r in mine if r["field"] == f and r["changed_at"] <= at]
                later = [r for r in mine if r["field"] == f and r["changed_at"] > at]
                state[f] = past[-1]["new_value"] if past else later[0]["old_value"] if later else c[f]
            gone = state["is_deleted"] == "true"
            if gone and last is None:
                continue
            key = (last[0], last[1], True) if gone else (state["loyalty_tier"], state["segment"], False)
            if key != last:
                out.append((c["customer_id"], key[0], key[1], at, key[2]))
                last = key
    return sorted(out)


def test_history_is_the_replay(spark):
    rng = random.Random(4)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    customers, log = [], []
    for i in range(60):
        state = {"loyalty_tier": "t0", "segment": "s0", "is_deleted": "false"}
        for n, when in enumerate(sorted(rng.sample(range(40), rng.randint(0, 6)))):
            f = rng.choice(["loyalty_tier", "segment", "is_deleted", "city"])
            new = {"is_deleted": "false" if state["is_deleted"] == "true" else "true"}.get(f, f"v{rng.randint(0, 2)}")
            log.append({"customer_id": i, "changed_at": day(when), "field": f, "old_value": state.get(f, "x"), "new_value": new, "seq": n})
            state[f] = new
        customers.append({"customer_id": i, **state, "signup_date": day(rng.randint(0, 30)).date()})
    end = day(50)
    c = spark.createDataFrame(customers, "customer_id long, loyalty_tier string, segment string, is_deleted string, signup_date date")
    g = spark.createDataFrame(log, "customer_id long, changed_at timestamp, field string, old_value string, new_value string, seq long")
    got = scd2.history(c, g, F.lit(end)).collect()
    assert sorted((r["customer_id"], r["loyalty_tier"], r["segment"], r["opened_at"], r["is_tombstone"]) for r in got) == replay(customers, log, end)
    versions = scd2.close_versions(scd2.history(c, g, F.lit(end)), "customer_id", "opened_at")
    assert scd2.overlaps(versions, "customer_id").count() == 0
    fact = spark.createDataFrame([(i, day(n)) for i in range(60) for n in (0, 20, 45)], "cid long, at timestamp")
    assert scd2.as_of(fact, versions, [("cid", "customer_id")], "at").count() == fact.count()


def test_quality_arithmetic(spark):
    assert quality.outcome(0, 0, 0) == (0.0, "PASS")
    assert quality.outcome(100, 1, 1) == (1.0, "PASS") and quality.outcome(100, 2, 1)[1] == "FAIL"
    with pytest.raises(ValueError):
        quality.outcome(1, 2, 0)
    df = spark.createDataFrame([(1, None), (1, 2), (2, -1)], "k int, v int")
    assert rows(quality.invariant(df, F.col("v") > 0)) == [(3, 1)]
    assert rows(quality.unique_key(df, ["k"])) == [(3, 1)]
    assert rows(quality.not_empty(df, 4)) == [(1, 1)]
    assert rows(quality.not_null(df, "v")) == [(3, 1)] and rows(quality.accepted(df, "k", [1])) == [(3, 1)]
    parent = spark.createDataFrame([(1,)], "p int")
    assert rows(quality.referential(df, "k", parent, "p")) == [(3, 1)]
    checks = [quality.Check("ok", lambda: quality.not_empty(df)), quality.Check("bad", lambda: quality.unique_key(df, ["k"]), quality.WARN)]
    got = quality.run(spark, checks)
    assert [r["status"] for r in got.orderBy("check").collect()] == ["FAIL", "PASS"]
    assert quality.exit_code(got) == 0 and quality.exit_code(got, fail_on_warn=True) == 2
    means = {"success": ("PASS", "BLOCK"), "pass": ("PASS", "BLOCK"), "warn": ("FAIL", "WARN"), "fail": ("FAIL", "BLOCK"), "error": ("FAIL", "BLOCK"), "skipped": ("FAIL", "BLOCK"), "runtime error": ("FAIL", "BLOCK"), "??": ("FAIL", "BLOCK")}
    assert {s: quality.transform_status(s) for s in means} == means


@pytest.mark.parametrize(("totals", "ok"), [([100.0] * 99 + [5000.0], True), ([100.0] * 100, False)])
def test_distribution_control_and_mutation(spark, totals, ok):
    df = spark.createDataFrame([(t,) for t in totals], "t double")
    got = quality.distribution(df, [("spread", F.max("t") / F.avg("t"), 2, None)])
    assert got.first()["ok"] is ok


def test_keyset_pages_neither_repeat_nor_drop(spark):
    df = spark.range(23).select(F.timestamp_seconds(F.col("id") % 4).alias("ts"), "id")
    seen, after = [], None
    while True:
        page = serving.keyset_page(df, "ts", "id", 5, after).orderBy("ts", "id").collect()
        seen += [r["id"] for r in page]
        if not page[-1]["has_more"]:
            break
        after = (page[-1]["ts"], page[-1]["id"])
    assert len(seen) == 23 == len(set(seen))
    with pytest.raises(ValueError):
        serving.keyset_page(df, "ts", "id", 501)


def test_cursors_lead_on(spark):
    df = spark.range(23).select(F.timestamp_micros(F.col("id") % 4 + 1_700_000_000_123_456).alias("ts"), F.concat(F.lit("T|"), "id").alias("id"))
    seen, after = [], None
    while True:
        page = serving.keyset_page(df, "ts", "id", 5, after).orderBy("ts", "id").collect()
        seen += [(r["ts"], r["id"]) for r in page]
        if not page[-1]["has_more"]:
            break
        after = page[-1]["cursor"]
    assert seen == sorted(map(tuple, df.collect())) and len(seen) == 23
    for bad in ("", "x", "bm90IGEgdGltZXwx", "MjAyNC0wMS0wMQ==", "é"):
        with pytest.raises(ValueError, match="malformed cursor"):
            serving.keyset_page(df, "ts", "id", 5, bad)


def test_iso_times_to_millis(spark):
    rows = [("2024-01-01T00:00:00Z", 1704067200000), ("2024-01-01T02:00:00.123+02:00", 1704067200123), ("2024-01-01", 1704067200000), ("2024-01-01 00:00:01", 1704067201000), ("1969-12-31T23:59:59.999Z", -1), ("yesterday", None), ("", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, want long").select("t", "want", S.iso_millis(F.col("t")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_ratios_are_recomputed_not_summed(spark):
    df = spark.createDataFrame([("a", 5, 10), ("a", 0, 0), ("b", 0, 0)], "g string, n long, d long")
    got = {r["g"]: r["pct"] for r in serving.recompute(df, ["g"], ["n", "d"], {"pct": ("n", "d")}).collect()}
    assert got == {"a": 50.0, "b": None}
    with pytest.raises(ValueError):
        serving.require_additive(df.withColumn("nadd_x", F.lit(1)), "nadd_x")


def test_fusion_strategies(spark):
    lex = spark.createDataFrame([(1, 10, 2.0, 1), (1, 11, 1.0, 2)], "query_id long, id long, score double, rank long")
    vec = spark.createDataFrame([(1, 11, 0.9, 1), (1, 12, 0.8, 2)], "query_id long, id long, score double, rank long")
    assert [r["id"] for r in retrieval.fuse(lex, vec).orderBy("rank").collect()] == [11, 10, 12]
    only = retrieval.fuse(lex, vec, weights=(1.0, 0.0), require="lexical").orderBy("rank").collect()
    assert [(r["id"], r["similarity"]) for r in only] == [(10, None), (11, 0.9)]
    assert rows(retrieval.top_similarity(retrieval.fuse(lex, vec))) == [(1, 0.9, False)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, 5), (2, 6)], "k long, v long")
    new = spark.createDataFrame([(2, 7), (3, 8)], "k long, v long")
    assert sorted(rows(conform.upsert(old, new, ["k"]))) == [(1, 5), (2, 7), (3, 8)]
    assert sorted(rows(conform.upsert_adding(old, new, ["k"], "v"))) == [(1, 5), (2, 13), (3, 8)]
