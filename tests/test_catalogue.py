"""Every query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from tidewater.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_oracle(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in cur.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)
    assert len(catalogue.QUERIES) >= 100


def test_defects_are_there(spark, sf):
    """The feed holds each kind of defect that the rules look for."""
    rows = catalogue.QUERIES["quarantine_reason"](spark, sf).select("reason").distinct().collect()
    assert {r["reason"].split(":")[0] for r in rows} == {"missing", "bad_type", "bad_enum", "out_of_range"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_question_has_a_vector_side(spark):
    from tidewater.plans import catalogue

    big = "/root/testdata/sf0.1"
    asked = {r[0] for r in spark.read.parquet(f"{big}/benchmark.parquet").select("item_id").collect()}
    got = {r[0] for r in catalogue.QUERIES["vector_topk"](spark, big).select("query_id").distinct().collect()}
    assert len(asked) == 200 and got == asked
