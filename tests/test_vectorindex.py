"""Exact and approximate vector search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import retrieval, vectorindex
from tidewater.operators.vectorindex import VectorIndex, exact_search

VECTORS = "id bigint, v array<double>"


def brute(rows, asked, k):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, u in asked:
        u = np.array(u, float)
        cos = sorted((-round(float(u @ v / np.linalg.norm(u) / np.linalg.norm(v)), 6), i) for i, v in good)
        out |= {(q, i, -s, r) for r, (s, i) in enumerate(cos[:k], 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-9, 10, 6).astype(float).tolist()) for i in range(300)]
    same = [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]
    rows += [(1000 + i, same) for i in range(150)]  # a third are copies
    return rows + [(2000, None), (2001, []), (2002, [0.0] * 6), (2003, [float("nan")] + [1.0] * 5), (2004, [None] + [1.0] * 5), (2005, [float("inf")] + [1.0] * 5), (2006, [1.0] * 5)]


def asked_of(rows):
    return [(i, v) for i, v in rows if i % 25 == 0 and i < 2000 and any(v)]


def test_exact_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(vectorindex, "BLOCK", 5)
    asked = asked_of(rows)
    got = exact_search(spark.createDataFrame(rows, VECTORS), spark.createDataFrame([*asked, (-1, None), (-2, [0.0] * 6)], "query_id bigint, q array<double>"), 7)
    assert {tuple(r) for r in got.collect()} == brute(rows, asked, 7)


def test_all_lists_are_exact(spark, rows, tmp_path, monkeypatch):
    """Probing every list is the exact search; a long list lies in parts."""
    monkeypatch.setattr(vectorindex, "PART", 40)
    df = spark.createDataFrame(rows, VECTORS).withColumn("list", F.lit("extra"))
    index = VectorIndex(spark, str(tmp_path / "ix"), buckets=4).build(df, lists=9)
    asked = asked_of(rows)
    queries = spark.createDataFrame(asked, "query_id bigint, q array<double>")
    found = index.search(queries, 7, probes=9)
    assert {tuple(r) for r in found.collect()} == brute(rows, asked, 7)
    parts = spark.table(index._table).groupBy("list", "part").count()
    assert parts.agg(F.max("count"), F.max("part")).first()[0] < 90 and parts.agg(F.max("part")).first()[0] >= 2
    again = VectorIndex(spark, str(tmp_path / "ix"), buckets=4)  # opened from its folder
    assert {tuple(r) for r in again.search(queries, 7, probes=9).collect()} == brute(rows, asked, 7)


def test_lists_are_not_shuffled(spark, rows, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "ix"), buckets=4).build(spark.createDataFrame(rows, VECTORS))
    queries = spark.createDataFrame(asked_of(rows), "query_id bigint, q array<double>").hint("merge")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.search(queries, 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[plan.index("SortMergeJoin") :]
    assert join.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in join  # the questions' side alone


def test_questions_are_not_broadcast(spark, rows, tmp_path):
    """A question is carried once a list; however small Spark takes the questions for, neither side goes through the driver."""
    index = VectorIndex(spark, str(tmp_path / "ix"), buckets=4).build(spark.createDataFrame(rows, VECTORS))
    found = index.search(spark.createDataFrame(asked_of(rows), "query_id bigint, q array<double>"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 1 and "Bucketed: true" in plan


def test_questions_in_blocks(spark, rows, tmp_path, monkeypatch):
    """Several blocks of questions, a few scores at a time, ids of text, and copies of one id in several parts of a list."""
    for name, n in (("BLOCK", 4), ("SCORES", 50), ("PART", 40)):
        monkeypatch.setattr(vectorindex, name, n)
    same = [(i if i < 1000 else 1000, v) for i, v in rows]
    index = VectorIndex(spark, str(tmp_path / "ix"), buckets=4).build(spark.createDataFrame([(f"v{i:05}", v) for i, v in same], "id string, v array<double>"), lists=9)
    assert spark.table(index._table).groupBy("list", "part").count().agg(F.max("count")).first()[0] < 90
    asked = asked_of(rows)
    got = index.search(spark.createDataFrame(asked, "query_id bigint, q array<double>"), 7, probes=9).collect()
    assert len(got) == 7 * len(asked) and {(q, int(i[1:]), s, r) for q, i, s, r in got} == brute(same, asked, 7)


def test_few_pairs_are_ranked(spark, tmp_path, monkeypatch):
    """What is sorted by question is little of what the probed lists hold, and the best of all lists are found."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(4000)]
    asked, ranked, top = rows[::40], [], retrieval.top
    index = VectorIndex(spark, str(tmp_path / "ix"), buckets=4).build(spark.createDataFrame(rows, VECTORS))

    def counted(scored, by, k):
        ranked.append(scored.count())
        return top(scored, by, k)

    monkeypatch.setattr(retrieval, "top", counted)
    got = index.search(spark.createDataFrame(asked, "query_id bigint, q array<double>"), 7, probes=63)
    assert sum(ranked) < 100 * 4000 / 10
    assert {tuple(r) for r in got.collect()} == brute(rows, asked, 7)


def test_nothing_to_search(spark, tmp_path):
    empty = spark.createDataFrame([], VECTORS)
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id bigint, q array<double>")
    assert exact_search(empty, asked).collect() == []
    assert VectorIndex(spark, str(tmp_path / "ix")).build(empty).search(asked).collect() == []


def test_recall_of_the_tables(spark):
    """Every fiftieth vector of the larger tables: 95 of 100 of the five nearest, over the lists that the calibration chose."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    from tidewater.operators.materialise import scratch

    vectors, asked = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    index = VectorIndex(spark, scratch(spark, "vectors")).build(vectors)
    true = {(r["query_id"], r["id"]) for r in exact_search(vectors, asked, 5).collect()}
    got = {(r["query_id"], r["id"]) for r in index.search(asked, 5).collect()}
    probes, lists = index.probed
    print(f"recall {len(true & got) / len(true):.3f}, {probes} of {lists} lists")
    assert len(true & got) >= 0.95 * len(true) and len(true) == 200
    assert probes < lists


def test_clustered_vectors_need_few_lists(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(0, 0.2, 16)).tolist()) for i in range(3000)]
    index = VectorIndex(spark, str(tmp_path / "ix")).build(spark.createDataFrame(rows, VECTORS))
    probes, lists = index.probed
    assert probes <= lists // 4
