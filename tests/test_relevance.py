"""Relevance against comparing all with all; the measures against Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import relevance

DOCS, ASKS = "id long, text string, intent string", "query_id long, intents array<string>, needles array<string>"


def brute(docs, asks, fold=True):
    low = (lambda s: s.lower()) if fold else (lambda s: s)
    out = set()
    for q, intents, needles in asks:
        needles = [low(n) for n in needles or [] if n]
        if not needles and intents is None:
            continue
        out |= {(q, i) for i, t, label in docs if (intents is None or label in intents) and (not needles or t is not None and all(n in low(t) for n in needles))}
    return out


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(6)
    vocabulary = ["the", "order", "was", "billed", "twice", "refund", "Please", "naïve", "a", "x-ray", "漢字", "co,lon", "end."]
    docs = [(i, rng.choice([" ", "  ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 30))), rng.choice(["bill", "ship", None])) for i in range(300)]
    docs += [(900, None, "bill"), (901, "", "ship"), (902, "word " * 30_000 + "billed twice for it all", "bill"), docs[3]]
    asks = []
    for q in range(60):
        _, t, _ = rng.choice(docs[:300])
        at = rng.randint(0, max(0, len(t) - 1))
        needles = [t[at : at + rng.choice([1, 2, 4, 9, 20, 40])] for _ in range(rng.randint(1, 2))]
        asks.append((q, rng.choice([None, ["bill"], ["bill", "ship"], ["none"]]), needles))
    asks += [(100, ["bill"], None), (101, ["ship"], []), (102, None, None), (103, None, ["billed twice for it all"]), (104, None, ["nowhere at all to be found"]), (105, None, [None, ""]), (106, ["bill"], ["", "漢字"]), (107, None, [" "]), (107, None, [" "])]
    return docs, asks, spark.createDataFrame(docs, DOCS).withColumn("gram", F.lit("extra")), spark.createDataFrame(asks, ASKS).withColumn("n", F.lit(1))


@pytest.mark.parametrize("fold", [True, False])
def test_relevance_is_comparing_all(frames, fold):
    docs, asks, d, q = frames
    got = [tuple(r) for r in relevance.relevant(d, q, fold).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, asks, fold) and len(got) > 100


def test_no_nested_loop(frames):
    _, _, d, q = frames
    plan = relevance.relevant(d, q)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_texts_of_candidates_alone_are_shuffled(spark, tmp_path):
    from tests.test_textindex import moved

    junk = F.expr("array_join(transform(sequence(1, 4000), i -> char(cast(192 + pmod(xxhash64(id, i), 60) as int))), '')")
    spark.range(0, 600, numPartitions=4).select("id", F.concat(junk, F.lit(" a passage of number "), "id", F.lit(" or so ")).alias("text"), F.lit("x").alias("intent")).write.parquet(path := str(tmp_path / "texts"))
    asked = spark.createDataFrame([(q, None, [f"passage of number {3 * q} or", f"of number {3 * q}"]) for q in range(10)], ASKS)
    found = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for sides whose size isn't known beforehand
    assert moved(spark, lambda: found.extend(relevance.relevant(spark.read.parquet(path), asked, fold=False).collect())) < 0.3
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, found)) == [(q, 3 * q) for q in range(10)]


def test_candidates_beyond_a_broadcast(frames, monkeypatch):
    docs, asks, d, q = frames
    monkeypatch.setattr(relevance, "FEW", 0)
    assert {tuple(r) for r in relevance.relevant(d, q).collect()} == brute(docs, asks)


def test_nothing_asked_or_there(spark, frames):
    _, _, d, q = frames
    assert relevance.relevant(d.limit(0), q).collect() == [] == relevance.relevant(d, q.limit(0)).collect()
    missing = relevance.unmatched(q, relevance.relevant(d, q)).distinct().collect()
    assert {r[0] for r in missing} >= {102, 104, 105}


def test_measures(spark):
    ranked = [("h", 1, 10, 1, 0.9), ("h", 1, 11, 2, 0.8), ("h", 2, 12, 1, 0.5), ("h", 2, 13, 2, None), ("h", 3, 14, 1, 0.3), ("h", 4, 15, 1, 0.75), ("l", 1, 10, 1, None), ("l", 3, 14, 1, None)]
    answers = [(1, 11), (2, 99), (2, 12), (3, 14)]
    asks = [(s, q, e) for s in "hl" for q, e in ((1, True), (2, True), (3, False), (4, False), (5, True))]
    got = {r["strategy"]: r.asDict() for r in relevance.measures(spark.createDataFrame(ranked, "strategy string, query_id long, id long, rank int, similarity double"), spark.createDataFrame(answers, "query_id long, id long"), spark.createDataFrame(asks, "strategy string, query_id long, expects_answer boolean")).collect()}
    h = got["h"]
    assert (h["answerable"], h["recall"], h["precision"], h["mrr"]) == (3, pytest.approx(2 / 3, abs=1e-6), pytest.approx((1 / 2 + 1 / 2 + 0) / 3, abs=1e-6), pytest.approx((1 / 2 + 1 + 0) / 3, abs=1e-6))
    assert (h["abstention_accuracy"], h["false_abstentions"], h["lowest_answerable"], h["highest_unanswerable"], h["separation"]) == (0.5, 2, -1.0, 0.75, -1.75)
    assert got["l"]["abstention_accuracy"] is None and got["l"]["recall"] == 0.0 and got["l"]["false_abstentions"] == 3
