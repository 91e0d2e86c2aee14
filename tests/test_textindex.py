"""The incremental index against rebuilds: changes, orphans, unchanged and unfinished runs."""

from __future__ import annotations

import hashlib
import os
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewater.functions import analyse
from tidewater.operators import retrieval, textindex
from tidewater.operators.textindex import TextIndex, fingerprint

UNITS = "doc_id string, id string, content string"


def frame(spark, texts):
    return spark.createDataFrame([(i.split("#")[0], i, t) for i, t in texts.items()], UNITS)


def state(index):
    rows = lambda df: sorted(map(tuple, df.collect()))
    chunks = index.chunks()
    return rows(index.postings()), rows(index.frequencies()), index.stats(), [] if chunks is None else rows(chunks.select("id", "doc_id", "content", "hash", "doc_len"))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if "/runs" not in d}


A = {"a#0": "running dogs run", "a#1": "the dogs barked at running cats", "b#0": "cats sleep", "c#0": "of the", "d#0": "a unique pelican", "e#0": None}
STEPS = [
    A | {"a#0": "running dogs ran far", "f#0": "new cats"},  # changed and new
    {k: v for k, v in A.items() if k not in ("a#1", "d#0")},  # a chunk and a document are gone
    A | {"b#0": "cats sleep sleep sleep"},
    {},  # all gone
    A,
]


def by_hand(texts, stemmed):
    """What ``state`` gives, counted in Python."""
    words = {}
    for i, t in texts.items():
        found = [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w and w not in analyse.STOP_WORDS]
        words[i] = [analyse.stem(w) for w in found] if stemmed else found
    postings = sorted((i, w, n, len(ws)) for i, ws in words.items() for w, n in Counter(ws).items())
    total = sum(map(len, words.values()))
    chunks = sorted((i, i.split("#")[0], t or "", hashlib.sha256((t or "").encode()).hexdigest(), len(words[i])) for i, t in texts.items())
    return postings, sorted(Counter(w for _, w, _, _ in postings).items()), (len(texts), total / len(texts) if texts else 0.0), chunks


@pytest.mark.parametrize("stemmed", [True, False])
def test_runs_equal_a_rebuild(spark, tmp_path, stemmed):
    index = TextIndex(spark, str(tmp_path / "ix"), stemmed, buckets=5)
    for i, texts in enumerate([A, *STEPS] if stemmed else [A, STEPS[0]]):
        index.refresh(frame(spark, texts))
        assert state(index) == by_hand(texts, stemmed), i


def test_unchanged_run_writes_nothing(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "ix"), buckets=5)
    first = index.refresh(frame(spark, A), fp="f", model="m")
    before = files(tmp_path)
    again = index.refresh(frame(spark, A), fp="f", model="m")
    assert files(tmp_path) == before
    assert (first.added, first.base) == (6, True)
    assert (again.chunks, again.skipped, again.added, again.changed, again.deleted, again.base) == (6, 6, 0, 0, 0, False)
    # the triple: another model or configuration takes all chunks again, and changes no term
    terms = state(index)
    other = index.refresh(frame(spark, A), fp="f", model="n")
    assert (other.changed, other.skipped) == (6, 0) and state(index) == terms
    assert index.refresh(frame(spark, A), fp="g", model="n").changed == 6


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "ix"), buckets=16)
    many = {f"x{i}#0": f"word{i} other{i} common" for i in range(60)}
    index.refresh(frame(spark, many))
    before = files(tmp_path / "ix" / "postings")
    index.refresh(frame(spark, many | {"x3#0": "word3 other3 common odd"}))
    after = files(tmp_path / "ix" / "postings")
    parts = lambda fs: {f.split("bucket=")[1].split("/")[0] for f in fs if "bucket=" in f}
    rewritten = parts(set(after) - set(before))
    assert 1 <= len(rewritten) <= 4 and len(parts(after)) > 10


def test_part_of_the_corpus(spark, tmp_path):
    """With whole=False, documents that aren't given stay; chunks that a given one lost go."""
    index = TextIndex(spark, str(tmp_path / "ix"), buckets=5)
    index.refresh(frame(spark, A))
    done = index.refresh(frame(spark, {"a#0": "running dogs run"}), whole=False)
    assert (done.deleted, done.skipped) == (1, 1)
    assert state(index) == by_hand({k: v for k, v in A.items() if k != "a#1"}, True)


def test_a_run_without_an_end_is_repaired(spark, tmp_path, monkeypatch):
    index = TextIndex(spark, str(tmp_path / "ix"), buckets=5)
    index.refresh(frame(spark, A))
    replace = index._replace

    def fail(df, name, touched):
        if name == "chunks":
            raise RuntimeError("lost")
        replace(df, name, touched)

    monkeypatch.setattr(index, "_replace", fail)
    with pytest.raises(RuntimeError):
        index.refresh(frame(spark, A | {"z#0": "stray words"}))
    monkeypatch.undo()
    assert not index.last()[1]
    assert index.refresh(frame(spark, A)).base
    assert state(index) == by_hand(A, True)
    assert [r["status"] for r in index.runs().orderBy("seq", "status").collect()] == ["RUNNING", "SUCCESS", "RUNNING", "RUNNING", "SUCCESS"]


def test_odd_units(spark, tmp_path):
    rows = [("d", "1", "bb"), ("d", "1", "aa"), ("d", None, "zz"), (None, "2", "cc")]
    index = TextIndex(spark, str(tmp_path / "ix"), buckets=3)
    index.refresh(spark.createDataFrame(rows, UNITS).withColumn("bucket", F.lit("extra")))
    assert {(r["id"], r["lexeme"]) for r in index.postings().collect()} == {("1", "aa"), ("2", "cc")}
    empty = TextIndex(spark, str(tmp_path / "none"))
    empty.refresh(spark.createDataFrame([], UNITS))
    assert state(empty) == ([], [], (0, 0.0), [])
    assert empty.bm25(spark.createDataFrame([(1, "aa")], "query_id int, lexeme string")).collect() == []


def test_stemmed_ranking(spark, tmp_path):
    """Words of one stem find each other, scored by the formula."""
    import math

    index = TextIndex(spark, str(tmp_path / "ix"))
    index.refresh(frame(spark, A))
    asked = index.asked(spark.createDataFrame([(1, "who runs?"), (2, "pelicans")], "q int, t string"), "q", "t")
    got = {(r["query_id"], r["id"]): r["score"] for r in index.bm25(asked).collect()}
    n, avg = index.stats()
    weight = lambda df, tf, length: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))
    assert got == {(1, "a#0"): pytest.approx(weight(2, 2, 3), abs=1e-6), (1, "a#1"): pytest.approx(weight(2, 1, 4), abs=1e-6), (2, "d#0"): pytest.approx(weight(1, 1, 2), abs=1e-6)}


def test_fingerprint_of_settings():
    assert fingerprint(size=220, overlap=40) == fingerprint(overlap=40, size=220) != fingerprint(overlap=41, size=220)


def moved(spark, run):
    """MB that a run shuffles."""

    def total():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    time.sleep(1)
    return (total() - before) / 1e6


def test_contents_are_not_shuffled(spark, tmp_path):
    """Texts of much that is no word: neither a base run nor a later one shuffles them; repeated ids alone are."""
    junk = F.expr("array_join(transform(sequence(1, 4000), i -> char(cast(192 + pmod(xxhash64(id, i), 60) as int))), '')")
    rows = spark.range(0, 600, numPartitions=4).select(F.col("id").alias("doc_id"), "id", F.concat(junk, F.lit(" words of "), "id").alias("content"))
    rows.write.parquet(path := str(tmp_path / "texts"))
    texts = spark.read.parquet(path)
    index = TextIndex(spark, str(tmp_path / "ix"), False, buckets=4)
    assert moved(spark, lambda: index.refresh(texts.where("id % 3 > 0"))) < 0.3
    assert moved(spark, lambda: index.refresh(texts.where("id % 5 > 0"))) < 0.3
    assert index.stats()[0] == 480 and index.postings().count() == 960


def test_postings_of_a_chunk_meet_once(spark, tmp_path):
    """Many questions that share their words: postings are shuffled, not their products with questions."""
    texts = spark.range(0, 2000, numPartitions=4).select(F.col("id").alias("doc_id"), "id", F.expr("array_join(transform(sequence(1, 20), i -> concat('w', pmod(xxhash64(id, i), 50))), ' ')").alias("content"))
    index = TextIndex(spark, str(tmp_path / "ix"), False, buckets=4)
    index.refresh(texts)
    asked = spark.range(100).select(F.col("id").alias("query_id"), F.explode(F.expr("transform(sequence(0, 49), i -> concat('w', i))")).alias("lexeme"))
    assert moved(spark, lambda: index.bm25(asked, 3).collect()) < 1.5


def test_a_task_ranks_few_pairs(spark, tmp_path, monkeypatch):
    """Pairs of a question and a chunk are dealt by their number, not by the bytes of the postings that make them."""
    monkeypatch.setattr(textindex, "PAIRS", 5_000, raising=False)
    texts = spark.range(0, 2000, numPartitions=4).select(F.col("id").alias("doc_id"), "id", F.expr("array_join(transform(sequence(1, 20), i -> concat('w', pmod(xxhash64(id, i), 50))), ' ')").alias("content"))
    index = TextIndex(spark, str(tmp_path / "ix"), False, buckets=4)
    index.refresh(texts)
    asked = spark.range(100).select(F.col("id").alias("query_id"), F.explode(F.expr("transform(sequence(0, 49), i -> concat('w', i))")).alias("lexeme"))
    most, top = [], retrieval.top

    def counted(scored, by, k):
        most.append(scored.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first())
        return top(scored, by, k)

    monkeypatch.setattr(retrieval, "top", counted)
    few = {tuple(r) for r in index.bm25(asked, 3).collect()}
    assert most[0][1] == 200_000 and most[0][0] < 25_000
    monkeypatch.undo()
    assert few == {tuple(r) for r in index.bm25(asked, 3).collect()} and len(few) == 300


def test_frequencies_of_asked_lexemes_alone_are_shuffled(spark, tmp_path):
    texts = spark.range(0, 2000, numPartitions=4).select(F.col("id").alias("doc_id"), "id", F.expr("concat('common ', array_join(transform(sequence(1, 60), i -> concat('w', id, 'x', i)), ' '))").alias("content"))
    index = TextIndex(spark, str(tmp_path / "ix"), False, buckets=4)
    index.refresh(texts)
    asked = spark.createDataFrame([(1, "w7x3"), (2, "common"), (2, "nowhere")], "query_id int, lexeme string")
    assert moved(spark, lambda: index.bm25(asked, 3).collect()) < 0.3
    assert {tuple(r) for r in index.frequencies(asked).collect()} == {("w7x3", 1), ("common", 2000)}


def test_large_sides_are_shuffled(spark, tmp_path, monkeypatch):
    """Beyond what may be broadcast the results are the same."""
    monkeypatch.setattr(textindex, "FEW", 0)
    index = TextIndex(spark, str(tmp_path / "ix"), buckets=5)
    for texts in (A, STEPS[0], STEPS[1]):
        index.refresh(frame(spark, texts))
    assert state(index) == by_hand(STEPS[1], True)
    asked = spark.createDataFrame([(1, "run"), (1, "dog"), (2, "cat")], "query_id int, lexeme string")
    few = {tuple(r) for r in index.bm25(asked).collect()}
    monkeypatch.undo()
    assert few == {tuple(r) for r in index.bm25(asked).collect()} and few
