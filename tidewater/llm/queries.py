"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import arc, bidilm, chroma, codes, decontam, hardneg, licences, secretscan, simhash, tokencount, toxicity, urlfilter, viterbi


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` rendered as a clip, fingerprinted and aligned; the tables hold no sound of their own."""
    prints = chroma.fingerprints(table(spark, sf_dir, "embeddings"), chroma.render, "vec_id", "embedding")
    return chroma.search(prints).withColumnRenamed("id", "vec_id")


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.archive_pages(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, their digest and the round trip of every document."""
    return viterbi.encode_table(table(spark, sf_dir, "documents"), viterbi.Pieces.load()).withColumnRenamed("id", "doc_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), *urlfilter.train(urlfilter.labelled())).withColumnRenamed("id", "page_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bidilm.score(docs, bidilm.fit(docs)).withColumnRenamed("id", "doc_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"), tokencount.load()).withColumnRenamed("id", "doc_id")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), toxicity.is_held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "similarity", "distance")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 100, against all rows."""
    return hardneg.mine(hardneg.shifted(table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digests(table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digests(secretscan.scan(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_chroma, op2_arc_to_warc, op3_sentencepiece, op4_url_filter, op5_simhash, op6_pseudo_likelihood, op7_token_counts, op8_licences, op9_toxicity, op10_decontamination, op11_hard_negatives, op12_vector_codes, op13_secret_scan)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """The other operators hash, train, compress or archive beyond DuckDB's SQL and are tested by brute force."""
    return {"op8_licences": licences.scan_sql(), "op11_hard_negatives": hardneg.SQL, "op12_vector_codes": codes.sql()}
