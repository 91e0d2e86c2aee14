"""Plumbing that the operators of this subpackage share.

* ``cut`` writes a table to the cluster's shared folder and reads it back. It
  ends the lineage, survives lost executors and makes each costly pass run once.
* ``salted_join`` joins many rows with a table of unique keys when one key may
  hold a third of the rows.
* ``components`` finds connected components without gathering them anywhere.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts may be 100 kB and more each.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20
#: Copies that the narrow side of a salted join gets.
SALTS = 8
#: Ids (16 bytes or so each) that are broadcast at most.
FEW = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a folder of our own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='tidewater-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidewater-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table of the shared folder."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path := scratch(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing will read them any more."""
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def with_ids(df: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """``df`` semi- or anti-joined (``how``) with a written table of distinct ids: broadcast if counted to be ``FEW`` at most, else by a shuffle of both."""
    ids = ids.toDF(id_col)
    return df.join(F.broadcast(ids) if ids.count() <= FEW else ids, id_col, how)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in rows and, where Spark can, in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fields(df: DataFrame, *names: str) -> str:
    """A DDL schema of the named columns as ``df`` has them."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def salted_join(many: DataFrame, unique: DataFrame, key: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """``many`` joined with ``unique`` (one row a key) on ``key``, null-safe nowhere: a null key finds nothing.

    The rows of a hot key spread over ``salts`` tasks by a hash of all their
    columns but the key's; each row of ``unique`` is sent ``salts`` times, so
    that side must be narrow.
    """
    others = [c for c in many.columns if c != key] or [key]
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int"))
    copies = unique.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, root)`` for every node with an edge, root the smallest node.

    Alternating large-star and small-star rounds; each round is two aggregations
    that combine before the shuffle and two salted joins, so that a hub's edges
    don't meet in a task, and ends in a written table. Rounds end when the edges
    no longer change. Duplicate edges and loops do no harm; no edges: no rows.
    """

    def star(pairs: DataFrame) -> DataFrame:
        """Each node's pairs (u, v) become (v, m), m being the smallest of u and its vs."""
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return salted_join(pairs, low, "u", "inner")

    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    seen = None
    while (now := _checksum(edges)) != seen and now[0]:
        seen, before = now, edges
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        large = star(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = star(down)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u"), F.col("m")))
        edges = cut(small.where("a > b").distinct(), "edges")
        forget(before)
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def words_of(text: Column) -> Column:
    """Words of the contract's kind (runs of anything but ASCII white space), A-Z lower-cased; null and empty texts: none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")
