"""A lexical index on disk that is kept up to date run by run.

Folders under one path:

* ``chunks``, by a hash of the document: content, the skip triple (content hash,
  configuration fingerprint, model) and the length in lexemes;
* ``postings``, by a hash of the lexeme: (lexeme, chunk, frequency, chunk length);
* ``df``, a folder a run: signed changes of document frequencies;
* ``runs``: one row as a run starts, one as it ends, with its counts and the
  changes of the number of chunks and of their total length.

A run compares triples, takes the terms of what changed (the old ones from the
old content) and rewrites only the partitions that these touch, by dynamic
partition overwrite. Contents aren't shuffled: a base run writes its chunks where
they are read and takes the terms from them, a later one joins hashes and sends
the ids of what changed to the contents. Postings are shuffled once, packed to
one row a chunk and bucket; those that stay keep to their partition. Frequencies and lengths are sums over the successful runs
since the last base run (a rebuild or a repair), so nothing counts the corpus
again. An unchanged run writes its two log rows and nothing else. If the last
run has no end, its postings may be there in part: the next run is a base run.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidewater.functions.analyse import lexemes, tokens
from tidewater.operators import retrieval
from tidewater.operators.materialise import forget, replace_partitions, written

#: Rows of (query, lexeme) and ids of changed chunks that are broadcast at most; beyond, both sides are shuffled.
FEW = 1_000_000
#: Pairs of a question and a chunk that one task ranks, about; a part of the chunks has so many times the pool at least.
PAIRS, LEAST = 1_000_000, 40
#: How tables are written.
SMALL = {"compression": "zstd"}

RUNS = "seq bigint, status string, base boolean, fingerprint string, model string, chunks bigint, added bigint, changed bigint, skipped bigint, deleted bigint, d_chunks bigint, d_length bigint"


def fingerprint(**config: object) -> str:
    """The digest of a configuration: equal settings in any order, equal digest."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


@dataclass(frozen=True)
class Outcome:
    """What a run did; ``d_chunks`` and ``d_length`` are changes."""

    seq: int
    base: bool
    chunks: int = 0
    added: int = 0
    changed: int = 0
    skipped: int = 0
    deleted: int = 0
    d_chunks: int = 0
    d_length: int = 0


class TextIndex:
    """``stemmed``: Porter stems or plain words; ``buckets``: partitions of either table, fixed for the life of the index."""

    def __init__(self, spark: SparkSession, path: str, stemmed: bool = True, buckets: int = 32):
        self.spark, self.path, self.stemmed, self.buckets = spark, path.rstrip("/"), stemmed, buckets

    # -- reading ------------------------------------------------------------------

    def _read(self, name: str, schema: str | None = None) -> DataFrame | None:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        try:
            return reader.parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing is written yet
            return None

    def runs(self) -> DataFrame:
        found = self._read("runs", RUNS)
        return self.spark.createDataFrame([], RUNS) if found is None else found

    def _log(self, seq: int, status: str, base: bool, fp: str, model: str, done: Outcome | None = None) -> None:
        row = (asdict(done) if done else {}) | {"seq": seq, "status": status, "base": base, "fingerprint": fp, "model": model}
        kinds = [c.split() for c in RUNS.split(", ")]
        self.spark.range(1, numPartitions=1).select(*[F.lit(row.get(n)).cast(t).alias(n) for n, t in kinds]).write.mode("append").parquet(f"{self.path}/runs")

    def last(self) -> tuple[int, bool]:
        """The number of the last run begun (0: none) and whether it succeeded."""
        row = self.runs().agg(F.max("seq").alias("begun"), F.max(F.when(F.col("status") == "SUCCESS", F.col("seq"))).alias("ended")).first()
        return row["begun"] or 0, row["begun"] == row["ended"]

    def _current(self) -> DataFrame:
        """The successful runs since the last base run."""
        ended = self.runs().where("status = 'SUCCESS'")
        base = ended.where("base").agg(F.max("seq")).first()[0] or 0
        return ended.where(F.col("seq") >= base)

    def chunks(self) -> DataFrame | None:
        return self._read("chunks")

    def postings(self) -> DataFrame:
        """``(id, lexeme, tf, doc_len)``."""
        return self._postings().select("id", "lexeme", "tf", "doc_len")

    def _postings(self) -> DataFrame:
        found = self._read("postings")
        return self.spark.createDataFrame([], "id string, lexeme string, tf bigint, doc_len bigint, bucket int") if found is None else found

    def frequencies(self, among: DataFrame | None = None) -> DataFrame:
        """``(lexeme, df)``, the sums of the runs' changes, of all lexemes or those of ``among(lexeme)``; lexemes that are gone have no row."""
        counted = [r["seq"] for r in self._current().where("base OR added + changed + deleted > 0").collect()]  # runs, not rows
        deltas = self._read("df").where(F.col("run").isin(counted))
        deltas = deltas if among is None else deltas.join(among, "lexeme", "left_semi")
        return deltas.groupBy("lexeme").agg(F.sum("delta").alias("df")).where("df > 0")

    def stats(self) -> tuple[int, float]:
        """Number of chunks and their mean length in lexemes."""
        row = self._current().agg(F.sum("d_chunks").alias("n"), F.sum("d_length").alias("length")).first()
        n = row["n"] or 0
        return n, (row["length"] or 0) / n if n else 0.0

    # -- writing ------------------------------------------------------------------

    def _bucket(self, c: str | Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _replace(self, df: DataFrame, name: str, touched: list[int]) -> None:
        replace_partitions(df, f"{self.path}/{name}", "bucket", touched, dealt=True, **SMALL)

    def _deal(self, rows: DataFrame) -> DataFrame:
        """Postings of ``rows(id, content)`` by bucket: shuffled as one row a chunk and bucket, its lexemes glued, and taken apart again."""
        words = rows.select("id", lexemes(F.col("content"), self.stemmed).alias("w")).select("id", F.sort_array(F.transform("w", lambda x: F.struct(self._bucket(x).alias("b"), x.alias("x")))).alias("w"))
        runs = words.select("id", "w", F.size("w").alias("n"), retrieval.starts("w").alias("at"))
        each = F.transform("at", lambda p, j: F.struct(F.get("w", p)["b"].alias("b"), F.get("w", p)["x"].alias("x"), (F.coalesce(F.get("at", j + 1), F.col("n")) - p).alias("tf")))
        counted = runs.select("id", "n", each.alias("c"))
        blocks = counted.select("id", "n", "c", F.size("c").alias("of"), retrieval.starts("c", lambda x: x["b"]).alias("at"))
        held = lambda p, j: F.slice("c", p + 1, F.coalesce(F.get("at", j + 1), F.col("of")) - p)
        part = lambda p, j: F.struct(F.get("c", p)["b"].alias("bucket"), F.array_join(F.transform(held(p, j), lambda x: x["x"]), " ").alias("glued"), F.transform(held(p, j), lambda x: x["tf"]).alias("tf"))
        packed = blocks.select("id", "n", F.inline(F.transform("at", part))).hint("rebalance", F.col("bucket"))
        rows = packed.select("id", "n", "bucket", F.inline(F.arrays_zip(F.split("glued", " ").alias("lexeme"), F.col("tf"))))
        return rows.select("id", "lexeme", F.col("n").cast("bigint").alias("doc_len"), F.col("tf").cast("bigint").alias("tf"), "bucket")

    def _lexemes(self, rows: DataFrame) -> DataFrame:
        """A row for each chunk and lexeme of its ``content``."""
        return rows.select(F.explode(F.array_distinct(lexemes(F.col("content"), self.stemmed))).alias("lexeme"))

    def _units(self, units: DataFrame) -> DataFrame:
        """``(id, doc_id, content)``, one row an id. Only rows of repeated ids are shuffled for it."""
        given = units.where("id IS NOT NULL").select("id", "doc_id", F.coalesce("content", F.lit("")).alias("content"))
        twice = written(given.groupBy("id").count().where("count > 1").select("id"), "repeated")
        if (n := twice.count()) == 0:
            return given
        twice = F.broadcast(twice) if n <= FEW else twice
        least = given.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc_id", "content")).alias("s")).select("id", "s.doc_id", "s.content")
        return given.join(twice, "id", "left_anti").union(least)

    def _chunked(self, rows: DataFrame, fp: str, model: str) -> DataFrame:
        """Rows of ``chunks`` for ``rows(id, doc_id, content)``."""
        length = F.size(tokens(F.col("content"))).cast("bigint")  # a stem a token
        return rows.select("id", "doc_id", "content", F.sha2("content", 256).alias("hash"), F.lit(fp).alias("fingerprint"), F.lit(model).alias("model"), length.alias("doc_len"), self._bucket("doc_id").alias("bucket"))

    def refresh(self, units: DataFrame, fp: str = "", model: str = "", whole: bool = True, rebuild: bool = False) -> Outcome:
        """Bring the index up to ``units(doc_id, id, content)``.

        ``whole``: documents that ``units`` lacks are gone; else only chunks of the
        documents it has can go. ``rebuild`` starts afresh. Rows without id are
        left out, of repeated ids the least content counts, a null content is empty.
        """
        begun, fine = self.last()
        seq, base = begun + 1, rebuild or not begun or not fine
        self._log(seq, "RUNNING", base, fp, model)
        now = self._units(units)
        known = None if base else self.chunks()
        if base:
            forget(self.spark, *(f"{self.path}/{name}" for name in ("postings", "chunks")))
        done = self._build(now, fp, model, Outcome(seq, base)) if known is None else self._update(now, known, fp, model, whole, Outcome(seq, base))
        self._log(seq, "SUCCESS", base, fp, model, done)
        return done

    def _build(self, now: DataFrame, fp: str, model: str, done: Outcome) -> Outcome:
        """Write everything for units of which none is known: chunks, then what follows from them."""
        self._replace(self._chunked(now, fp, model), "chunks", [])
        chunks = self.chunks()
        size = None if chunks is None else chunks.agg(F.count("*").alias("n"), F.sum("doc_len").alias("length")).first()
        n, length = (size["n"], size["length"]) if size else (0, 0)
        if n:
            self._replace(self._deal(chunks).sortWithinPartitions("bucket", "lexeme"), "postings", [])
        if n or done.base:
            self._postings().groupBy("lexeme").agg(F.count("*").cast("int").alias("delta")).write.mode("overwrite").options(**SMALL).parquet(f"{self.path}/df/run={done.seq}")
        return replace(done, chunks=n, added=n, d_chunks=n, d_length=length)

    def _update(self, now: DataFrame, known: DataFrame, fp: str, model: str, whole: bool, done: Outcome) -> Outcome:
        """Write postings, frequency changes and chunks of what differs from the known, in this order."""
        hashed = now.select("id", "doc_id", F.struct(F.sha2("content", 256).alias("hash"), F.lit(fp).alias("fingerprint"), F.lit(model).alias("model")).alias("now"))
        before = known.select("id", F.col("doc_id").alias("old_doc"), F.col("doc_len").alias("old_len"), F.col("bucket").alias("old_bucket"), F.struct("hash", "fingerprint", "model").alias("was"))
        both = before.join(hashed, "id", "full")
        if not whole:  # chunks of documents that this run doesn't look at stay
            given = now.select(F.col("doc_id").alias("old_doc")).distinct().withColumn("given", F.lit(True))
            both = both.join(given, "old_doc", "left").where("now IS NOT NULL OR given").drop("given")
        same = F.col("was").eqNullSafe(F.col("now"))
        changes = written(both.where(~same).select("id", F.col("was").isNotNull().alias("old"), F.col("now").isNotNull().alias("new"), "old_len", "old_bucket", F.when(F.col("now").isNotNull(), self._bucket("doc_id")).alias("bucket")), "changes")
        kinds = {"added": "NOT old", "changed": "old AND new", "deleted": "NOT new"}
        size = changes.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in kinds.items()], F.coalesce(F.sum("old_len"), F.lit(0)).alias("length")).first().asDict()
        lost = size.pop("length")
        n = now.count()
        done = replace(done, chunks=n, **size, skipped=n - size["added"] - size["changed"], d_chunks=size["added"] - size["deleted"])
        if not sum(size.values()):
            forget(self.spark, changes.scratch_path)
            return done
        few = lambda df, n: F.broadcast(df) if n <= FEW else df
        stale, n_stale = changes.where("old").select("id"), size["changed"] + size["deleted"]
        stale = few(stale, n_stale)
        fresh = written(self._chunked(now.join(few(changes.where("new").select("id"), size["added"] + size["changed"]), "id", "left_semi"), fp, model), "fresh", **SMALL)
        dirty = [r[0] for r in changes.select(F.explode(F.array("bucket", "old_bucket")).alias("b")).where("b IS NOT NULL").distinct().collect()]  # `buckets` at most
        touched_chunks = known.where(F.col("bucket").isin(dirty))
        gone = self._lexemes(touched_chunks.join(stale, "id", "left_semi"))
        moved = self._lexemes(fresh).select("lexeme", F.lit(1).alias("d")).union(gone.select("lexeme", F.lit(-1)))
        # lexemes of unchanged frequency mark their partition as touched, too
        delta = written(moved.groupBy("lexeme").agg(F.sum("d").alias("delta")).withColumn("bucket", self._bucket("lexeme")), "delta", **SMALL)
        delta.where("delta <> 0").select("lexeme", F.col("delta").cast("int").alias("delta")).write.mode("overwrite").options(**SMALL).parquet(f"{self.path}/df/run={done.seq}")
        touched = [r[0] for r in delta.select("bucket").distinct().collect()]  # `buckets` at most
        new, old = self._deal(fresh), self._read("postings")
        if old is not None:
            kept = old.where(F.col("bucket").isin(touched)).join(stale, "id", "left_anti").select(*new.columns)
            new = (kept if n_stale <= FEW else kept.hint("rebalance", F.col("bucket"))).union(new)
        self._replace(new.sortWithinPartitions("bucket", "lexeme"), "postings", touched)
        d_length = (fresh.agg(F.sum("doc_len")).first()[0] or 0) - lost
        kept = touched_chunks.join(stale, "id", "left_anti").select(*fresh.columns)
        self._replace((kept if n_stale <= FEW else kept.hint("rebalance", F.col("bucket"))).union(fresh), "chunks", dirty)
        forget(self.spark, changes.scratch_path, fresh.scratch_path, delta.scratch_path)
        return replace(done, d_length=d_length)

    # -- ranking ------------------------------------------------------------------

    def bm25(self, queries: DataFrame, pool: int = retrieval.POOL) -> DataFrame:
        """``(query_id, id, score, rank)`` for ``queries(query_id, lexeme)``; lexemes must be analysed as the index was.

        Only partitions and postings of asked lexemes are read.
        """
        n, avg_len = self.stats()
        asked = written(queries.select("query_id", "lexeme").distinct(), "asked")
        rows, questions = asked.agg(F.count("*"), F.count_distinct("query_id")).first()
        side = F.broadcast if rows <= FEW else (lambda df: df)
        df = self.frequencies(side(asked.select("lexeme").distinct()))
        weights = asked.join(df, "lexeme").select("query_id", "lexeme", "df", retrieval.idf(F.lit(n), F.col("df")).alias("idf"))
        weights = written(weights.groupBy("lexeme").agg(F.first("df").alias("df"), F.collect_list(F.struct("query_id", "idf")).alias("of")).withColumn("term", F.monotonically_increasing_id()), "weights")
        forget(self.spark, asked.scratch_path)
        read = [r[0] for r in weights.select(self._bucket("lexeme")).distinct().collect()]  # `buckets` at most
        postings = self._postings().where(F.col("bucket").isin(read))
        pairs = min(weights.agg(F.sum(F.col("df") * F.size("of"))).first()[0] or 0, n * questions)
        # a chunk's postings meet once, whoever asks for them; its scores for all questions are summed where it lies
        found = postings.join(side(weights.select("lexeme", "term")), "lexeme").select("id", "term", F.col("tf").cast("int").alias("tf"), F.col("doc_len").cast("int").alias("doc_len"))
        found = found.repartition(max(1, min(-(-pairs // PAIRS), n // (LEAST * pool))), "id") if rows <= FEW else found
        scored = found.join(side(weights.select("term", F.inline("of"))), "term").withColumn("s", retrieval.term_weight(F.col("idf"), F.col("tf"), F.col("doc_len"), F.lit(avg_len)))
        return retrieval.top(scored.groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score")), "query_id", pool)

    def asked(self, questions: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``(query_id, lexeme)`` of questions, analysed as the index is."""
        return questions.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(lexemes(F.col(text_col), self.stemmed))).alias("lexeme"))
