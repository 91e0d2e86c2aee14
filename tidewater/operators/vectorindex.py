"""Vector search: exact in blocks, and approximate over a table of coarse lists.

``VectorIndex`` keeps every vector, scaled to length one, in the list of its nearest
centre, as a table bucketed and sorted by (list, part); long lists have several
parts, so none is one task's alone. Questions probe the lists nearest to them:
an equi-join with the bucketed table, which isn't shuffled for it, of a row a list's
part with a row for each some thousand of its questions; then exact scores, a block
at a time, of what the lists hold. Neither side is broadcast: a question is carried
once a list, and Spark's estimate of the rows knows nothing of that. The nearest list
alone gives each question a score that its last hit can't fall below, so of all other
lists only what reaches it is ranked. How many lists are probed is measured while
building: the least number under which the exact neighbours of a bounded sample
of the table's own vectors are found with the recall asked for.

Vectors that are null or empty, hold nulls, NaN or infinities, or have length
zero are not indexed and find nothing; of repeated ids all rows count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators import retrieval
from tidewater.operators.materialise import written

#: Vectors that the centres are fitted on, and questions of the calibration.
SAMPLE, ASKED = 16_384, 256
#: Rows of a list's part on average at most; questions of a block; slices of the vectors in an exact search; scores computed at once.
PART, BLOCK, SLICE, SCORES = 8_192, 2_048, 32_768, 1 << 20


def usable(v: Column) -> Column:
    """Whether a vector has a direction."""
    square = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(float("nan"))) * F.coalesce(x.cast("double"), F.lit(0.0)))
    return v.isNotNull() & (square > 0) & (square < float("inf"))


def unit(v: Column) -> Column:
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    # The length stands in an array, as Spark would compute it anew for each component.
    return F.get(F.transform(F.array(length), lambda of: F.transform(v, lambda x: x.cast("double") / of)), 0)


def rows_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def best(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``q``, row of ``v`` and score of the ``k`` nearest of ``v`` to each of ``q``; ties to the smaller id.

    Where a row of ``least`` is no NaN, only what reaches it counts. ``SCORES`` products are held at once.
    """
    out, step = [], max(1, SCORES // max(1, len(v)))
    for at in range(0, len(q), step):
        score = q[at : at + step] @ v.T
        bound = np.full(len(score), np.nan) if least is None else least[at : at + step]
        low = np.nan_to_num(bound, nan=-np.inf)
        if np.isnan(bound).any() and score.shape[1] > 4 * k:  # all that reach the k-th best, then the order among them
            low = np.fmax(bound, np.partition(score, score.shape[1] - k, axis=1)[:, -k])
        i, j = np.nonzero(score >= low[:, None] - 2e-6)  # scores are rounded once few are left
        exact = np.round(score[i, j], 6) + 0.0
        kept = ~(exact < bound[i])
        i, j, exact = i[kept], j[kept], exact[kept]
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[keep] + at, j[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def ordered(ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The places of ids in their order, whatever their type; nulls first, as in Spark."""
    return pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def exact_search(vectors: DataFrame, queries: DataFrame, pool: int = retrieval.POOL) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``pool`` nearest of ``vectors(id, v)`` to each of ``queries(query_id, q)`` by cosine.

    Blocks of questions meet slices of vectors, each pair in a task's group of
    its own; each gives its best, and these are ranked. Vectors of another
    length than the commonest are left out.
    """
    v = vectors.where(usable(F.col("v"))).select("id", unit(F.col("v")).alias("v"))
    q = queries.where(usable(F.col("q"))).select("query_id", unit(F.col("q")).alias("q"))
    shape = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    n = q.count()
    out = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {v.schema['id'].dataType.simpleString()}, score double"
    if shape is None or not n:
        return vectors.sparkSession.createDataFrame([], f"{out}, rank bigint")
    width, slices, blocks = shape["d"], -(-shape["count"] // SLICE) * 4, -(-n // BLOCK)
    here = v.where(F.size("v") == width).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    there = q.where(F.size("q") == width).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"query_id": b["query_id"].slice(0, 0), "id": a["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        i, j, score = best(rows_of(b["q"], width), rows_of(a["v"], width), ordered(a["id"]), pool)
        return pa.table({"query_id": b["query_id"].take(pa.array(i)), "id": a["id"].take(pa.array(j)), "score": score})

    found = here.groupBy("slice", "block").cogroup(there.groupBy("slice", "block")).applyInArrow(run, out)
    return retrieval.top(found, "query_id", pool)


def closest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of ``c`` to each of ``x``, and its score; ``SCORES`` products are held at once."""
    at, near, step = np.zeros(len(x), int), np.zeros(len(x)), max(1, SCORES // max(1, len(c)))
    for i in range(0, len(x), step):
        score = x[i : i + step] @ c.T
        at[i : i + step], near[i : i + step] = score.argmax(1), score.max(1)
    return at, near


def centres_of(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Directions of ``k`` groups of unit vectors: means by assignment to the nearest, empty ones set to the worst served vectors."""
    if not k:
        return x
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at, near = closest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        held = np.bincount(at, minlength=len(c)) > 0
        worst = np.argsort(near)[: int((~held).sum())]
        c[held] = sums[held]
        c[np.flatnonzero(~held)[: len(worst)]] = x[worst]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class VectorIndex:
    """An index under ``path``: the table of lists, the centres and the number of lists to probe."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 48):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._table: str | None = None

    def build(self, vectors: DataFrame, lists: int | None = None, recall: float = 0.97, k: int = 5) -> VectorIndex:
        """Index every row of ``vectors(id, v)``. ``lists``: the root of the number of vectors unless given, 4,096 at most."""
        rows = written(vectors.where(usable(F.col("v"))).select("id", unit(F.col("v")).alias("v")), "units")
        shape = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        width, n = (shape["d"], shape["count"]) if shape else (0, 0)
        rows = rows.where(F.size("v") == width)
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v").toArrow() if n else None
        x = rows_of(sample["v"], width) if n else np.zeros((0, 0))
        centres = centres_of(x, min(len(x), lists or min(4096, max(1, round(n**0.5)))))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, _ = closest(rows_of(b.column(1), width), centres)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], ["id", "v", "list"])

        kind = rows.schema["id"].dataType.simpleString()
        listed = written(rows.mapInArrow(nearest, f"id {kind}, v array<double>, list int"), "listed") if n else rows.withColumn("list", F.lit(0))
        sizes = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}  # one row a list: 4,096 at most
        parts = [max(1, -(-sizes.get(i, 0) // PART)) for i in range(len(centres))]
        number = F.element_at(F.lit(parts) if parts else F.array(F.lit(1)), F.col("list") + 1)
        dealt = listed.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), number).cast("int"))  # copies of an id as well
        self._register(T._parse_datatype_string(f"id {kind}, v array<double>, list int, part int"))
        dealt.repartition(self.buckets, "list", "part").write.insertInto(self._table)
        probes = self._calibrate(rows, sample, centres, listed, recall, k) if n else 0
        meta = [(width, probes, centres.astype(np.float64).tobytes(), parts, kind)]
        self.spark.createDataFrame(meta, "width int, probes int, centres binary, parts array<int>, kind string").coalesce(1).write.parquet(f"{self.path}/meta")
        return self

    def _register(self, schema: T.StructType) -> None:
        """The bucketed table over the folder, known to this session's catalogue."""
        self._table = f"vector_lists_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(f"CREATE TABLE {self._table} ({columns}) USING parquet CLUSTERED BY (list, part) SORTED BY (list, part) INTO {self.buckets} BUCKETS LOCATION '{self.path}/lists'")

    def _meta(self) -> tuple[int, int, np.ndarray, list[int], str]:
        m = self.spark.read.parquet(f"{self.path}/meta").first()
        return m["width"], m["probes"], np.frombuffer(m["centres"]).reshape(-1, m["width"]) if m["width"] else np.zeros((0, 0)), m["parts"], m["kind"]

    def _calibrate(self, rows: DataFrame, sample: pa.Table, centres: np.ndarray, listed: DataFrame, recall: float, k: int) -> int:
        """The least number of lists that hold the share ``recall`` of the ``k`` true neighbours of sampled vectors."""
        some = sample.slice(0, ASKED)
        asked = self.spark.createDataFrame([(i, v) for i, v in enumerate(some["v"].to_pylist())], "query_id int, q array<double>")
        found = exact_search(rows, asked, k + 1).where("score < 1 OR rank > 1")  # itself is no neighbour
        true = F.broadcast(found).join(listed.select("id", "list"), "id").select("query_id", "list").collect()  # ASKED * (k + 1) at most
        order = np.argsort(-(rows_of(some["v"], centres.shape[1]) @ centres.T), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        needed = np.sort([place[r["query_id"], r["list"]] for r in true])
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else len(centres)

    @property
    def probed(self) -> tuple[int, int]:
        """Lists that a question reads, and lists that there are."""
        _, probes, centres, _, _ = self._meta()
        return probes, len(centres)

    def search(self, queries: DataFrame, pool: int = retrieval.POOL, probes: int | None = None) -> DataFrame:
        """``(query_id, id, score, rank)`` of ``queries(query_id, q)`` over the lists that each probes."""
        width, usual, centres, parts, kind = self._meta()
        if self._table is None:
            self._register(T._parse_datatype_string(f"id {kind}, v array<double>, list int, part int"))
        n = min(probes or usual, len(centres))
        q = queries.where(usable(F.col("q")) & (F.size("q") == width)).select("query_id", unit(F.col("q")).alias("q"), F.lit(None).cast("double").alias("least"))
        asked = q.schema["query_id"].dataType.simpleString()
        q = written(q, "asked")
        count = q.count()
        if n > 1:
            first = retrieval.top(self._scored(self._probes(q, 1, centres, parts, asked), width, count, pool), "query_id", pool)
            least = first.where(F.col("rank") == pool).select("query_id", F.col("score").alias("least"))
            q = written(q.drop("least").join(least, "query_id", "left"), "bounded")
        pairs = self._probes(q, n, centres, parts, asked) if n else q.withColumn("list", F.lit(0)).withColumn("part", F.lit(0))
        return retrieval.top(self._scored(pairs, width, count, pool), "query_id", pool)

    def _probes(self, q: DataFrame, n: int, centres: np.ndarray, parts: list[int], asked: str) -> DataFrame:
        """A row for each of ``q(query_id, q, least)`` and part of its ``n`` nearest lists."""
        width, copies = centres.shape[1], np.array(parts)
        step = max(1, 2**16 // (n * int(copies.max())))  # questions whose rows are made at once

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (x.slice(at, step) for x in batches for at in range(0, len(x), step)):
                near = np.argsort(-(rows_of(b.column(1), width) @ centres.T), axis=1)[:, :n]
                at = near.ravel()
                each, ends = copies[at], np.cumsum(copies[at])
                part = np.arange(ends[-1]) - np.repeat(ends - each, each)
                who = pa.array(np.repeat(np.repeat(np.arange(len(near)), n), each))
                yield pa.RecordBatch.from_arrays([*(c.take(who) for c in b.columns), pa.array(np.repeat(at, each), pa.int32()), pa.array(part, pa.int32())], ["query_id", "q", "least", "list", "part"])

        return q.mapInArrow(probe, f"query_id {asked}, q array<double>, least double, list int, part int")

    def _scored(self, pairs: DataFrame, width: int, count: int, pool: int) -> DataFrame:
        """``(query_id, id, score)``: of the vectors in each pair's list its ``pool`` best, but for those under its ``least``.

        ``count`` is the number of questions, of which some ``BLOCK`` meet a list's part at once.
        """
        table = self.spark.table(self._table)
        block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-count // BLOCK))))
        # Dealt as the table's buckets are, so that neither grouping nor join shuffles again.
        asking = pairs.repartition(self.buckets, "list", "part").groupBy("list", "part", block.alias("block")).agg(F.collect_list(F.struct("query_id", "q", "least")).alias("asking"))
        held = table.groupBy("list", "part").agg(F.collect_list(F.struct("id", "v")).alias("held"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ask, hold in zip(b.column(0), b.column(1), strict=True):
                    (who, q, least), (ids, v) = ask.values.flatten(), hold.values.flatten()
                    i, j, score = best(rows_of(q, width), rows_of(v, width), ordered(ids), pool, least.to_numpy(zero_copy_only=False).astype(float))
                    yield pa.RecordBatch.from_arrays([who.take(pa.array(i)), ids.take(pa.array(j)), pa.array(score)], ["query_id", "id", "score"])

        met = asking.hint("merge").join(held, ["list", "part"]).select("asking", "held")
        return met.mapInArrow(run, f"query_id {pairs.schema['query_id'].dataType.simpleString()}, id {table.schema['id'].dataType.simpleString()}, score double")
