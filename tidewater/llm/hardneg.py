"""Hard-negative mining by a pivot table.

A vector x of length |x| becomes (x, sqrt(M^2 - |x|^2)), M the largest length;
an anchor a becomes (a, 0). Then |a - x|^2 = M^2 + |a|^2 - 2<a, x>: a large inner
product is a short distance. The table keeps each row's distances to a few
pivots. By the triangle inequality they bracket the distance to an anchor,

    max |d(a, p) - d(x, p)|  <=  d(a, x)  <=  min d(a, p) + d(x, p),

hence the score, first for tiles of rows (by the least and largest distance to
each pivot), then for single rows; what the brackets leave is scored exactly.
Brackets are widened by more than the rounding of floating point, so pivots
decide only how much work is done.

Rows lie in slices, sorted by label, nearest pivot and distance to it; anchors
in parts. A slice and a part meet in a task of their own, whose rows and running
best lists are bounded; best lists of the slices merge by rank per anchor.

Defined results: rows with a null id or label, or a vector that
``vectors.whole_numbers`` drops, take no part; of rows that share an id the one
of the smallest label, then vector, counts; shorter vectors count as ending in
zeros; ties of score go to the smaller id; an anchor without positives, or a
positive without negatives in its range, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import FEW, cut
from tidewater.llm.vectors import matrix, products, whole_numbers

PIVOTS = 8
#: Rows among which the pivots are chosen; they decide nothing but the speed.
PIVOT_SAMPLE = 512
#: Rows of a slice at most on average, slices at least (for small tables on many cores), anchors of a part, rows of a tile.
SLICE, SLICES, PART, TILE = 16_384, 24, 512, 1024


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of ``x`` far from each other: each the farthest from those before it."""
    if not len(x):
        return x
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


class Pivots:
    """Points of the augmented space, and distances to them."""

    def __init__(self, q: np.ndarray, longest: float, n: int = PIVOTS):
        self.longest = longest
        self.points = spread(self.augmented(q.astype(np.float64)), n)

    def augmented(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.sqrt(np.maximum(self.longest - (q * q).sum(1), 0))])

    def distances(self, q: np.ndarray, anchors: bool = False) -> np.ndarray:
        q = q.astype(np.float64)
        x = np.column_stack([q, np.zeros(len(q))]) if anchors else self.augmented(q)
        square = (x * x).sum(1)[:, None] - 2 * x @ self.points.T + (self.points**2).sum(1)[None, :]
        return np.sqrt(np.maximum(square, 0))


def slack(longest: float) -> float:
    """More than the error of a distance: that of a square root of a difference of squares."""
    return 1e-6 * np.sqrt(longest) + 1e-3


class Block:
    """Rows or anchors of one task as arrays."""

    def __init__(self, t: pa.Table, width: int):
        self.id, self.label = t["id"].to_numpy(), t["label"].to_numpy()
        self.q, self.dist = matrix(t["q"], width), matrix(t["dist"], dtype=np.float64)

    def __len__(self) -> int:
        return len(self.id)


class Best:
    """The first ``k`` of each wanted list so far, by falling score, then rising id."""

    def __init__(self, n: int, k: int):
        self.k, self.need = k, np.full(n, np.iinfo(np.int64).min)
        self.of = self.score = self.id = np.zeros(0, np.int64)

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        of, score, ids = (np.concatenate(x) for x in ((self.of, of), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, of))
        of, score, ids = of[order], score[order], ids[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        self.of, self.score, self.id = of[rank < self.k], score[rank < self.k], ids[rank < self.k]
        full = rank == self.k - 1
        self.need[of[full]] = score[full]


def search(anchors: Block, rows: Block, longest: float, owner: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[Best, int]:
    """The best ``k`` rows of each list, and how many pairs were scored exactly.

    List i belongs to anchor ``owner[i]`` and takes rows of the anchor's label
    but of another id (``same``) or of other labels, that score ``low[i]`` to
    ``high[i]``.
    """
    best, scored, eps = Best(len(owner), k), 0, slack(longest)
    square = (anchors.q.astype(np.float64) ** 2).sum(1) + longest

    def bracket(near: np.ndarray, far: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score, given least and largest distance."""
        base = square[who][:, None]
        return (base - (far + eps) ** 2) / 2 - 1, (base - np.maximum(near - eps, 0) ** 2) / 2 + 1

    for begin in range(0, len(rows), TILE):
        tile = slice(begin, begin + TILE)
        d, ids, labels = rows.dist[tile], rows.id[tile], rows.label[tile]
        floor = np.full(len(anchors), np.inf)  # the least score that any list of an anchor still takes
        np.minimum.at(floor, owner, np.maximum(low, best.need))
        roof = np.full(len(anchors), -np.inf)
        np.maximum.at(roof, owner, high)
        least, most = d.min(0), d.max(0)
        a = anchors.dist
        under, over = bracket(np.maximum(np.maximum(a - most, least - a), 0).max(1)[:, None], (a + most).min(1)[:, None], np.arange(len(a)))
        who = np.flatnonzero((over[:, 0] >= floor) & (under[:, 0] <= roof) & (np.isin(anchors.label, labels) if same else True))
        if not len(who):
            continue
        near, far = np.zeros((len(who), len(ids))), np.full((len(who), len(ids)), np.inf)
        for p in range(d.shape[1]):
            np.maximum(near, np.abs(a[who, p][:, None] - d[:, p]), out=near)
            np.minimum(far, a[who, p][:, None] + d[:, p], out=far)
        under, over = bracket(near, far, who)
        alike = anchors.label[who][:, None] == labels
        fit = (over >= floor[who][:, None]) & (under <= roof[who][:, None]) & (alike & (anchors.id[who][:, None] != ids) if same else ~alike)
        some = np.flatnonzero(fit.any(0))
        if not len(some):
            continue
        score, fit = products(anchors.q[who], rows.q[tile][some]), fit[:, some]
        scored += int(fit.sum())
        place = np.full(len(anchors), -1)
        place[who] = np.arange(len(who))
        lists = np.flatnonzero(place[owner] >= 0)
        at = place[owner[lists]]
        least = np.maximum(low, best.need)[lists]
        chosen = fit[at] & (score[at] <= high[lists][:, None]) & (score[at] >= least[:, None])
        i, j = np.nonzero(chosen)
        best.add(lists[i], score[at[i], j], ids[some[j]])
    return best, scored


def ranked(df: DataFrame, by: list[str], score: str, other: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), other)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pivot_table(rows: DataFrame, longest: float, width: int, slices: int) -> tuple[DataFrame, Pivots]:
    """The rows with their pivot distances, in slices sorted by label, nearest pivot and distance to it."""
    sample = rows.orderBy(F.xxhash64("id"), "id").select("q").limit(PIVOT_SAMPLE).toArrow()
    pivots = Pivots(matrix(sample["q"], width), longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = pivots.distances(matrix(b.column(2), width))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), d.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1))], ["id", "label", "q", "dist", "cell", "near"])

    table = rows.select("id", "label", "q").mapInArrow(run, "id bigint, label bigint, q array<bigint>, dist array<double>, cell int, near double")
    sliced = table.repartitionByRange(slices, "label", "cell", "near", "id").sortWithinPartitions("label", "cell", "near", "id")
    return cut(sliced.withColumn("slice", F.spark_partition_id()).drop("cell", "near"), "pivot_table"), pivots


def mine(df: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Rows ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchor`` is a condition on the column ``id``. An anchor's positives are its
    best ``positives`` rows of the same label; each positive's negatives the best
    ``negatives`` rows of other labels whose score is ``low`` to ``high`` hundredths of
    the positive's.
    """
    spark = df.sparkSession
    valid = whole_numbers(df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()), id_col, vec_col, label=F.col(label_col).cast("bigint"))
    rows = cut(valid.withColumn("id", F.col("id").cast("bigint")).groupBy("id").agg(F.min(F.struct("label", "q")).alias("s")).select("id", "s.label", "s.q"), "whole")
    length = F.aggregate("q", F.lit(0).cast("bigint"), lambda acc, x: acc + x * x)
    size = rows.agg(F.count("*").alias("n"), F.count_if(anchor).alias("anchors"), F.max(length).alias("longest"), F.max(F.size("q")).alias("width")).first()
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not size["anchors"]:
        return spark.createDataFrame([], out)
    longest, width = float(size["longest"]), size["width"]
    table, pivots = pivot_table(rows, longest, width, max(-(-size["n"] // SLICE), min(SLICES, size["n"])))
    parts = -(-size["anchors"] // PART)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = pivots.distances(matrix(b.column(2), width), anchors=True)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), d.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], ["id", "label", "q", "dist"])

    asked = rows.where(anchor).select("id", "label", "q").mapInArrow(measured, "id bigint, label bigint, q array<bigint>, dist array<double>")
    asked = cut(asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")), "anchors")
    last = table.agg(F.max("slice")).first()[0]

    def meet(queries: DataFrame, only: DataFrame | None, run, schema: str) -> DataFrame:
        """Every slice with every part of the queries, each pair in a task's group of its own; ``only`` has the (label, part) that meet."""
        every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        here = table.withColumn("part", every) if only is None else table.join(F.broadcast(only) if only.count() <= FEW else only, "label")
        there = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(last))))
        return here.groupBy("slice", "part").cogroup(there.groupBy("slice", "part")).applyInArrow(run, schema)

    def own_label(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not len(rows) or not len(anchors):
            return pa.table({"anchor": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        a, r = Block(anchors, width), Block(rows, width)
        open_ended = np.iinfo(np.int64)
        best, _ = search(a, r, longest, np.arange(len(a)), np.full(len(a), open_ended.min), np.full(len(a), open_ended.max), True, positives)
        return pa.table({"anchor": a.id[best.of], "other": best.id, "score": best.score})

    def other_labels(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        names = ["anchor", "positive", "positive_score", "other", "score"]
        if not len(rows) or not len(anchors):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        a, r = Block(anchors, width), Block(rows, width)
        lists = anchors["found"].combine_chunks()
        owner = np.repeat(np.arange(len(a)), lists.value_lengths().to_numpy())
        positive, score = lists.flatten().field("other").to_numpy(), lists.flatten().field("score").to_numpy()
        # low * p <= 100 * s <= high * p; a negative p leaves nothing between
        best, _ = search(a, r, longest, owner, -(-low * score // 100), high * score // 100, False, negatives)
        return pa.table(dict(zip(names, (a.id[owner[best.of]], positive[best.of], score[best.of], best.id, best.score), strict=True)))

    labels = asked.select("label", "part").distinct().toDF("label", "part")
    found = ranked(meet(asked, labels, own_label, "anchor bigint, other bigint, score bigint"), ["anchor"], "score", "other", positives)
    lists = found.groupBy(F.col("anchor").alias("id")).agg(F.collect_list(F.struct("other", "score")).alias("found"))  # `positives` at most
    second = cut(asked.join(lists, "id"), "positives")
    pairs = meet(second, None, other_labels, "anchor bigint, positive bigint, positive_score bigint, other bigint, score bigint")
    got = ranked(pairs, ["anchor", "positive", "positive_score"], "score", "other", negatives)
    return got.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def shifted(df: DataFrame) -> DataFrame:
    """The contract's labels: where the id is divisible by 7, the next of ten."""
    label = F.col("label").cast("bigint")
    return df.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))


SQL = """
WITH kept AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS s
  FROM kept a JOIN kept b ON a.id <> b.id WHERE a.id % 100 = 0),
pos AS (SELECT a, b, s FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)::INT AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM pos p JOIN scored n ON p.a = n.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
QUALIFY rank <= 10
"""
