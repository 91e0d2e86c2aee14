"""Vector code compression: product codes by weighted Lloyd rounds over distinct parts.

Components become floors, a vector is cut into equal consecutive parts, and per
part position the equal parts of all vectors become one row with a weight. The
rounds run over these distinct rows alone; each task sends its sums per entry
(``parts * entries`` rows at most), and only sums and codebooks, whose size the
parameters fix, reach the driver. At last every distinct part gets its code and
error, and both are joined back to the vectors.

Defined results: null vectors and vectors with null or non-finite components are
dropped (see ``vectors.whole_numbers``); vectors shorter than the longest, or
than a multiple of ``parts``, count as ending in zeros; fewer vectors than
``entries`` make smaller codebooks; repeated rows (also of one id) all count and
all return; null ids come last in the order of ids; ties of distance go to the
lower entry; no vectors: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import cut, forget, salted_join
from tidewater.llm.vectors import matrix, squared_distances, whole_numbers

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A part that a hundredth of all vectors has at its position is joined by broadcast: HOT * parts rows at most.
HOT = 100

SUMS = "pos int, entry int, k int, total bigint"


def cut_up(q: Column, parts: int, width: int) -> Column:
    """The parts of a vector, zeros appended."""
    full = F.concat(q, F.array_repeat(F.lit(0).cast("bigint"), F.lit(parts * width) - F.size(q)))
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(full, i * width + 1, width))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest row of ``book`` (the first of equals) and the squared distance."""
    far = squared_distances(x, book)
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at]


def sums_of(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """Per position, entry and component the weighted sum of the parts assigned; component -1 is their number."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, entries, width + 1), np.int64)
        for b in batches:
            pos, x, weight = b.column(0).to_numpy(), matrix(b.column(1), width), b.column(2).to_numpy()
            for p in np.unique(pos):
                own = pos == p
                at, _ = nearest(x[own], books[p])
                np.add.at(totals[p], at, np.column_stack([weight[own], x[own] * weight[own, None]]))
        p, e = np.nonzero(totals[:, :, 0])
        every = np.arange(-1, width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(p, width + 1), pa.int32()), pa.array(np.repeat(e, width + 1), pa.int32()), pa.array(np.tile(every, len(p)), pa.int32()), pa.array(totals[p, e].ravel(), pa.int64())],
            ["pos", "entry", "k", "total"],
        )

    return distinct.mapInArrow(run, SUMS).groupBy("pos", "entry", "k").agg(F.sum("total").alias("total"))


def moved(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The codebooks after a round: floored means, entries without parts as they were."""
    parts, entries, width = books.shape
    got = np.zeros((parts, entries, width + 1), np.int64)
    for r in sums.collect():  # parts * entries * (width + 1) rows at most
        got[r["pos"], r["entry"], r["k"] + 1] = r["total"]
    count = got[:, :, :1]
    return np.where(count > 0, got[:, :, 1:] // np.maximum(count, 1), books)


def coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """``distinct`` with the entry of each part and its squared distance."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, x = b.column(0).to_numpy(), matrix(b.column(1), width)
            at, far = np.zeros(len(pos), np.int32), np.zeros(len(pos), np.int64)
            for p in np.unique(pos):
                own = pos == p
                at[own], far[own] = nearest(x[own], books[p])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array(far, pa.int64())], ["pos", "part", "weight", "entry", "error"])

    return distinct.mapInArrow(run, "pos int, part array<bigint>, weight bigint, entry int, error bigint")


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows ``(id, label, codes, error)``, ``codes`` the entries in part order, and the codebooks ``[part, entry, component]``."""
    rows = cut(whole_numbers(df, id_col, vec_col, label=F.col(label_col)).withColumn("row", F.monotonically_increasing_id()), "whole")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dim")).first()
    width = max(1, -(-(size["dim"] or 0) // parts))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "q").select("q").limit(entries).collect()
    books = np.zeros((parts, len(first), width), np.int64)
    for i, r in enumerate(first):
        flat = np.zeros(parts * width, np.int64)
        flat[: len(r["q"])] = r["q"]
        books[:, i, :] = flat.reshape(parts, width)
    pieces = rows.select("row", "id", "label", F.posexplode(cut_up(F.col("q"), parts, width)).alias("pos", "part"))
    if not first:
        empty = rows.select("id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("bigint").alias("error"))
        return empty, books
    distinct = cut(pieces.groupBy("pos", "part").agg(F.count("*").alias("weight")), "distinct")
    for _ in range(rounds):
        books = moved(books, sums_of(distinct, books))
    table = cut(coded(distinct, books), "coded")
    forget(distinct)
    common = F.col("weight") * HOT >= size["n"]
    hot = F.broadcast(table.where(common).select("pos", "part", "entry", "error"))
    cold = table.where(~common).select("pos", "part", "entry", "error")
    found = pieces.join(hot, ["pos", "part"]).unionByName(pieces.join(hot, ["pos", "part"], "left_anti").join(cold, ["pos", "part"]))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "entry")))  # `parts` of them
    back = found.groupBy("row", "id", "label").agg(ordered.alias("s"), F.sum("error").alias("error"))
    return back.select("id", "label", F.col("s.entry").alias("codes"), "error"), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def by_label(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the errors summed over equal labels, nulls together; a label may hold any part of the rows."""
    rows = cut(codes.withColumn("k", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes")
    totals = rows.groupBy("k").agg(F.sum("error").alias("label_error"))
    return salted_join(rows, totals, "k").drop("k")


def digests(df: DataFrame) -> DataFrame:
    """Per vector its code in hexadecimal, its error, its label's error and the digest of all codebooks."""
    codes, books = compress(df)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return by_label(codes).select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds written out in DuckDB's SQL, for tables whose vectors are all of one length that ``parts`` divides."""
    nearest = "arg_min(b.e, list_sum(list_transform(list_zip(d.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {n} + b.e)"
    far = "min(list_sum(list_transform(list_zip(d.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))::BIGINT"
    steps = [
        f"""kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q, row_number() OVER () AS r FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (SELECT r, vec_id, label, p, q[p * (len(q) // {parts}) + 1:(p + 1) * (len(q) // {parts})] AS x FROM kept, range({parts}) t(p)),
        uniq AS (SELECT p, x, count(*) AS w FROM parts GROUP BY p, x),
        b0 AS (SELECT p, e, x AS c FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM kept) USING (r) WHERE e < {entries})"""
    ]
    for i in range(rounds):
        steps.append(
            f"""a{i} AS (SELECT d.p, d.x, any_value(d.w) AS w, {nearest.format(n=entries)} AS e FROM uniq d JOIN b{i} b ON d.p = b.p GROUP BY d.p, d.x),
        s{i} AS (SELECT p, e, k, sum(w * x[k])::BIGINT AS s, sum(w)::BIGINT AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM a{i}) GROUP BY p, e, k),
        m{i} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS c FROM s{i} GROUP BY p, e),
        b{i + 1} AS (SELECT p, e, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (p, e))"""
        )
    steps.append(
        f"""f AS (SELECT d.p, d.x, {nearest.format(n=entries)} AS e, {far} AS far FROM uniq d JOIN b{rounds} b ON d.p = b.p GROUP BY d.p, d.x),
        v AS (SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM parts JOIN f USING (p, x) GROUP BY r)"""
    )
    return "WITH " + ",\n".join(steps) + f"""
        SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
          (SELECT sha256(string_agg(c[k]::VARCHAR, ',' ORDER BY p, e, k)) FROM (SELECT p, e, c, unnest(range(1, len(c) + 1)) AS k FROM b{rounds})) AS codebooks_sha256 FROM v"""
