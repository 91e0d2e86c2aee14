"""Slowly changing dimensions: point-in-time rewind, version history, as-of joins.

The history is what a snapshot at every change instant of the whole log, oldest
first, and one at the end would have recorded. A customer's state is constant
between their own changes, so no customers x instants product is formed: the
candidate instants of a customer are the first snapshot after they signed up and
their own changes after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.materialise import written

#: Stand-ins for infinite timestamps, which Spark has not.
FIRST, LAST = "1900-01-01 00:00:00", "9999-12-31 00:00:00"


#: A key with more than a task's share over PIECES is cut by time into CUTS pieces.
PIECES, CUTS = 8, 256


def as_of(fact: DataFrame, versions: DataFrame, keys: Sequence[tuple[str, str]], ts: str, how: str = "left", valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Each fact row with the version valid at its ``ts``: equal keys, valid_from <= ts < valid_to.

    Facts and versions lie in one line a key, by time, and the last version is
    carried over the facts after it: work is linear in both, however many
    versions a key has. A key that holds much of the facts is cut by time into
    pieces, which other tasks take; versions that reach into several pieces are
    carried into each. Facts with a null key or time find nothing. Versions of a
    key must not overlap.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    row = fact.select(*[F.col(a).alias(n) for n, (a, _) in zip(names, keys, strict=True)], F.col(ts).cast("timestamp").alias("_t"), F.struct(*[F.col(f"`{c}`") for c in fact.columns]).alias("_row"))
    span = versions.select(*[F.col(b).cast(row.schema[n].dataType).alias(n) for n, (_, b) in zip(names, keys, strict=True)], F.col(valid_from).cast("timestamp").alias("_t"), F.col(valid_to).cast("timestamp").alias("_end"), F.struct(*[F.col(f"`{c}`") for c in versions.columns]).alias("_ver"))
    cuts = hot_cuts(row, names)
    if cuts is None:
        row, span = row.withColumn("_piece", F.lit(0)), span.withColumn("_piece", F.lit(0))
    else:
        before, upto = (lambda c: F.size(F.filter("_cuts", lambda b: b < c))), (lambda c: F.size(F.filter("_cuts", lambda b: b <= c)))
        among = before(F.col("_t")) + F.pmod(F.xxhash64("_row"), upto(F.col("_t")) - before(F.col("_t")) + 1).cast("int")
        cut = lambda df: df.join(F.broadcast(cuts), names, "left")
        row = cut(row).withColumn("_piece", F.when(F.col("_cuts").isNotNull() & F.col("_t").isNotNull(), among).otherwise(0)).drop("_cuts")
        reach = F.when(F.col("_cuts").isNotNull(), F.sequence(before(F.col("_t")), upto(F.col("_end")))).otherwise(F.array(F.lit(0)))
        span = cut(span).withColumn("_piece", F.explode(reach)).drop("_cuts")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    line = row.select(*names, "_piece", "_t", none(span, "_end"), none(span, "_ver"), "_row").union(span.where(F.col("_t").isNotNull()).select(*names, "_piece", "_t", "_end", "_ver", none(row, "_row")))
    # at one instant versions come first, the one that stays last among them
    w = Window.partitionBy(*names, "_piece").orderBy("_t", F.col("_row").isNotNull(), "_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.last(F.when(F.col("_ver").isNotNull(), F.struct("_end", "_ver")), ignorenulls=True).over(w)
    got = line.withColumn("_held", held).where(F.col("_row").isNotNull())
    known = F.col("_t").isNotNull()
    for n in names:
        known = known & F.col(n).isNotNull()
    got = got.withColumn("_ver", F.when(known & (F.col("_t") < F.col("_held._end")), F.col("_held._ver")))
    if how == "inner":
        got = got.where(F.col("_ver").isNotNull())
    return got.select("_row.*", "_ver.*")


def hot_cuts(row: DataFrame, names: list[str]) -> DataFrame | None:
    """``(*names, _cuts)`` for keys that hold more than ``1 / (PIECES * tasks)`` of the rows, so fewer than that many: times that cut them evenly. None if no key does."""
    tasks = max(8, int(row.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = written(row.groupBy(*names).agg(F.count("*").alias("n")), "key_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * PIECES * tasks > total).where(" AND ".join(f"{n} IS NOT NULL" for n in names)).where("n > 1000").select(*names)
    if hot.isEmpty():
        return None
    inside = row.select(*names, "_t").join(F.broadcast(hot), names)
    at = F.percentile_approx(F.col("_t").cast("double"), F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)]))
    return written(inside.groupBy(*names).agg(at.alias("q")).select(*names, F.transform("q", lambda x: x.cast("timestamp")).alias("_cuts")), "cuts")


def point_in_time(current: DataFrame, log: DataFrame, at: Column, key: str, fields: Sequence[str], signup: str) -> DataFrame:
    """``current`` rewound to an instant: for each field the latest new value up to it, else the earliest old value after it, else today's.

    Rows that had not signed up by then are left out. ``log`` has ``key``,
    ``changed_at``, ``field``, ``old_value``, ``new_value`` and ``seq``, which
    orders changes of one instant.
    """
    order = F.struct("changed_at", "seq")
    past, future = F.col("changed_at") <= at, F.col("changed_at") > at
    watched = log.where(F.col("field").isin(*fields))
    both = watched.groupBy(key, "field").agg(
        F.max_by(F.when(past, F.struct(F.col("new_value").alias("v"))), F.when(past, order)).alias("before"),
        F.min_by(F.when(future, F.struct(F.col("old_value").alias("v"))), F.when(future, order)).alias("after"),
    )
    # a struct tells a change to null from no change
    state = both.select(key, "field", F.coalesce("before", "after").alias("s"))
    wide = state.groupBy(key).pivot("field", list(fields)).agg(F.first("s"))
    wide = wide.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    out = current.where(F.col(signup).cast("date") <= at.cast("date")).join(wide, key, "left")
    return out.select(*[F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in current.columns])


def close_versions(changes: DataFrame, key: str, at: str) -> DataFrame:
    """Version number, validity and currency for one row an open of a version: the first opens at FIRST, the last closes at LAST."""
    w = Window.partitionBy(key).orderBy(at)
    out = changes.withColumn("version", F.row_number().over(w).cast("bigint")).withColumn("_next", F.lead(at).over(w))
    return out.select(
        *changes.columns,
        "version",
        F.when(F.col("version") == 1, F.to_timestamp(F.lit(FIRST))).otherwise(F.col(at)).alias("valid_from"),
        F.coalesce("_next", F.to_timestamp(F.lit(LAST))).alias("valid_to"),
        F.col("_next").isNull().alias("is_current"),
    )


def history(customers: DataFrame, log: DataFrame, end: Column, key: str = "customer_id", fields: Sequence[str] = ("loyalty_tier", "segment"), signup: str = "signup_date", deleted: str = "is_deleted") -> DataFrame:
    """``(key, fields..., opened_at, is_tombstone)``: a row for each version.

    ``log`` changes of ``fields`` and of ``deleted`` ('true'/'false') move the
    state; a deletion gives a tombstone that carries the state before it, a
    return opens a version again. Changes of other fields only count as
    instants at which a snapshot was taken.
    """
    instants = log.select(F.col("changed_at").alias("at")).union(customers.select(end.alias("at")).limit(1)).distinct()
    # First snapshot at or after sign-up: looked up once a calendar day, of which there are few.
    days = instants.groupBy(F.to_date("at").alias("day")).agg(F.min("at").alias("at"))
    signups = customers.select(F.col(signup).cast("date").alias("day")).distinct()
    ahead = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    calendar = days.unionByName(signups.withColumn("at", F.lit(None).cast("timestamp"))).groupBy("day").agg(F.min("at").alias("at")).select("day", F.last("at", ignorenulls=True).over(ahead).alias("first_at"))
    firsts = customers.select(key, F.col(signup).cast("date").alias("day")).join(calendar, "day").where("first_at IS NOT NULL").select(key, "first_at")
    watched = [*fields, deleted]
    moves = log.where(F.col("field").isin(*watched)).select(key, F.col("changed_at").alias("at"), "seq", "field", "old_value", "new_value")
    own = moves.select(key, "at").distinct().join(firsts, key).where("at > first_at").select(key, "at")
    points = firsts.select(key, F.col("first_at").alias("at")).union(own).distinct()
    # Moves and points in one sorted row a customer: the last move before a point, else what the first move of all found.
    line = moves.unionByName(points.withColumn("seq", F.lit((1 << 63) - 1)), allowMissingColumns=True)
    by_time = Window.partitionBy(key).orderBy("at", "seq")
    past, whole = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow), by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen_as = lambda f, c, how, w: how(F.when(F.col("field") == f, F.struct(F.col(c).alias("v"))), ignorenulls=True).over(w)
    state = line.select(key, "at", "field", *[seen_as(f, "new_value", F.last, past).alias(f"_b_{f}") for f in watched], *[seen_as(f, "old_value", F.first, whole).alias(f"_a_{f}") for f in watched])
    state = state.where("field IS NULL").join(customers.select(key, *watched), key)
    now = {f: F.coalesce(F.when(F.col(f"_b_{f}").isNotNull(), F.col(f"_b_{f}.v")).when(F.col(f"_a_{f}").isNotNull(), F.col(f"_a_{f}.v")).otherwise(F.col(f).cast("string")), F.lit("")) for f in watched}
    state = state.select(key, "at", *[now[f].alias(f) for f in fields], (now[deleted] == "true").alias("gone"))
    w = Window.partitionBy(key).orderBy("at")
    # A row gone from the start was never seen; while it is gone its state is the last one seen.
    seen = F.max(F.when(~F.col("gone"), 1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).isNotNull()
    kept = [F.last(F.when(~F.col("gone"), F.col(f)), ignorenulls=True).over(w).alias(f) for f in fields]
    state = state.select(key, "at", "gone", seen.alias("seen"), *kept).where("seen")
    differs = F.lag("at").over(w).isNull() | (F.lag("gone").over(w) != F.col("gone"))
    for f in fields:
        differs = differs | (F.lag(f).over(w) != F.col(f))
    return state.withColumn("_new", differs).where("_new").select(key, *fields, F.col("at").alias("opened_at"), F.col("gone").alias("is_tombstone"))


def overlaps(versions: DataFrame, key: str) -> DataFrame:
    """Versions that begin before the one ahead of them ends; none in a sound history."""
    w = Window.partitionBy(key).orderBy("version")
    return versions.withColumn("_end", F.lag("valid_to").over(w)).where("_end > valid_from").drop("_end")
