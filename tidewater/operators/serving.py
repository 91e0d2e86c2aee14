"""Reading for pages and dashboards: keyset pages, watermarks, ratios recomputed from sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.scalar import cursor, percent, position_of


def keyset_page(df: DataFrame, ts: str, key: str, limit: int, after: tuple[object, object] | str | None = None, since: object | None = None, where: Column | None = None) -> DataFrame:
    """A page of ``limit`` rows after a position or a page's cursor, ordered by (ts, key), each with ``has_more`` and its ``cursor``.

    The bound on ``ts`` alone is implied; it is spelt out because it can be
    pushed to the scan and a comparison of pairs can't.
    """
    if not 1 <= limit <= 500:
        raise ValueError("a page has 1 to 500 rows")
    if where is not None:
        df = df.where(where)
    if since is not None:
        df = df.where(F.col(ts) >= F.lit(since))
    if isinstance(after, str):
        after = position_of(after)
    if after is not None:
        at, k = (F.lit(x) for x in after)
        df = df.where(F.col(ts) >= at.cast(df.schema[ts].dataType)).where(F.struct(F.col(ts).alias("a"), F.col(key).alias("b")) > F.struct(at.cast(df.schema[ts].dataType).alias("a"), k.cast(df.schema[key].dataType).alias("b")))
    page = df.orderBy(ts, key).limit(limit + 1)
    w = Window.orderBy(ts, key)  # limit + 1 rows
    page = page.withColumn("_n", F.row_number().over(w)).withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit)
    return page.where(F.col("_n") <= limit).withColumn("cursor", cursor(F.col(ts), F.col(key))).drop("_n")


def watermark(runs: DataFrame, step: str = "step", status: str = "status", at: str = "at") -> DataFrame:
    """One row: when and with which step data last became complete, and how many runs are under way."""
    done = F.col(status) == "SUCCESS"
    return runs.agg(F.max(F.when(done, F.col(at))).alias("watermark"), F.max_by(F.when(done, F.col(step)), F.when(done, F.struct(F.col(at).alias("a"), F.col(step).alias("b")))).alias("latest_step"), F.count_if(F.col(status) == "RUNNING").alias("in_flight"))


def recompute(df: DataFrame, by: Sequence[str], sums: Sequence[str], ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Sums by group, and ratios of those sums; ratios are never added up."""
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums]).withColumns({n: percent(F.col(a), F.col(b)) for n, (a, b) in ratios.items()})


def funnel(totals: DataFrame, steps: Sequence[str]) -> DataFrame:
    """A one-row frame of step totals as rows ``(step_number, step, sessions, pct_of_top, pct_of_previous)``."""
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("step_number"), F.lit(s).alias("step"), F.col(s).cast("bigint").alias("sessions")) for i, s in enumerate(steps, 1)])
    long = totals.select(F.inline(rows))
    w = Window.orderBy("step_number")  # one row a step
    return long.withColumn("pct_of_top", percent(F.col("sessions"), F.first("sessions").over(w))).withColumn("pct_of_previous", percent(F.col("sessions"), F.lag("sessions").over(w)))


def require_additive(df: DataFrame, *summed: str) -> None:
    """Ratio measures carry the prefix ``nadd_``; asking to sum one raises."""
    bad = [c for c in summed if c.startswith("nadd_") or c not in df.columns]
    if bad:
        raise ValueError(f"not additive: {', '.join(bad)}")


def merge_counts(df: DataFrame, by: Sequence[str], map_col: str) -> DataFrame:
    """Maps of counts merged by adding values of equal keys."""
    return df.select(*by, F.explode(map_col).alias("key", "n")).groupBy(*by, "key").agg(F.sum("n").alias("n"))
