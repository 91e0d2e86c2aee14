"""Sources: declared schemas everywhere, nothing is inferred from text feeds."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StringType, StructField, StructType

MAX_PAGES = 10_000


def all_text(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob of any file system that Spark knows matches something."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def parquet(spark: SparkSession, *patterns: str) -> DataFrame:
    """One scan over all patterns that match; none: an error."""
    there = [p for p in patterns if exists(spark, p)]
    if not there:
        raise FileNotFoundError(f"no data under {', '.join(patterns)}")
    return spark.read.option("mergeSchema", "false").parquet(*there)


def csv_text(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV file with a header, every column as text."""
    return spark.read.schema(all_text(columns)).option("header", True).option("enforceSchema", False).csv(path)


def json_array(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A file that is one JSON array of objects."""
    return spark.read.schema(all_text(columns)).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, columns: Sequence[str], since_col: str | None = None, since: str | None = None) -> DataFrame:
    """One JSON object a line; with ``since``, rows whose ``since_col`` (an ISO time) is not before it."""
    df = spark.read.schema(all_text(columns)).json(path)
    return df.where(F.col(since_col).try_cast("timestamp") >= F.lit(since).cast("timestamp")) if since_col and since else df


def page_paths(folder: str, first: str, read: Callable[[str], str]) -> list[str]:
    """Paths of a cursor-linked feed (``has_more``, ``next_cursor`` names the next file).

    Raises on a page that is missing, a loop, or more than ``MAX_PAGES`` pages.
    """
    out, seen, name = [], set(), first
    while name:
        if name in seen:
            raise ValueError(f"the page cursor loops at {name}")
        if len(out) >= MAX_PAGES:
            raise ValueError(f"more than {MAX_PAGES} pages")
        seen.add(name)
        out.append(path := f"{folder}/{name}")
        try:
            page = json.loads(read(path))
        except FileNotFoundError as e:
            raise FileNotFoundError(f"page {path} is missing") from e
        name = page.get("next_cursor") if page.get("has_more") else None
    return out


def read_text(spark: SparkSession) -> Callable[[str], str]:
    """A reader of small text files in whatever store Spark reads."""

    def read(path: str) -> str:
        if not exists(spark, path):
            raise FileNotFoundError(path)
        return spark.read.option("wholetext", True).text(path).first()["value"]

    return read


def paged(spark: SparkSession, folder: str, first: str, columns: Sequence[str]) -> DataFrame:
    """The rows of all pages' ``data`` arrays, as text: the cursors are walked on the driver, the pages are read together."""
    paths = page_paths(folder, first, read_text(spark))
    item = ", ".join(f"`{c}`: string" for c in columns)
    pages = spark.read.schema(f"data array<struct<{item}>>").option("multiLine", True).json(paths)
    return pages.select(F.explode("data").alias("r")).select("r.*")


class KeysetSource(DataSource):
    """Rows of a keyset-paginated service: ``fetch(after, since)`` gives a page of rows and the next key or None.

    Options: ``module`` and ``function`` name an importable ``fetch``; ``schema``
    its columns; ``since`` is passed on, so that the service filters.
    """

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return KeysetReader(dict(self.options))


class KeysetReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        fetch = getattr(importlib.import_module(self.options["module"]), self.options["function"])
        after, pages = None, 0
        while True:
            rows, after_next = fetch(after, self.options.get("since"))
            yield from map(tuple, rows)
            pages += 1
            if after_next is None:
                return
            if after_next == after or pages >= MAX_PAGES:
                raise ValueError("the service's pages don't end")
            after = after_next


class KeyRange(InputPartition):
    """Keys after ``after`` up to ``until``; None: without bound."""

    def __init__(self, after: object, until: object) -> None:
        super().__init__((after, until))
        self.after, self.until = after, until


class RangedSource(DataSource):
    """A keyset-paginated service read by several tasks, with what it can filter pushed to it.

    Options: ``module`` and ``function`` name an importable
    ``fetch(after, until, since)``, which gives a page of rows whose keys lie after
    ``after`` and up to ``until`` and whose time isn't before ``since``, and the key
    to go on after, or None; ``bounds`` (in the same module) gives for a number of
    partitions the keys that part them. ``key`` and ``time`` name the columns,
    ``schema`` all of them. A task reads its own range from its start, so one that
    is repeated repeats no row of the result. Needs
    ``spark.sql.python.filterPushdown.enabled`` for filters to be pushed.
    """

    @classmethod
    def name(cls) -> str:
        return "keyset_ranges"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangedReader(dict(self.options))


class RangedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.since, self.after, self.until = options, None, None, None

    def _named(self, option: str):  # noqa: ANN202
        import importlib

        return getattr(importlib.import_module(self.options["module"]), self.options[option])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds on the time and on the key narrow what is fetched. Only an inclusive lower bound of the time is the service's own; all others Spark tests again."""
        later = lambda a, b: b if a is None else max(a, b)
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == self.options.get("time") and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.since = later(self.since, f.value)
                if isinstance(f, GreaterThanOrEqual):
                    continue
            elif column == self.options["key"] and isinstance(f, GreaterThan):
                self.after = later(self.after, f.value)
            elif column == self.options["key"] and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.until = f.value if self.until is None else min(self.until, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        n = int(self.options.get("partitions", 8))
        inner = [b for b in self._named("bounds")(n) if (self.after is None or b > self.after) and (self.until is None or b < self.until)]
        edges = [self.after, *inner, self.until]
        return [KeyRange(a, b) for a, b in zip(edges, edges[1:])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch, after = self._named("function"), partition.after
        while True:
            rows, after_next = fetch(after, partition.until, self.since)
            yield from map(tuple, rows)
            if after_next is None:
                return
            if after is not None and after_next <= after:
                raise ValueError("the service's pages don't go on")
            after = after_next


def only_reads(query: str) -> str:
    """A table's name or one SELECT; anything else is refused."""
    plain = query.strip().rstrip(";")
    if ";" in plain or not re.fullmatch(r"(?is)[\w.\"]+|(select|with)\b.*", plain) or re.search(r"(?i)\b(insert|update|delete|merge|drop|alter|create|truncate|grant|call|into)\b", re.sub(r"'[^']*'|\"[^\"]*\"", "", plain)):
        raise PermissionError("sources are read only")
    return plain if re.fullmatch(r"[\w.\"]+", plain) else f"({plain}) t"


def database(spark: SparkSession, url: str, query: str, key: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table or SELECT over JDBC, read only; with a numeric or date ``key`` by ``partitions`` tasks over its range. Filters and columns are pushed to the database."""
    what = only_reads(query)
    reader = spark.read.format("jdbc").options(url=url, **options)
    if key is not None:
        only_reads(key)
        ends = reader.option("query", f"SELECT min({key}) AS low, max({key}) AS high FROM {what}").load().first()
        if ends[0] is not None:
            reader = spark.read.format("jdbc").options(url=url, **options).options(partitionColumn=key, lowerBound=str(ends[0]), upperBound=str(ends[1]), numPartitions=str(partitions))
        else:
            reader = spark.read.format("jdbc").options(url=url, **options)
    return reader.option("dbtable", what).load()


def with_parent(child: DataFrame, parent: DataFrame, key: str, *borrowed: str) -> DataFrame:
    """Child rows with columns borrowed from their parent (its time, to capture them by)."""
    return child.join(parent.select(key, *borrowed), key)


def calendar(spark: SparkSession, first: Column, last: Column) -> DataFrame:
    """One row a day, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(first.cast("date"), last.cast("date"), F.expr("interval 1 day"))).alias("day"))


def transform_results(results: dict, manifest: dict) -> list[dict]:
    """Rows (name, target, status, failures, message) of a transform tool's run results; names and targets come from its manifest."""
    out = []
    for r in results.get("results", []):
        node = manifest.get("nodes", {}).get(r["unique_id"], {})
        if node.get("resource_type", r["unique_id"].split(".")[0]) != "test":
            continue
        refs = [d.split(".")[-1] for d in node.get("depends_on", {}).get("nodes", [])]
        out.append({"name": node.get("name", r["unique_id"].split(".")[-1]), "target": refs[0] if refs else "", "status": r["status"], "failures": int(r.get("failures") or 0), "message": r.get("message") or ""})
    return out
