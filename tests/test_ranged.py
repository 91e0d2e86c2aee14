"""Sources that several tasks read, with filters pushed to them: a keyset service that counts what it sends, and a database."""

from __future__ import annotations

import os

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tidewater.sources import readers

ROWS = [(k, f"n{k}", 1000 + (k * 37) % 500) for k in range(1, 1001)]
PAGE = 40


def bounds(n):
    return [1000 * i // n for i in range(1, n)]


def fetch(after, until, since):
    """A page of the service; what it sends is noted in a folder that the test names."""
    there = [r for r in ROWS if (after is None or r[0] > after) and (until is None or r[0] <= until) and (since is None or r[2] >= since)]
    page, more = there[:PAGE], len(there) > PAGE
    task = TaskContext.get()
    with open(f"{os.environ['SENT']}/{task.partitionId()}-{task.attemptNumber()}", "a") as f:
        f.writelines(f"{r[0]}\n" for r in page)
    return page, page[-1][0] if more else None


class Noting(readers.RangedReader):
    """Hands the test's folder to the workers, whose environment is older than the test."""

    def _named(self, option):
        os.environ["SENT"] = self.options["folder"]
        return super()._named(option)


class NotingSource(readers.RangedSource):
    @classmethod
    def name(cls):
        return "noting_ranges"

    def reader(self, schema):
        return Noting(dict(self.options))


@pytest.fixture
def source(spark, tmp_path):
    spark.dataSource.register(NotingSource)

    def load(partitions=4):
        return spark.read.format("noting_ranges").options(module="tests.test_ranged", function="fetch", bounds="bounds", schema="id long, name string, at long", key="id", time="at", partitions=partitions, folder=str(tmp_path)).load()

    return load


def sent(tmp_path):
    return sorted(int(x) for p in tmp_path.iterdir() if "-" in p.name and not p.name.startswith("failed") for x in p.read_text().split())


def test_ranges_are_read_by_tasks_of_their_own(source, tmp_path):
    df = source()
    assert df.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, df.collect())) == ROWS
    assert sent(tmp_path) == [r[0] for r in ROWS]  # each row once


def test_filters_reach_the_service(source, tmp_path):
    got = source().where("at >= 1400").select("id").collect()
    want = [r[0] for r in ROWS if r[2] >= 1400]
    assert sorted(r[0] for r in got) == want == sent(tmp_path)  # only these were sent


def test_bounds_of_the_key_narrow_the_ranges(source, tmp_path):
    df = source().where("id > 300 AND id <= 420 AND at > 1100 AND name <> 'n310'")
    want = [r[0] for r in ROWS if 300 < r[0] <= 420 and r[2] > 1100 and r[1] != "n310"]
    assert sorted(r["id"] for r in df.collect()) == want
    assert sent(tmp_path) == [r[0] for r in ROWS if 300 < r[0] <= 420 and r[2] >= 1100]
    assert df.rdd.getNumPartitions() == 1


def test_pages_that_do_not_go_on_are_an_error():
    reader = readers.RangedReader({"key": "id", "module": "tests.test_ranged", "function": "stuck"})
    with pytest.raises(ValueError, match="don't go on"):
        list(reader.read(readers.KeyRange(0, None)))


def test_a_range_read_again_gives_the_same(tmp_path, monkeypatch):
    reader = readers.RangedReader({"key": "id", "module": "tests.test_ranged", "function": "pages"})
    part = readers.KeyRange(250, 500)
    assert list(reader.read(part)) == list(reader.read(part)) == [r for r in ROWS if 250 < r[0] <= 500]


def pages(after, until, since):
    there = [r for r in ROWS if r[0] > after and r[0] <= until]
    return there[:PAGE], there[PAGE - 1][0] if len(there) > PAGE else None


def stuck(after, until, since):
    return [(1, "x", 1)], 0


# -- database ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    at = f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/db;create=true"
    rows = spark.range(1, 1001).select(F.col("id").cast("int").alias("ID"), F.concat(F.lit("n"), "id").alias("NAME"))
    rows.write.jdbc(at, "CUSTOMER")
    return at


def test_database_in_ranges_with_pushed_filters(spark, url):
    df = readers.database(spark, url, "CUSTOMER", key="ID", partitions=4)
    assert df.rdd.getNumPartitions() == 4
    assert sorted(r["ID"] for r in df.collect()) == list(range(1, 1001))
    some = df.where("ID > 990").select("ID")
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThan(ID,990)]" in some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 10
    assert [r[0] for r in readers.database(spark, url, "SELECT ID FROM CUSTOMER WHERE ID = 7 AND 'delete' <> 'x'").collect()] == [7]


@pytest.mark.parametrize("query", ["DELETE FROM CUSTOMER", "SELECT 1; DROP TABLE CUSTOMER", "drop table x", "select * from (delete from x returning *) t", "SELECT * INTO y FROM x", "call p()", "customer where 1 = 1"])
def test_databases_are_only_read(spark, url, query):
    with pytest.raises(PermissionError):
        readers.database(spark, url, query)


def test_quoted_words_are_no_commands():
    assert readers.only_reads("SELECT 'delete' AS x FROM t").startswith("(SELECT")
    assert readers.only_reads('public."Order"') == 'public."Order"'
