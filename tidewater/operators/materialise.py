"""Tables written in the middle of a plan, in the folder that all machines share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; under a temporary folder only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(base or f'file://{tempfile.gettempdir()}/tidewater').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a written table: what reads it twice reads the same rows. ``options`` are the writer's."""
    df.write.options(**options).parquet(path := scratch(df.sparkSession, name))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete folders, where they are, by whatever file system holds them."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def replace_partitions(df: DataFrame, path: str, column: str, touched: Iterable[object], dealt: bool = False, **options: str) -> None:
    """The partitions ``touched`` of the table at ``path`` become ``df``, others stay; those of which ``df`` has no row go.

    One dynamic partition overwrite; ``df`` may read the table itself and is
    computed once. Small partitions share a task, large ones are split among
    several, unless rows stay in the tasks that they lie in (``dealt``).
    """
    spark, parts = df.sparkSession, [f"{path}/{column}={v}" for v in set(touched)]
    before = {p: state_of(spark, p) for p in parts if there(spark, p)}
    rows = df if dealt else df.hint("rebalance", F.col(column))
    rows.write.partitionBy(column).mode("overwrite").options(**options).option("partitionOverwriteMode", "dynamic").parquet(path)
    forget(spark, *(p for p, state in before.items() if state_of(spark, p) == state))


def there(spark: SparkSession, p: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(p)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def state_of(spark: SparkSession, *paths: str) -> str:
    """A digest of the files under ``paths``: names, lengths and times of change; equal as long as nothing was written."""
    found = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def once(spark: SparkSession, name: str, inputs: Iterable[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives, written once for the application and read from then on, until a file of ``inputs`` changes."""
    base = scratch(spark, "x").rpartition("/")[0]
    path = f"{base}/{name}-{spark.sparkContext.applicationId}-{state_of(spark, *inputs)}"
    if not there(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
