"""Sessions for the engine: UTC, ANSI, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(name: str = "tidewater", master: str | None = None, **more: str) -> SparkSession:
    """A session with the engine's settings; ``more`` overrides them (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).getOrCreate()


def object_store(spark: SparkSession, endpoint: str, key: str, secret: str, path_style: bool = True) -> None:
    """Let ``s3a://`` paths of a compatible store be read and written."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in (("endpoint", endpoint), ("access.key", key), ("secret.key", secret), ("path.style.access", str(path_style).lower())):
        conf.set(f"fs.s3a.{k}", v)
