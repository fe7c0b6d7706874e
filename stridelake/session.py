"""Session factory with the settings that every plan of the engine assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "stridelake", master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Return a session in UTC with adaptive execution.

    ``master`` and ``shuffle_partitions`` are left to the cluster's own
    configuration when they are not given.  ``extra`` takes further Spark
    settings with dots written as double underscores.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf |= {k.replace("__", "."): v for k, v in extra.items()}
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
