"""Tables that cut lineage, kept in the folder which the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_DIR = "stridelake.shared.dir"
ROWS_A_FILE = 2500  # documents, classes or what goes with one of them


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where the setting is absent in a local session, as in tests, a folder of this
    machine is taken instead, once a session.  On a cluster its absence is an error: other
    machines couldn't read that folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(OWN_DIR, None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        root = tempfile.mkdtemp(prefix="stridelake-")
        spark.conf.set(OWN_DIR, root)
    return root.rstrip("/")


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/stridelake-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_session_folder(spark)}/{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in ``parts`` files at most, and return the table read back.

    A lost executor then costs the tasks that were running on it and nothing
    that lies before the cut.
    """
    if parts:
        df = df.coalesce(parts)
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in a partition for each ``ROWS_A_FILE`` of ``rows``, or for each core if that is more; never in more than it has.

    Many more shuffle partitions than that would only write small files.  Each costs a local file system two
    processes, which set its permissions and share the executor's memory while they start.
    """
    return df.coalesce(max(1 + rows // ROWS_A_FILE, df.sparkSession.sparkContext.defaultParallelism))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote, once nothing that is still to run reads it."""
    _delete(df.sparkSession, df._cut_path)


def release(spark: SparkSession) -> None:
    """Delete all tables of this application; its results must have been written by then."""
    _delete(spark, _session_folder(spark))


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
