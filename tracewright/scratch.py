"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own switch that deletes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that the cluster names in spark.checkpoint.dir. Where that is
    unset, a local session gets /tmp/checkpoints and a cluster a folder of its
    warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
        return "file:///tmp/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def _file_system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), there


def _folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the process ends."""
    folder = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    files, there = _file_system(spark, folder)
    files.mkdirs(there)
    files.deleteOnExit(there)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for files that go when the process ends."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    That cuts the lineage: after the loss of an executor nothing before it runs again.
    The table goes with drop(), at the end of the temporary() around it, or when the
    session's process ends. The shuffle files of the writing go at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    if _scopes:
        _scopes[-1].append(back)
    return back


def drop(*saved: DataFrame) -> None:
    """Delete the tables of frames that save() returned."""
    for df in saved:
        files, there = _file_system(df.sparkSession, df._scratch)
        files.delete(there, True)


@contextmanager
def temporary():
    """Tables saved inside go at the end, but for those taken out of the list it gives."""
    _scopes.append(own := [])
    try:
        yield own
    finally:
        _scopes.remove(own)
        drop(*own)
