"""Sinks of the stages: Parquet between stages, CSV at the end. A stage's output replaces copies, chunks and saved objects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Releases the shuffle files of a query when it ends.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, path: str, by: str | None = None, append: bool = False) -> None:
    """Parquet, in a folder for each value of ``by`` (such as quality, which readers then prune by)."""
    writer = df.write.mode("append" if append else "overwrite").option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)


def table(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header; as many files as the table has partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def tables(named: dict[str, DataFrame], folder: str) -> str:
    """Result tables as CSV in a new folder of this run, and, once all of them are there, a row that says so; gives the run's name.

    A reader (readers.tables_of()) goes by these rows, so it sees all tables of a run or none of them.
    """
    run = uuid.uuid4().hex
    for name, df in named.items():
        table(df, f"{folder}/runs/{run}/{name}")
    done = next(iter(named.values())).sparkSession.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("at"), F.array(*map(F.lit, named)).alias("names"))
    done.coalesce(1).write.mode("append").parquet(f"{folder}/finished")
    return run


def shared(spark: SparkSession) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir. Only a session on one machine that names none gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def staged(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written to a shared() path (in a folder for each value of ``by``) and read back, so that it is worked out once and outlives executors.

    The shuffle files of the write are released when it ends, since the table replaces them.
    """
    path = shared(df.sparkSession)
    _released(df.sparkSession, lambda: stage(df, path, by))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path  # for dropped()
    return out


def dropped(staged: DataFrame) -> None:
    """Deletes a staged() table that no later step reads."""
    spark = staged.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(staged.staged_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _released(spark: SparkSession, write) -> None:
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        write()
    finally:
        spark.conf.set(_RELEASE, before)


def stack(columns: DataFrame, keys: list[str], path: str) -> None:
    """Movies as image columns (keys, t, x, col), in a folder for each column's place, so that cuts at some places read these only."""
    stage(columns.repartition("x", *keys), path, "x")


def series_store(df: DataFrame, keys: list[str], order: list[str], name: str, path: str, buckets: int = 64) -> DataFrame:
    """A table of series, bucketed by ``keys`` and sorted by ``order`` within, so that operators of series read it without a shuffle."""
    writer = df.repartition(buckets, *keys).write.mode("overwrite").option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys, *order).option("path", path)
    _released(df.sparkSession, lambda: writer.saveAsTable(name))
    return df.sparkSession.table(name)


def append_unfinished(df: DataFrame, folder: str, key: str) -> None:
    """Metadata, direction marks, traces or quality of the recordings (``key``) that ``folder`` does not hold yet, in a folder for each recording.

    What is there stays as it is, so a run that is repeated adds new recordings only. Recordings that are there are told by the names of their folders.
    """
    from ..operators.joins import unfinished
    from .readers import finished

    done = finished(df.sparkSession, folder)
    new = df if done is None else unfinished(df, done.select(F.col(key).cast(df.schema[key].dataType).alias(key)), [key])
    stage(new, folder, key, append=True)
