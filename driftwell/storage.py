"""Shared storage of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where it is unset and the master is local."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="driftwell-"))
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A name in the shared folder that no other call gets; it goes when the JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    files, place = _at(spark, path)
    files.deleteOnExit(place)
    return path


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a table in the shared folder, in folders by the columns ``by``, read again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.partitionBy(*by).parquet(path)
    if not by:
        return spark.read.schema(df.schema).parquet(path)
    return spark.read.schema(df.schema).option("basePath", path).parquet(path).select(*df.columns)


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it isn't there."""
    files, place = _at(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(place)) if files.exists(place) else []


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    files, place = _at(spark, path)
    return int(files.getContentSummary(place).getLength()) if files.exists(place) else 0


def removed(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)


def io_counters(spark: SparkSession) -> DataFrame:
    """(scheme, bytes_read, bytes_written, read_ops, write_ops) of the driver's file systems since ``reset_io``.

    On a cluster the executors' reads and writes are in the metrics of their tasks.
    """
    rows = []
    for x in spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics():
        rows.append((x.getScheme(), x.getBytesRead(), x.getBytesWritten(), x.getReadOps(), x.getWriteOps()))
    return spark.createDataFrame(rows, "scheme string, bytes_read long, bytes_written long, read_ops long, write_ops long")


def reset_io(spark: SparkSession) -> None:
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.clearStatistics()


def partitions_for(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions of ``rows`` rows at ``each`` in one, and no fewer than shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
