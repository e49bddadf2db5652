"""Files of records and queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_K = 1000


def read_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Records of tab-separated ``value key`` lines; lines that aren't two numbers raise."""
    df = spark.read.csv(path, sep="\t", schema="value LONG, key LONG", mode="FAILFAST").select("key", "value")
    return df.limit(limit) if limit is not None else df


def read_weighted(spark: SparkSession, path: str) -> DataFrame:
    """Records with weights of ``value key weight`` lines."""
    return spark.read.csv(path, sep="\t", schema="value LONG, key LONG, weight LONG", mode="FAILFAST").select("key", "value", "weight")


def longitude_key(lon: Column) -> Column:
    """A degree of longitude as a key: (lon + 180) * 10**7, cut to a whole number."""
    return F.floor((lon + F.lit(180.0)) * F.lit(1e7)).cast("long")


def read_longitudes(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, sep="\t", schema="value LONG, lon DOUBLE", mode="FAILFAST")
    return df.select(longitude_key(F.col("lon")).alias("key"), "value")


def write_records(records: DataFrame, path: str) -> None:
    records.select("value", "key").write.csv(path, sep="\t")


def read_queries(spark: SparkSession, path: str, selectivity: float, k: int = DEFAULT_K) -> DataFrame:
    """Queries (qid, lo, hi, k) of ``lo hi selectivity`` lines with lo < hi and that selectivity."""
    df = spark.read.csv(path, sep="\t", schema="lo LONG, hi LONG, sel DOUBLE", mode="FAILFAST")
    near = df.where((F.col("lo") < F.col("hi")) & (F.abs(F.col("sel") - F.lit(selectivity)) < 1e-5))
    return near.select(F.monotonically_increasing_id().alias("qid"), "lo", "hi", F.lit(k).cast("long").alias("k"))


def query_block(lines: DataFrame, block: int, expected: float, size: int = 100) -> DataFrame:
    """The queries of one block of ``size`` lines (line, lo, hi, sel): lo < hi, and within a tenth of ``expected``."""
    mine = F.expr(f"line div {size}") == block
    return lines.where(mine & (F.col("lo") < F.col("hi")) & (F.abs(F.col("sel") - F.lit(expected)) / F.lit(expected) < 0.1))


def record_batches(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(batch, key, value): the records of ``read_records`` in batches of ``size`` lines, in the files' order.

    Places of lines come from the names of files, the offsets of their blocks and the order within them.
    """
    from ..operators import index as ix

    df = spark.read.csv(path, sep="\t", schema="value LONG, key LONG", mode="FAILFAST")
    placed = df.select("key", "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return ix.numbered(placed, "file", "block", "line").select(F.expr(f"ordinal div {size}").alias("batch"), "key", "value")


def read_keys(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Records of binary files of little-endian 64-bit keys; ``value`` is the place in all files, by name.

    A file is read by one task in pieces, so a large set should be many files.
    """
    files = spark.read.format("binaryFile").load(path)
    starts, start = [], 0
    for name, length in sorted(map(tuple, files.select("path", "length").collect())):  # a row for each file
        starts.append((name, start))
        start += length // 8
    begins = F.broadcast(spark.createDataFrame(starts, "path string, begin long"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content, begin in zip(b["content"], b["begin"], strict=True):
                keys = np.frombuffer(content, dtype="<u8")
                if len(keys) and keys.max() >= 1 << 63:
                    raise ValueError("key of 2^63 or more")
                for at in range(0, len(keys), 1 << 20):
                    part = keys[at : at + (1 << 20)].astype(np.int64)
                    yield pd.DataFrame({"key": part, "value": np.arange(begin + at, begin + at + len(part))})

    df = files.select("path", "content").join(begins, "path").select("content", "begin").mapInPandas(rows, "key long, value long")
    return df.where(F.col("value") < limit) if limit is not None else df
