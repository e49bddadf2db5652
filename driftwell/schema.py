"""Schemas of records, operation logs and queries, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.LongType())])
OP_LOG = T.StructType([T.StructField("seq", T.LongType()), *RECORD.fields, T.StructField("op", T.StringType())])
QUERY = T.StructType([T.StructField(c, T.LongType()) for c in ("qid", "lo", "hi", "k")])
#: What runs hold: operations of n copies.
RUN = T.StructType([*OP_LOG.fields, T.StructField("n", T.LongType())])

INSERT, DELETE = "I", "D"


def records(df: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` as records (key, value)."""
    return df.select(F.col(key).cast("long").alias("key"), F.col(value).cast("long").alias("value"))


def unsigned_keys(df: DataFrame) -> DataFrame:
    """Records whose unsigned 64-bit keys arrive as text or decimal; keys of 2**63 or more raise."""
    wide = F.col("key").cast("decimal(20,0)")
    return df.withColumn("key", F.when(wide < F.lit(0), F.raise_error(F.lit("negative key"))).when(wide > F.lit((1 << 63) - 1).cast("decimal(20,0)"), F.raise_error(F.lit("key of 2^63 or more"))).otherwise(wide.cast("long")))


def queries(spark, rows: list[tuple[int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, QUERY)
