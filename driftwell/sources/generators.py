"""Reproducible records, ranges and workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import hashed


def sequential(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("key"), F.col("id").alias("value"))


def shuffled(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Keys 0..n-1 in random order with their place in it, from 1, as value."""
    from ..operators import index as ix

    drawn = spark.range(n).select(hashed(seed, F.col("id")).alias("key"), F.col("id").alias("value"))
    return ix.build(drawn).positions.select(F.col("value").alias("key"), (F.col("pos") + 1).alias("value"))


def external_shuffle(df: DataFrame, seed: int = 0, *by: str) -> DataFrame:
    """Rows in an order that a hash of the columns ``by`` gives."""
    return df.orderBy(hashed(seed, *[F.col(c) for c in by]), *by)


def placed_shuffle(df: DataFrame, seed: int = 0, *by: str) -> DataFrame:
    """``df`` with ``pos``, its place in the order of ``external_shuffle``."""
    from ..operators import index as ix

    return ix.numbered(df.withColumn("__h", hashed(seed, *[F.col(c) for c in by])), "__h", *by).withColumnRenamed("ordinal", "pos").drop("__h")


def ranges(spark: SparkSession, n: int, lo: int, hi: int, share: float, k: int = 1000, seed: int = 0) -> DataFrame:
    """n queries that each cover ``share`` of the key domain [lo, hi], at random places."""
    width = max(0, int((hi - lo) * share))
    start = F.lit(lo) + hashed(seed, "range", F.col("id")) % F.lit(max(1, hi - lo - width + 1))
    return spark.range(n).select(F.col("id").alias("qid"), start.alias("lo"), (start + width).alias("hi"), F.lit(k).cast("long").alias("k"))


def workload(records: DataFrame, delete_percent: int, seed: int = 0) -> DataFrame:
    """An operation log (seq, key, value, op) of ``records`` (n, key, value), n from 0 without gaps.

    Record n is inserted at seq 2n.  For ``delete_percent`` of the n, seq 2n+1 deletes a record that
    an earlier insert brought, drawn uniformly; a record may be drawn more than once.
    """
    inserts = records.select((F.col("n") * 2).alias("seq"), "key", "value", F.lit("I").alias("op"))
    chosen = records.where((hashed(seed, "del", F.col("n")) % 100 < delete_percent) & (F.col("n") > 0))
    drawn = chosen.select((F.col("n") * 2 + 1).alias("seq"), (hashed(seed, "pick", F.col("n")) % F.col("n")).alias("n"))
    deletes = drawn.join(records.select("n", "key", "value"), "n").select("seq", "key", "value", F.lit("D").alias("op"))
    return inserts.unionByName(deletes)


def mixed(spark: SparkSession, n: int, write_percent: int, delete_percent: int, seed: int = 0) -> DataFrame:
    """(i, op): n operations, each a write, a delete or a read by chance."""
    h = hashed(seed, "op", F.col("id")) % 100
    return spark.range(n).select(F.col("id").alias("i"), F.when(h < write_percent, "write").when(h < write_percent + delete_percent, "delete").otherwise("read").alias("op"))
