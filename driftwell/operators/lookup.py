"""Counts, bounds and point lookups for batches of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import PAGE, PositionIndex, sent


def range_counts(index: PositionIndex, queries: DataFrame) -> DataFrame:
    """(qid, n): records in [lo, hi]."""
    return index.bounds(queries).select("qid", "n")


def selectivity(index: PositionIndex, queries: DataFrame) -> DataFrame:
    """(qid, n, total, per_million): integer share of the records in range."""
    total = F.lit(index.size).cast("long").alias("total")
    return index.bounds(queries).select("qid", "n", total).select("qid", "n", "total", F.expr("cast(n * 1000000 div nullif(total, 0) as bigint)").alias("per_million"))


def lower_bound(index: PositionIndex, probes: DataFrame) -> DataFrame:
    """(probe, pos): ordinal of the first record with key >= x."""
    return index.count_below(probes).select("probe", F.col("below").alias("pos"))


def upper_bound(index: PositionIndex, probes: DataFrame) -> DataFrame:
    """(probe, pos): ordinal of the first record with key > x."""
    after = probes.withColumn("x", F.try_add(F.col("x"), F.lit(1).cast("long")))
    return index.count_below(after).select("probe", F.col("below").alias("pos"))


def bound_pages(index: PositionIndex, probes: DataFrame) -> DataFrame:
    """(probe, lower, upper): the pages, counted over the whole index, of the first record with key >= x and of the first with key > x; null without any."""
    both = lower_bound(index, probes).withColumnRenamed("pos", "lower").join(upper_bound(index, probes).withColumnRenamed("pos", "upper"), "probe")
    firsts, before = [], 0
    for p in index.held:
        firsts.append((p.start, p.start + p.cnt, before))
        before += -(-p.cnt // PAGE)
    if not firsts:
        return both.select("probe", *[F.lit(None).cast("long").alias(c) for c in ("lower", "upper")])
    cell = max(1, -(-index.size // len(firsts)))
    grid = [(g, *f) for f in firsts for g in range(f[0] // cell, (f[1] - 1) // cell + 1)]
    for end in ("lower", "upper"):
        cells = F.broadcast(index.spark.createDataFrame(grid, "cell long, first long, stop long, pages long"))  # two rows a partition, about
        at = both.select("probe", F.col(end).alias("pos"), F.expr(f"{end} div {cell}").alias("cell")).join(cells, "cell").where("pos >= first and pos < stop")
        page = at.select("probe", F.expr(f"pages + (pos - first) div {PAGE}").alias("page"))
        both = both.drop(end).join(page.withColumnRenamed("page", end), "probe", "left")
    return both.select("probe", "lower", "upper")


def equal_range(index: PositionIndex, probes: DataFrame) -> DataFrame:
    """(probe, first, stop): ordinals of the records with key = x, stop excluded."""
    return lower_bound(index, probes).withColumnRenamed("pos", "first").join(upper_bound(index, probes).withColumnRenamed("pos", "stop"), "probe")


def multiplicity(records: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, x, n): copies of each key; 0 where it is absent. Counts are made before the join; few probes are sent to the records."""
    counts = records.join(sent(probes.select(F.col("x").alias("key")).distinct()), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return probes.join(counts, probes["x"] == counts["key"], "left").select("probe", "x", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def exists(records: DataFrame, probes: DataFrame) -> DataFrame:
    return multiplicity(records, probes).select("probe", "x", (F.col("n") > 0).alias("found"))


def key_domain(records: DataFrame) -> DataFrame:
    return records.agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("n"))
