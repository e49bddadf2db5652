"""Sorted runs: flushes of the log, merges of runs, and what queries meet in each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .oplog import PAIR, live_counts, reduced


def arrivals(log: DataFrame, cap: int) -> DataFrame:
    """``log`` with ``ordinal`` (from 0, by seq) and ``flush`` = ordinal div cap."""
    from . import index as ix

    return ix.numbered(log, "seq").withColumn("flush", F.expr(f"ordinal div {cap}"))


def _both(ends: DataFrame, *by: str) -> DataFrame:
    """Rows (by, n, op) of reduced pairs: the deletes that act on older runs, then what is left."""
    rows = F.array(F.struct((F.col("total") - F.col("low")).alias("n"), F.lit("I").alias("op")), F.struct((-F.col("low")).alias("n"), F.lit("D").alias("op")))
    return ends.select(*by, F.inline(rows)).where("n > 0").select(*by, F.col("n").cast("long").alias("n"), "op")


def flush_runs(arrived: DataFrame, cancel: bool = True) -> DataFrame:
    """(flush, key, value, n, op): what each flush writes.

    ``cancel``: inserts and deletes of one pair within a flush take each other away by the
    order of the log; deletes without a copy to take stay as tombstones for older flushes.
    """
    if not cancel:
        return arrived.groupBy("flush", *PAIR, "op").agg(F.count(F.lit(1)).alias("n")).select("flush", *PAIR, "n", "op")
    ends = reduced(arrived.withColumn("n", F.lit(1).cast("long")), ["flush", *PAIR])
    return _both(ends, "flush", *PAIR)


def merge_runs(runs: DataFrame, group: str, last: bool = False) -> DataFrame:
    """Runs (flush, key, value, n, op) merged within each ``group`` column value, older flushes first.

    A flush's deletes act on older flushes, before its inserts.  ``last``: unmatched deletes go.
    """
    each = runs.groupBy(group, "flush", *PAIR).agg(F.sum(F.when(F.col("op") == "I", F.col("n")).otherwise(0)).alias("ins"), F.sum(F.when(F.col("op") == "D", F.col("n")).otherwise(0)).alias("del"))
    # The balance after a flush is S; its lowest point lies after its deletes. A window has a row for each flush.
    w = W.partitionBy(group, *PAIR).orderBy("flush")
    s = F.sum(F.col("ins") - F.col("del")).over(w.rowsBetween(W.unboundedPreceding, 0))
    ends = each.withColumn("low", s - F.col("ins")).groupBy(group, *PAIR).agg(F.sum(F.col("ins") - F.col("del")).alias("total"), F.least(F.lit(0), F.min("low")).alias("low"))
    both = _both(ends, group, *PAIR)
    return both.where("op = 'I'") if last else both


def flatten(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """(pos, key, value): all live records in order, with their ordinals."""
    from . import index as ix

    return ix.build(live_counts(log), partitions, weight="n").positions


def sample_ranges(runs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, flush, low, high, cnt): the interval of each run that a query's range covers, and its records.

    ``low`` and ``high`` are positions in the run, high excluded.  Runs are summed by key, one index over
    (flush, key) holds them all, and a query's two ends are looked up in each run.
    """
    from . import index as ix

    place = lambda flush, key: F.struct(flush.alias("flush"), key.cast("long").alias("key"))
    sums = runs.groupBy("flush", "key").agg(F.sum("n").alias("w"))
    index = ix.build(sums.select(place(F.col("flush"), F.col("key")).alias("key"), F.lit(0).cast("long").alias("value"), "w"), weight="w")
    flushes = sorted(r["flush"] for r in runs.select("flush").distinct().collect())  # a row for each run
    each = queries.select("qid", "lo", F.try_add(F.col("hi"), F.lit(1).cast("long")).alias("after"), F.explode(F.array(*[F.lit(f).cast("long") for f in flushes])).alias("flush"))
    no_key = F.lit(None).cast("long")
    after = F.when(F.col("after").isNull(), place(F.col("flush") + 1, no_key)).otherwise(place(F.col("flush"), F.col("after")))
    ends = F.array(place(F.col("flush"), no_key), place(F.col("flush"), F.col("lo")), after)
    probes = each.select("qid", "flush", F.posexplode(ends).alias("end", "x")).select(F.struct("qid", "flush", "end").alias("probe"), "x")
    below = index.count_below(probes).groupBy(F.col("probe.qid").alias("qid"), F.col("probe.flush").alias("flush"))
    at = below.agg(*[F.max(F.when(F.col("probe.end") == e, F.col("below"))).alias(name) for e, name in enumerate(("base", "first", "stop"))])
    met = at.select("qid", "flush", (F.col("first") - F.col("base")).alias("low"), (F.col("stop") - F.col("base")).alias("high"), (F.col("stop") - F.col("first")).alias("cnt"))
    return met.where("cnt > 0")


def run_weights(ranges: DataFrame) -> DataFrame:
    """(qid, flush, cnt, total): a run's weight in a query's draws is cnt / total."""
    total = ranges.groupBy("qid").agg(F.sum("cnt").cast("long").alias("total"))
    return ranges.join(total, "qid").select("qid", "flush", "cnt", "total")


def level_stats(levelled: DataFrame) -> DataFrame:
    """(level, runs, records, tombstones, per_million) of rows (level, run, n, op)."""
    g = levelled.groupBy("level").agg(F.count_distinct("run").alias("runs"), F.sum("n").cast("long").alias("records"), F.coalesce(F.sum(F.when(F.col("op") == "D", F.col("n"))), F.lit(0)).cast("long").alias("tombstones"))
    return g.select(F.col("level").cast("long").alias("level"), "runs", "records", "tombstones", F.expr("tombstones * 1000000 div records").alias("per_million"))
