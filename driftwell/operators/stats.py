"""Percentiles, histograms and order checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import index as ix


def percentiles(df: DataFrame, value: Column | str, at: list[float]) -> DataFrame:
    """One row: least, the exact percentiles (linear between ranks) as p0, p1, ..., most; nulls are passed over.

    Ranks are read from a position index, so no task holds the values.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    index = ix.build(df.select(v.alias("key"), F.lit(0).cast("long").alias("value")).where("key is not null"))
    n = index.size
    if not n:
        return df.sparkSession.createDataFrame([(None,) * (len(at) + 2)], ", ".join(f"{c} double" for c in ["least", *[f"p{i}" for i in range(len(at))], "most"]))
    ranks = [0.0, *[q * (n - 1) for q in at], float(n - 1)]
    asked = sorted({x for r in ranks for x in (int(r), min(int(r) + 1, n - 1))})
    rows = {r["pos"]: r["key"] for r in ix.at_positions(index, df.sparkSession.createDataFrame([(x,) for x in asked], "pos long")).collect()}
    values = [rows[int(r)] + (r - int(r)) * (rows[min(int(r) + 1, n - 1)] - rows[int(r)]) for r in ranks]
    return df.sparkSession.createDataFrame([tuple(values)], ", ".join(f"{c} double" for c in ["least", *[f"p{i}" for i in range(len(at))], "most"]))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, lo, hi, cnt) of whole numbers in equal widths w = (max - min) div bins, of at least 1.

    Bin b holds (min + (b-1) w, min + b w]; the first also holds the least value; what lies
    above the last bound is in further bins.  Empty bins have 0.  A width of 0 raises.
    """
    ends = df.agg(F.min(value).alias("a"), F.max(value).alias("z"))
    ends = ends.select("a", "z", F.expr(f"(z - a) div {bins}").alias("w")).withColumn("w", F.when(F.col("w") == 0, F.raise_error(F.lit("bins of width 0"))).otherwise(F.col("w")).cast("long"))
    place = lambda v: F.greatest(F.lit(1).cast("long"), F.expr(f"cast(({v} - a + w - 1) div w as bigint)"))
    counted = df.select(F.col(value).alias("v")).crossJoin(F.broadcast(ends)).groupBy(place("v").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    all_bins = ends.select("a", "w", F.explode(F.sequence(F.lit(1).cast("long"), place("z"))).alias("bin"))
    return all_bins.join(counted, "bin", "left").select("bin", (F.col("a") + (F.col("bin") - 1) * F.col("w")).alias("lo"), (F.col("a") + F.col("bin") * F.col("w")).alias("hi"), F.coalesce("cnt", F.lit(0)).alias("cnt"))


def disorder(positions: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """One row (n, breaks): records that are less than the one before in (key, value) order.

    Chunks of ordinals are checked each by itself and then against the next one's first record.
    """
    part = positions.withColumn("chunk", F.expr(f"pos div {chunk}"))
    w = W.partitionBy("chunk").orderBy("pos")
    here = F.struct("key", "value")
    inner = part.select("chunk", "pos", here.alias("r"), F.lag(here).over(w).alias("before"))
    ends = inner.groupBy("chunk").agg(F.min_by("r", "pos").alias("first"), F.max_by("r", "pos").alias("last"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") < F.col("before")).alias("breaks"))
    joined = ends.withColumn("late", F.coalesce((F.col("first") < F.lag("last").over(W.orderBy("chunk"))).cast("long"), F.lit(0)))
    return joined.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(F.col("breaks") + F.col("late")), F.lit(0)).cast("long").alias("breaks"))


def ends(records: DataFrame, n: int, forward: bool = True) -> DataFrame:
    """The first or last ``n`` records in order: an ordered scan that stops."""
    order = [F.col("key"), F.col("value")] if forward else [F.col("key").desc(), F.col("value").desc()]
    return records.orderBy(*order).limit(n)
