"""A learned index: linear splines from keys to ordinals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import index as ix
from .index import PositionIndex


def first_positions(index: PositionIndex) -> DataFrame:
    """(key, pos, part): the first ordinal of every key."""
    rows = index.rows.groupBy("key").agg(F.min(F.struct("part", "row")).alias("at"))
    return rows.select("key", F.col("at.part").alias("part"), F.col("at.row").alias("row")).join(F.broadcast(index.parts.select("part", "start")), "part").select("key", (F.col("start") + F.col("row")).alias("pos"), "part")


def fixed_knots(index: PositionIndex, step: int) -> DataFrame:
    """(x, y): every ``step``-th record by ordinal and the last, with the first ordinal of its key."""
    firsts = first_positions(index).select("key", "pos")
    last = firsts.agg(F.max("key").alias("last"))
    picked = index.positions.where(F.col("pos") % step == 0).select("key").distinct()
    keys = picked.unionByName(last.where("last is not null").withColumnRenamed("last", "key")).distinct()
    return firsts.join(keys, "key", "left_semi").select(F.col("key").alias("x"), F.col("pos").alias("y"))


def corridor(keys: np.ndarray, positions: np.ndarray, max_error: int) -> list[int]:
    """Indexes of the knots of a greedy spline corridor over ascending distinct keys."""
    n = len(keys)
    if n <= 2:
        return list(range(n))
    knots, base = [0], 0
    low, high = -np.inf, np.inf
    for i in range(1, n):
        dx = float(keys[i]) - float(keys[base])
        slope = (positions[i] - positions[base]) / dx
        if slope < low or slope > high:
            knots.append(i - 1)
            base = i - 1
            dx = float(keys[i]) - float(keys[base])
            low, high = -np.inf, np.inf
        low = max(low, (positions[i] - max_error - positions[base]) / dx)
        high = min(high, (positions[i] + max_error - positions[base]) / dx)
    knots.append(n - 1)
    return knots


def greedy_knots(index: PositionIndex, max_error: int) -> DataFrame:
    """(x, y) of greedy corridors, one for each range partition; their ends are knots."""

    def by_part(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key")
        at = corridor(part["key"].to_numpy(), part["pos"].to_numpy(), max_error)
        return pd.DataFrame({"x": part["key"].to_numpy()[at], "y": part["pos"].to_numpy()[at]})

    return first_positions(index).groupBy("part").applyInPandas(by_part, "x long, y long")


def estimate(knots: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, x, estimate): the spline at x in whole numbers, rounded down; x is clamped to the knots.

    The knots have a position index of their own, so a probe's segment is the knot at its ordinal and the next one.
    """
    index = ix.build(knots.select(F.col("x").alias("key"), F.col("y").alias("value")))
    if not index.size:
        return probes.select("probe", "x", F.lit(None).cast("long").alias("estimate")).limit(0)
    a, z = index.held[0].least, index.held[-1].most
    clamped = probes.select("probe", "x", F.least(F.greatest("x", F.lit(a)), F.lit(z)).alias("c"))
    upto = index.count_below(clamped.select("probe", F.try_add(F.col("c"), F.lit(1).cast("long")).alias("x"))).select("probe", (F.col("below") - 1).alias("pos"))
    here = index.positions.select("pos", F.col("key").alias("kx"), F.col("value").alias("ky"))
    after = index.positions.select((F.col("pos") - 1).alias("pos"), F.col("key").alias("nx"), F.col("value").alias("ny"))
    hit = clamped.join(upto, "probe").join(here, "pos").join(after, "pos", "left")
    rise = F.expr("cast((c - kx) as decimal(19,0)) * cast((ny - ky) as decimal(19,0)) div cast((nx - kx) as decimal(19,0))")
    return hit.select("probe", "x", F.when(F.col("nx").isNull(), F.col("ky")).otherwise(F.col("ky") + rise).cast("long").alias("estimate"))


def size_of(knots: DataFrame) -> DataFrame:
    """One row (knots, bytes): what a spline takes, two numbers of eight bytes a knot."""
    return knots.agg(F.count(F.lit(1)).alias("knots")).select("knots", (F.col("knots") * 16).alias("bytes"))


def search_bounds(estimates: DataFrame, total: int, max_error: int) -> DataFrame:
    """``estimates`` with [begin, stop) that holds the first ordinal of a key among ``total`` records."""
    return estimates.withColumn("begin", F.greatest(F.col("estimate") - max_error, F.lit(0))).withColumn("stop", F.least(F.col("estimate") + max_error + 2, F.lit(total)))
