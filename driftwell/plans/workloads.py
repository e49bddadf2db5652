"""Workloads that run against an engine and measure it: loads, deletes, samples, mixes, and sweeps of configurations.

Records are (n, key, value) with n from 0 without gaps, so any part of a load is a range of n.
Every choice is a hash of a seed; only the seconds differ from run to run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import hashed
from ..schema import queries
from ..sources import generators
from .engine import Engine

PERCENTILES = (25, 50, 75, 99)


def _timed(job: Callable[[], object]) -> float:
    began = time.perf_counter()
    job()
    return time.perf_counter() - began


def _done(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def blocks(first: int, stop: int, size: int) -> Iterator[tuple[int, int]]:
    for a in range(first, stop, size):
        yield a, min(stop, a + size)


def load(engine: Engine, records: DataFrame, first: int, stop: int, batch: int, delete_percent: int = 0, seed: int = 0) -> list[float]:
    """Takes records first..stop-1 in batches, with deletes of records that came before; seconds of each batch."""
    log = generators.workload(records, delete_percent, seed)
    n = F.expr("seq div 2")
    return [_timed(lambda a=a, z=z: engine.apply(log.where((n >= a) & (n < z)).withColumn("seq", F.col("seq") - 2 * a))) for a, z in blocks(first, stop, batch)]


def _all_keys(engine: Engine, k: int) -> DataFrame:
    return queries(engine.spark, [(0, -(1 << 63), (1 << 63) - 1, k)])


def warm_up(engine: Engine, records: DataFrame, count: int, batch: int, delete_percent: int, seed: int = 0) -> int:
    """Takes the first ``count`` records; from the second batch on deletes records sampled from what is live.

    A batch samples ``delete_percent`` of its size and deletes each record drawn once; returns how many went.
    """
    gone = 0
    for a, z in blocks(0, count, batch):
        if a:
            drawn = (hashed(seed, "del", F.col("id")) % 100 < delete_percent).cast("long")
            k = engine.spark.range(a, z).agg(F.sum(drawn)).first()[0]
            victims = engine.sample_by_runs(_all_keys(engine, k), seed + a).select("key", "value").distinct()
            gone += victims.count() if k else 0
            if k:
                engine.delete(victims)
        engine.append(records.where((F.col("n") >= a) & (F.col("n") < z)))
    return gone


def deletes(engine: Engine, k: int, seed: int = 0) -> tuple[int, float]:
    """Deletes the distinct records among ``k`` drawn from what is live: (how many, seconds for one)."""
    victims = engine.sample_by_runs(_all_keys(engine, k), seed).select("key", "value").distinct().cache()
    n = victims.count()
    seconds = _timed(lambda: engine.delete(victims))
    victims.unpersist()
    return n, seconds / max(1, n)


def samples(engine: Engine, asked: DataFrame, seed: int = 0, by_runs: bool = False) -> tuple[int, float]:
    """(draws, seconds) of a batch of queries, through the index of what is live or through the runs."""
    n = asked.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    return n, _timed(lambda: _done(engine.sample_by_runs(asked, seed) if by_runs else engine.range_sample(asked, seed)))


def mixed(engine: Engine, records: DataFrame, n: int, batch: int, write_percent: int, delete_percent: int, asked: DataFrame, seed: int = 0) -> list[dict]:
    """Runs ``n`` operations in batches: writes take the next records, deletes take sampled ones, reads sample ``asked``.

    One row for each batch: its counts, the records live after it, and its seconds.
    """
    ops = generators.mixed(engine.spark, n, write_percent, delete_percent, seed)
    taken, out = 0, []
    for a, z in blocks(0, n, batch):
        counts = {r["op"]: r["count"] for r in ops.where((F.col("i") >= a) & (F.col("i") < z)).groupBy("op").count().collect()}
        writes, dead, reads = (counts.get(x, 0) for x in ("write", "delete", "read"))
        began, gone = time.perf_counter(), 0
        if writes:
            engine.append(records.where((F.col("n") >= taken) & (F.col("n") < taken + writes)))
            taken += writes
        if dead and taken:
            gone = deletes(engine, dead, seed + a)[0]
        if reads:
            _done(engine.sample_by_runs(asked.withColumn("k", F.least("k", F.lit(reads).cast("long"))), seed + a))
        spent = time.perf_counter() - began
        live = engine.live_counts().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        out.append({"first": a, "writes": writes, "deleted": gone, "reads": reads, "live": live, "seconds": spent})
    return out


def sweep(spark: SparkSession, records: DataFrame, count: int, batch: int, asked: DataFrame, caps: Iterable[int], scales: Iterable[int], bounds: Iterable[float], policies: Iterable[str] = ("tiering", "levelling"), delete_percent: int = 5, seed: int = 0) -> DataFrame:
    """One row for each configuration: load throughput and latencies, sampling, deletes, levels and bytes.

    A tenth of the records warms the engine up, the rest is timed in batches.
    """
    rows = []
    for cap, scale, bound, policy in product(caps, scales, bounds, policies):
        engine = Engine(spark, cap=cap, scale=scale, policy=policy, max_tombstones=bound)
        warm = max(batch, count // 10)
        load(engine, records, 0, warm, warm, delete_percent, seed)
        spent = load(engine, records, warm, count, batch, delete_percent, seed)
        drawn, seconds = samples(engine, asked, seed)
        gone, each = deletes(engine, 100, seed)
        at = [float(x) for x in np.percentile(spent, PERCENTILES)]
        rows.append((cap, scale, float(bound), policy, (count - warm) / sum(spent), *at, drawn / seconds, gone, each, engine.plan.height, engine.bytes()))
    names = ", ".join(f"insert_p{p} double" for p in PERCENTILES)
    return spark.createDataFrame(rows, f"cap long, scale long, max_tombstones double, policy string, inserts_per_sec double, {names}, samples_per_sec double, deleted long, delete_sec double, height long, bytes long")


def picked(results: DataFrame, *by: str | Column, **config: object) -> DataFrame:
    """Results of the configurations that match ``config``, in the order of the columns ``by``."""
    for name, value in config.items():
        results = results.where(F.col(name) == F.lit(value))
    return results.orderBy(*by) if by else results


