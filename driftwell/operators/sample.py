"""Independent range sampling: k uniform draws with replacement from the records in a range.

A draw is an ordinal: first + H(seed, qid, i) mod n.  Filtering comes first, so no draw
is ever rejected, a range without live records gives no rows, and any other gives
exactly k.  The same seed gives the same rows on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import below
from . import index as ix
from .index import PositionIndex, in_range
from .oplog import live_counts, repeated

#: Draws (three numbers each) that are sent to the records; more are joined by exchange.
BROADCAST_DRAWS = 2_000_000
#: Queries that ``range_sample_by_rank`` sends to the records.
RANKED = 10_000


def draws(bounds: DataFrame, seed: int) -> DataFrame:
    """(qid, i, pos) from queries with ``first``, ``n`` and ``k``."""
    each = bounds.where("k > 0 and n > 0").select("qid", "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"))
    return each.select("qid", "i", (F.col("first") + below(F.col("n"), seed, F.col("qid"), F.col("i"))).alias("pos"))


def range_sample(records: DataFrame | PositionIndex, queries: DataFrame, seed: int = 0) -> DataFrame:
    """(qid, i, key, value): k draws for each query, through the position index.

    Drawn ordinals become rows of partitions; of a small batch the scan reads only partitions and rows
    that its ranges cover.
    """
    index = records if isinstance(records, PositionIndex) else ix.build(records)
    bounds, few = index.placed(queries)
    if not index.size:
        return index.rows.select(F.lit(0).cast("long").alias("qid"), F.lit(0).cast("long").alias("i"), "key", "value").limit(0)
    rows = index.rows if few is None else index.touched([(q["first"], q["first"] + q["n"]) for q in few if q["k"] and q["k"] > 0])
    asked = sum(max(0, q["k"] or 0) for q in few) if few is not None else queries.agg(F.coalesce(F.sum(F.greatest("k", F.lit(0))), F.lit(0))).first()[0]
    located = index.located(draws(bounds, seed))
    if index.weighted:
        return _weighed(index, rows, located, asked)
    located = located.select("qid", "i", "part", F.col("at").alias("row"))
    return rows.join(F.broadcast(located) if asked <= BROADCAST_DRAWS else located, ["part", "row"]).select("qid", "i", "key", "value")


def records_at(index: PositionIndex, drawn: DataFrame, asked: int) -> DataFrame:
    """(qid, i, key, value) of the ordinals ``drawn`` (qid, i, pos), ``asked`` of them."""
    located = index.located(drawn)
    if index.weighted:
        return _weighed(index, index.rows, located, asked)
    located = located.select("qid", "i", "part", F.col("at").alias("row"))
    return index.rows.join(F.broadcast(located) if asked <= BROADCAST_DRAWS else located, ["part", "row"]).select("qid", "i", "key", "value")


def _weighed(index: PositionIndex, rows: DataFrame, located: DataFrame, asked: int) -> DataFrame:
    """The records that hold the ordinals of ``located`` (qid, i, part, at) in an index with weights.

    A grid of as many cells as there are pages, in the average, stands for the bounds of the pages; within
    its page a draw meets running weights of ix.PAGE records at most.
    """
    few = F.broadcast if asked <= BROADCAST_DRAWS else lambda df: df
    n_pages = sum(-(-p.cnt // ix.PAGE) for p in index.held)
    cell = max(1, -(-index.size // n_pages))
    ends = F.sequence(F.expr(f"page_start div {cell}"), F.expr(f"(page_start + page_weight - 1) div {cell}"))
    grid = index.pages.select("part", "page", "page_start", "page_weight", F.explode(ends).alias("cell"))
    paged = few(located.select("qid", "i", "part", "at", F.expr(f"at div {cell}").alias("cell"))).join(grid, ["part", "cell"]).where("at >= page_start and at < page_start + page_weight")
    paged = paged.select("qid", "i", "part", "page", (F.col("at") - F.col("page_start")).alias("inside"))
    met = rows.join(few(paged.select("part", "page").distinct()), ["part", "page"], "left_semi")
    upto = F.sum("weight").over(W.partitionBy("part", "page").orderBy("row").rowsBetween(W.unboundedPreceding, 0))
    placed = met.withColumn("stop", upto).select("part", "page", "key", "value", "stop", (F.col("stop") - F.col("weight")).alias("begin"))
    return placed.join(few(paged), ["part", "page"]).where("inside >= begin and inside < stop").select("qid", "i", "key", "value")


def range_sample_by_rank(records: DataFrame, queries: DataFrame, seed: int = 0) -> DataFrame:
    """The same rows by ranking each query's records.

    For a few queries over ranges that fit a task each; it reads every record for every query.
    """
    hits = records.join(ix.sent(queries, RANKED), in_range()).select("qid", "k", "key", "value")
    ranked = hits.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy("key", "value")).cast("long") - 1)
    sizes = ranked.groupBy("qid", "k").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.lit(0).cast("long"))
    return ranked.drop("k").join(draws(sizes, seed), ["qid", "pos"]).select("qid", "i", "key", "value")


def key_sample(records: DataFrame | PositionIndex, queries: DataFrame, seed: int = 0) -> DataFrame:
    """Draws of keys alone."""
    return range_sample(records, queries, seed).select("qid", "i", "key")


def weighted_sample(records: DataFrame, queries: DataFrame, weight: Column | str, seed: int = 0) -> DataFrame:
    """Draws in proportion to whole-number weights: a record of weight w stands for w ordinals of the index."""
    return range_sample(ix.build(records, weight=weight), queries, seed)


def sample_then_delete(records: DataFrame, queries: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(victims, remaining): the distinct pairs drawn, and the records without one copy of each."""
    victims = range_sample(records, queries, seed).select("key", "value").distinct()
    counts = records.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    left = counts.join(victims.withColumn("hit", F.lit(1).cast("long")), ["key", "value"], "left").select("key", "value", (F.col("n") - F.coalesce("hit", F.lit(0))).alias("n"))
    return victims, repeated(left)


def rejection_stats(log: DataFrame, queries: DataFrame) -> DataFrame:
    """What rejection would meet in each range, exactly: (qid, candidates, tombstones, out_of_range, deleted, acceptable).

    Tombstones are rejected first, then records outside the range, then deleted ones.
    The log is summed by key, and two indexes over the sums count what lies in the ranges.
    """
    inserted = log.where(F.col("op") == "I").groupBy("key").agg(F.count(F.lit(1)).alias("w"))
    living = live_counts(log).groupBy("key").agg(F.sum("n").alias("w"))
    of = lambda sums, name: ix.build(sums.withColumn("value", F.lit(0).cast("long")), weight="w").bounds(queries.select("qid", "lo", "hi")).select("qid", F.col("n").alias(name))
    total = log.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("op") == "I").alias("inserted"), F.count_if(F.col("op") == "D").alias("dead")).first()
    both = of(inserted, "records").join(of(living, "living"), "qid")
    return both.select(
        "qid",
        F.lit(total["candidates"]).cast("long").alias("candidates"),
        F.lit(total["dead"]).cast("long").alias("tombstones"),
        (F.lit(total["inserted"]) - F.col("records")).cast("long").alias("out_of_range"),
        (F.col("records") - F.col("living")).cast("long").alias("deleted"),
        F.col("living").cast("long").alias("acceptable"),
    )
