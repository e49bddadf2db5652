"""Operation logs: what is live after inserts and deletes.

A delete takes away one earlier live copy of exactly its (key, value) and does
nothing if there is none.  The log is ordered by ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import DELETE, INSERT
from .index import PositionIndex

PAIR = ["key", "value"]
#: Times of one pair in a log beyond which its balance is taken in chunks of the log.
CHUNK = 1 << 20


def _sign() -> Column:
    return F.when(F.col("op") == INSERT, 1).otherwise(-1).cast("long")


#: Copies of a row that one array makes.
COPIES = 1 << 16


def repeated(counts: DataFrame) -> DataFrame:
    """Each pair ``n`` times, through arrays of COPIES elements at most."""
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))).alias("block")
    each = counts.where("n > 0").select(*PAIR, "n", blocks)
    size = F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("block") * COPIES)
    return each.select(*PAIR, F.explode(F.sequence(F.lit(1).cast("long"), size))).select(*PAIR)


def reduced(ops: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, low, inserted, first_seq, last_seq) of operations (by, seq, op, n): the balance after all, its lowest point,
    0 at most, and what inserts bring in all.

    With running sums S_t of what inserts add and deletes take and a floor at zero, what is left
    is S_n - min(0, min S_t).  Sums and minima of chunks of the log combine, so a pair that
    fills the log is spread over its chunks and each chunk is small.
    """
    signed = ops.withColumn("__d", F.when(F.col("op") == INSERT, F.col("n")).otherwise(-F.col("n"))).withColumn("__chunk", F.floor(F.col("seq") / CHUNK))
    s = F.sum("__d").over(W.partitionBy(*by, "__chunk").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    chunks = signed.withColumn("__s", s).groupBy(*by, "__chunk").agg(F.sum("__d").alias("total"), F.min("__s").alias("low"), F.sum(F.greatest("__d", F.lit(0))).alias("inserted"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    before = F.coalesce(F.sum("total").over(W.partitionBy(*by).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = chunks.withColumn("low", before + F.col("low")).groupBy(*by)
    return joined.agg(F.sum("total").cast("long").alias("total"), F.least(F.lit(0), F.min("low")).cast("long").alias("low"), F.sum("inserted").cast("long").alias("inserted"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


def live_counts_fast(log: DataFrame) -> DataFrame:
    """(key, value, n) where every delete follows an insert that it can take: a signed sum."""
    return log.groupBy(*PAIR).agg(F.sum(_sign()).alias("n")).where("n > 0")


def live_counts(log: DataFrame) -> DataFrame:
    """(key, value, n) for any log; a log with ``n`` has operations of so many copies."""
    ops = log if "n" in log.columns else log.withColumn("n", F.lit(1).cast("long"))
    return reduced(ops, PAIR).select(*PAIR, (F.col("total") - F.col("low")).alias("n")).where("n > 0")


def live(log: DataFrame, ordered: bool = True) -> DataFrame:
    """Live records (key, value), a row for each copy. ``ordered``: take the order of the log into account."""
    return repeated(live_counts(log) if ordered else live_counts_fast(log))


def live_by_difference(log: DataFrame) -> DataFrame:
    """The multiset difference of inserts and deletes."""
    return log.where(F.col("op") == INSERT).select(*PAIR).exceptAll(log.where(F.col("op") == DELETE).select(*PAIR))


def tombstoned(records: DataFrame, log: DataFrame) -> DataFrame:
    """Records whose exact pair has a tombstone in the log."""
    return records.join(log.where(F.col("op") == DELETE).select(*PAIR).distinct(), PAIR, "left_semi")


def untombstoned(records: DataFrame, log: DataFrame) -> DataFrame:
    return records.join(log.where(F.col("op") == DELETE).select(*PAIR).distinct(), PAIR, "left_anti")


def erase_all(records: DataFrame, keys: DataFrame) -> DataFrame:
    """``records`` without any of the keys."""
    return records.join(keys.select("key").distinct(), "key", "left_anti")


def erase_one(records: DataFrame, keys: DataFrame) -> DataFrame:
    """``records`` less one record, that of the smallest value, for each key of ``keys``."""
    first = records.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("value").alias("value"))
    counts = records.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    hit = first.withColumn("hit", F.lit(1).cast("long"))
    return repeated(counts.join(hit, PAIR, "left").select(*PAIR, (F.col("n") - F.coalesce("hit", F.lit(0))).alias("n")))


def erase_at(index: PositionIndex, positions: DataFrame) -> DataFrame:
    """The records (key, value) of an index without those at the ordinals ``positions`` (pos); others than its own are passed over."""
    return index.positions.join(positions.select("pos").distinct(), "pos", "left_anti").select(*PAIR)


def sequence_order(a: PositionIndex, b: PositionIndex) -> DataFrame:
    """One row (equal, less, less_equal, apart): two sequences in order, compared record by record as words are.

    ``apart``, the first ordinal at which they differ, decides; it is -1 where they are equal.  A sequence
    that ends is less than one that goes on.
    """
    left = a.positions.select("pos", F.struct(*PAIR).alias("a"))
    right = b.positions.select("pos", F.struct(*PAIR).alias("b"))
    apart = left.join(right, "pos", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    first = apart.agg(F.min_by(F.struct("a", "b"), "pos").alias("at"), F.coalesce(F.min("pos"), F.lit(-1)).cast("long").alias("apart"))
    less = F.coalesce(F.col("at.a").isNull() | (F.col("at.a") < F.col("at.b")), F.lit(False)) & F.col("at").isNotNull()
    return first.select(F.col("at").isNull().alias("equal"), less.alias("less"), (F.col("at").isNull() | less).alias("less_equal"), "apart")


def multiset_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b): copies that one side has more of."""
    both = a.select(*PAIR, F.lit(1).cast("long").alias("d")).unionByName(b.select(*PAIR, F.lit(-1).cast("long").alias("d"))).groupBy(*PAIR).agg(F.sum("d").alias("d"))
    return both.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).cast("long").alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).cast("long").alias("only_b"))
