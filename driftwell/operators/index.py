"""The position index: every record's ordinal in (key, value) order, and lookups in it.

Records are range-partitioned by key and value, so a key that fills the table
spreads over several partitions, and sorted within them; each partition is a
folder.  A record's ordinal is its row in the partition plus the records of the
partitions before.  With weights, a record stands for as many ordinals as it
weighs.  Beside the records stand counts and bounds by page of ``PAGE`` records,
a table, and by partition, which the driver holds too: a row for each partition,
as many as the cluster deals with anyway.

A small batch of probes is placed among the partitions by the driver and read
from the pages that it falls into, whose places are part of the scan's filters,
so a lookup opens the touched folders alone.  Large batches are joined instead.
Keys may be structs, which are ordered by their fields.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import partitions_for, written

PAGE = 1024
#: Records in a partition, about.
ROWS = 8_000_000
#: Probes or queries (a few numbers each) of a batch that the driver places; larger ones are joined.
SMALL_BATCH = 20_000
#: Probes (a few numbers each) that are sent to the records at most.
BROADCAST_PROBES = 1_000_000
#: Intervals of rows that a scan's filter names at most; nearer ones are joined beyond that.
INTERVALS = 16
#: Copies of a weighted record that one array makes.
COPIES = 1 << 16


def _plain(key):
    """A key as Python compares it: structs as tuples, nulls below all."""
    if key is None:
        return float("-inf")
    return tuple(map(_plain, key)) if isinstance(key, tuple) else key


@dataclass(frozen=True)
class Part:
    part: int
    cnt: int
    weight: int
    start: int
    least: object
    most: object


@dataclass(frozen=True)
class PositionIndex:
    """``rows`` (key, value, weight, row, page, part); ``pages`` (part, page, page_start, page_weight, min_key,
    max_key); ``held``, the partitions in order. ``start`` counts weights before."""

    rows: DataFrame
    pages: DataFrame
    held: tuple[Part, ...] = field(repr=False)
    key_type: T.DataType = field(default_factory=T.LongType)
    weighted: bool = False

    @property
    def spark(self):
        return self.rows.sparkSession

    @cached_property
    def parts(self) -> DataFrame:
        """(part, cnt, weight, start, min_key, max_key), a row for each partition."""
        schema = T.StructType([T.StructField("part", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("cnt", "weight", "start")], *[T.StructField(c, self.key_type) for c in ("min_key", "max_key")]])
        return self.spark.createDataFrame([(p.part, p.cnt, p.weight, p.start, p.least, p.most) for p in self.held], schema)

    @property
    def positions(self) -> DataFrame:
        """(pos, key, value) for all records of an index without weights; with weights, each record as often as it weighs."""
        if self.weighted:
            upto = F.sum("weight").over(W.partitionBy("part", "page").orderBy("row").rowsBetween(W.unboundedPreceding, -1))
            first = self.rows.withColumn("before", F.coalesce(upto, F.lit(0))).join(self.pages.select("part", "page", "page_start"), ["part", "page"]).join(F.broadcast(self.parts.select("part", "start")), "part")
            first = first.withColumn("first", F.col("start") + F.col("page_start") + F.col("before")).withColumn("stop", F.col("first") + F.col("weight"))
            blocks = first.select("key", "value", "stop", F.explode(F.expr(f"sequence(first, stop - 1, {COPIES})")).alias("at"))
            return blocks.select(F.explode(F.sequence(F.col("at"), F.least(F.col("at") + COPIES, F.col("stop")) - 1)).alias("pos"), "key", "value")
        starts = self.parts.select("part", "start")
        return self.rows.join(F.broadcast(starts), "part").select((F.col("start") + F.col("row")).alias("pos"), "key", "value")

    @property
    def size(self) -> int:
        """Ordinals in all: records, or their weights."""
        return self.held[-1].start + self.held[-1].weight if self.held else 0

    def total(self) -> DataFrame:
        return self.spark.createDataFrame([(self.size,)], "total long")

    # -- counting

    def count_below(self, probes: DataFrame) -> DataFrame:
        """``probes`` (probe, x) with ``below``: the weight of records of key < x, one for each without weights. A null x is above all keys."""
        few = probes.select("probe", "x").limit(SMALL_BATCH + 1).collect()
        if len(few) > SMALL_BATCH:
            return self._joined_below(probes)
        rows = [(probe, x, n) for (probe, x), n in zip(few, self.below([x for _, x in few]), strict=True)]
        return self.spark.createDataFrame(rows, T.StructType([*probes.select("probe", "x").schema.fields, T.StructField("below", T.LongType())]))

    def below(self, keys: list) -> list[int]:
        """The weight below each key: one job over the pages that the keys fall into."""
        return below_each([self], self, keys)[0]

    def _aim(self, x) -> tuple[int, Part | None]:
        """The weight of the partitions below a key, and the partition that it falls into."""
        at = len(self._most) if x is None else bisect.bisect_left(self._most, _plain(x))
        part = self.held[at] if at < len(self.held) else None
        return self.size if part is None else part.start, part if part is not None and _plain(part.least) < _plain(x) else None

    @cached_property
    def _most(self) -> list:
        return [_plain(p.most) for p in self.held]

    def _inside(self, asked: list[tuple[int, int, object]]) -> dict[int, int]:
        """The weight below each key (number, part, key) within its partition."""
        if not asked:
            return {}
        schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("x", self.key_type)])
        probes = F.broadcast(self.spark.createDataFrame(asked, schema))
        named = F.col("part").isin(sorted({p for _, p, _ in asked}))
        pages = self.pages.where(named).join(probes, "part").where("max_key >= x").groupBy("i", "part", "x").agg(F.min(F.struct("page", "page_start")).alias("at"))
        pages = F.broadcast(pages.select("i", "part", "x", F.col("at.page").alias("page"), "at.page_start"))
        found = self.rows.where(named).join(pages, ["part", "page"]).groupBy("i", "page_start").agg(F.sum(F.when(F.col("key") < F.col("x"), F.col("weight")).otherwise(0)).alias("n"))
        return {r["i"]: r["page_start"] + r["n"] for r in found.collect()}

    def _joined_below(self, probes: DataFrame) -> DataFrame:
        """``count_below`` by joins on equal numbers: a probe's partition, then its page, then its record."""
        few = F.broadcast if probes.limit(BROADCAST_PROBES + 1).count() <= BROADCAST_PROBES else lambda df: df
        parts = F.broadcast(self.parts.select("part", "start", F.col("max_key").alias("part_max")))  # a row for each partition
        at = probes.join(parts, F.col("part_max") >= F.col("x")).groupBy("probe", "x").agg(F.min(F.struct("part", "start")).alias("at")).select("probe", "x", "at.part", "at.start")
        page = few(at).join(self.pages, "part").where("max_key >= x").groupBy("probe", "x", "part", "start").agg(F.min(F.struct("page", "page_start")).alias("at"))
        page = page.select("probe", "x", "part", "start", F.col("at.page").alias("page"), "at.page_start")
        row = few(page).join(self.rows, ["part", "page"]).groupBy("probe", "start", "page_start").agg(F.sum(F.when(F.col("key") < F.col("x"), F.col("weight")).otherwise(0)).alias("n"))
        found = row.select("probe", (F.col("start") + F.col("page_start") + F.col("n")).alias("hit"))
        return probes.join(found, "probe", "left").select("probe", "x", F.coalesce("hit", F.lit(self.size)).cast("long").alias("below"))

    def bounds(self, queries: DataFrame) -> DataFrame:
        """``queries`` (qid, lo, hi, ...) with ``first`` (ordinal of the first record in range) and ``n`` (ordinals in range)."""
        return self.placed(queries)[0]

    def placed(self, queries: DataFrame) -> tuple[DataFrame, list[dict] | None]:
        """``bounds``, as rows on the driver too for a small batch."""
        after = F.try_add(F.col("hi"), F.lit(1).cast("long"))
        few = queries.withColumn("__after", after).limit(SMALL_BATCH // 2 + 1).collect()
        if len(few) <= SMALL_BATCH // 2:
            below = self.below([r["lo"] for r in few] + [r["__after"] for r in few])
            rows = [(*r[:-1], first, max(0, stop - first)) for r, first, stop in zip(few, below, below[len(few) :], strict=False)]
            schema = T.StructType([*queries.schema.fields, T.StructField("first", T.LongType()), T.StructField("n", T.LongType())])
            return self.spark.createDataFrame(rows, schema), [dict(zip(schema.names, r, strict=True)) for r in rows]
        probes = queries.select(F.struct("qid", F.lit(0).alias("end")).alias("probe"), F.col("lo").alias("x")).unionByName(queries.select(F.struct("qid", F.lit(1).alias("end")).alias("probe"), after.alias("x")))
        ends = self._joined_below(probes).groupBy(F.col("probe.qid").alias("qid")).agg(F.max(F.when(F.col("probe.end") == 0, F.col("below"))).alias("first"), F.max(F.when(F.col("probe.end") == 1, F.col("below"))).alias("stop"))
        return queries.join(ends, "qid").withColumn("n", F.greatest(F.col("stop") - F.col("first"), F.lit(0)).cast("long")).drop("stop"), None

    # -- records by ordinal

    def located(self, drawn: DataFrame) -> DataFrame:
        """``drawn`` (pos, ...) with ``part`` and ``at``, the ordinal within the partition.

        A grid of as many cells as there are partitions stands for their bounds, so an ordinal
        meets the few partitions of its cell.
        """
        cell = max(1, -(-self.size // max(1, len(self.held))))
        grid = [(g, p.part, p.start, p.start + p.weight) for p in self.held if p.weight for g in range(p.start // cell, (p.start + p.weight - 1) // cell + 1)]
        cells = F.broadcast(self.spark.createDataFrame(grid, "cell long, part int, __start long, __stop long"))
        met = drawn.withColumn("cell", F.expr(f"pos div {cell}")).join(cells, "cell").where("pos >= __start and pos < __stop")
        return met.withColumn("at", F.col("pos") - F.col("__start")).drop("cell", "__start", "__stop")

    def touched(self, spans: list[tuple[int, int]]) -> DataFrame:
        """``rows`` with a filter that keeps those whose ordinals lie in the spans [first, stop), and some others near them."""
        merged: list[list[int]] = []
        for a, z in sorted(s for s in spans if s[0] < s[1]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(z, merged[-1][1])
            else:
                merged.append([a, z])
        if len(merged) > INTERVALS:
            gaps = sorted(merged[i + 1][0] - merged[i][1] for i in range(len(merged) - 1))
            widest, joined = gaps[-(INTERVALS - 1)], [merged[0]]
            for a, z in merged[1:]:
                if a - joined[-1][1] < widest:
                    joined[-1][1] = z
                else:
                    joined.append([a, z])
            merged = joined
        if not merged:
            return self.rows.where(F.lit(False))
        if 2 * sum(z - a for a, z in merged) >= self.size:
            return self.rows
        starts = [p.start for p in self.held]
        keep, parts = [], set()
        for a, z in merged:
            for p in self.held[max(0, bisect.bisect_right(starts, a) - 1) : bisect.bisect_left(starts, z)]:
                parts.add(p.part)
                whole = self.weighted or (a <= p.start and z >= p.start + p.weight)
                keep.append(f"part = {p.part}" if whole else f"part = {p.part} and row >= {max(0, a - p.start)} and row < {z - p.start}")
        near = self.rows.where(F.col("part").isin(sorted(parts)))
        return near if len(keep) > 2 * INTERVALS else near.where(" or ".join(f"({x})" for x in keep))


def below_each(indexes: list[PositionIndex], whole: PositionIndex, keys: list) -> list[list[int]]:
    """The weight below each key in each of the indexes that ``whole`` chains, in one job."""
    out, asked, offset = [], [], 0
    for index in indexes:
        aims = [index._aim(x) for x in keys]
        asked += [(len(out) * len(keys) + i, p.part + offset, x) for i, (x, (_, p)) in enumerate(zip(keys, aims, strict=True)) if p is not None]
        out.append([n for n, _ in aims])
        offset += index.held[-1].part + 1 if index.held else 0
    for i, n in whole._inside(asked).items():
        out[i // len(keys)][i % len(keys)] += n
    return out


def chained(indexes: list[PositionIndex]) -> PositionIndex:
    """The indexes one after the other as one: its ordinals are theirs plus the sizes of those before."""
    rows = pages = None
    held, offset, start = [], 0, 0
    for x in indexes:
        moved = [df.withColumn("part", F.col("part") + F.lit(offset)) for df in (x.rows, x.pages)]
        rows, pages = (moved[0], moved[1]) if rows is None else (rows.unionByName(moved[0]), pages.unionByName(moved[1]))
        held += [Part(p.part + offset, p.cnt, p.weight, p.start + start, p.least, p.most) for p in x.held]
        offset, start = offset + (x.held[-1].part + 1 if x.held else 0), start + x.size
    return PositionIndex(rows, pages, tuple(held), indexes[0].key_type, any(x.weighted for x in indexes))


def build(records: DataFrame, partitions: int | None = None, weight: Column | str | None = None) -> PositionIndex:
    """The index of ``records`` (key, value); ``weight``: whole numbers, of which those above 0 count."""
    weigh = F.lit(1) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    source = records.select("key", "value", weigh.cast("long").alias("weight"))
    if weight is not None:
        source = source.where("weight > 0")
    partitions = partitions or partitions_for(source.sparkSession, source.count(), ROWS)
    placed = source.repartitionByRange(partitions, "key", "value").withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "key", "value")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = written(placed.withColumn("row", row).withColumn("page", (F.col("row") / PAGE).cast("int")).select("key", "value", "weight", "row", "page", "part"), "positions", "part")
    per_page = rows.groupBy("part", "page").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("cnt"), F.sum("weight").alias("page_weight"))
    before = F.coalesce(F.sum("page_weight").over(W.partitionBy("part").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    pages = written(per_page.withColumn("page_start", before), "pages")
    by_part = pages.groupBy("part").agg(F.sum("cnt").alias("cnt"), F.sum("page_weight").alias("weight"), F.min("min_key").alias("least"), F.max("max_key").alias("most"))
    held, start = [], 0
    for r in sorted(by_part.collect(), key=lambda r: r["part"]):
        held.append(Part(r["part"], r["cnt"], r["weight"], start, r["least"], r["most"]))
        start += r["weight"]
    weighted = any(p.cnt != p.weight for p in held)
    return PositionIndex(rows, pages.select("part", "page", "page_start", "page_weight", "min_key", "max_key"), tuple(held), source.schema["key"].dataType, weighted)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``ordinal``, from 0 in the order of the columns ``order``; rows that tie are in some order.

    Range partitions and their counts give the ordinals; no task sorts all rows.
    """
    partitions = partitions_for(df.sparkSession, df.count(), ROWS)
    placed = df.repartitionByRange(partitions, *order).withColumn("__part", F.spark_partition_id()).sortWithinPartitions("__part", *order)
    rows = written(placed.withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    starts, start = [], 0
    for part, n in sorted(rows.groupBy("__part").count().collect()):  # a row for each partition
        starts.append((part, start))
        start += n
    begins = F.broadcast(df.sparkSession.createDataFrame(starts, "__part int, __start long"))
    return rows.join(begins, "__part").withColumn("ordinal", F.col("__start") + F.col("__row")).select(*df.columns, "ordinal")


def sent(df: DataFrame, limit: int = BROADCAST_PROBES) -> DataFrame:
    """``df`` marked for broadcast if it has ``limit`` rows at most."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def bucket_index(records: DataFrame, width: int) -> DataFrame:
    """(bucket, cnt, max_key, start) by key buckets of fixed width; ``start`` counts the records before.

    The running sum is over buckets, not records.
    """
    buckets = records.groupBy(F.floor(F.col("key") / width).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"), F.max("key").alias("max_key"))
    start = F.coalesce(F.sum("cnt").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return buckets.select("bucket", "cnt", "max_key", start.alias("start"))


def page_range(index: PositionIndex, first: int, last: int) -> DataFrame:
    """(part, page, pos, key, value): the records of the pages first..last, counted over the whole index; a scan of those pages alone."""
    per_part = [-(-p.cnt // PAGE) for p in index.held]
    keep, at, parts = None, 0, []
    for p, n in zip(index.held, per_part, strict=True):
        a, z = max(first - at, 0), min(last - at, n - 1)
        if a <= z:
            parts.append((p.part, p.start, at))
            here = (F.col("part") == p.part) & (F.col("page") >= a) & (F.col("page") <= z)
            keep = here if keep is None else keep | here
        at += n
    if keep is None:
        keep, parts = F.lit(False), [(0, 0, 0)]
    starts = index.spark.createDataFrame(parts, "part int, __start long, __pages long")
    rows = index.rows.where(F.col("part").isin([p for p, _, _ in parts])).where(keep).join(F.broadcast(starts), "part")
    return rows.select((F.col("page") + F.col("__pages")).cast("long").alias("page"), (F.col("row") + F.col("__start")).alias("pos"), "key", "value")


def at_positions(index: PositionIndex, asked: DataFrame) -> DataFrame:
    """(pos, key, value) of the ordinals in ``asked`` (pos): a positional read of the partitions that they fall into."""
    found = index.located(asked.select("pos").where(F.col("pos").between(0, index.size - 1)))
    return index.rows.join(found.select("pos", "part", F.col("at").alias("row")), ["part", "row"]).select("pos", "key", "value")


def in_range(key: Column | str = "key") -> Column:
    """The range predicate, inclusive at both ends."""
    key = F.col(key) if isinstance(key, str) else key
    return key.between(F.col("lo"), F.col("hi"))
