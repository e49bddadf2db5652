"""The engine: batches of operations, flushes, compactions, queries, persistence.

State is a folder of Parquet runs sorted by key, batches that aren't flushed yet, and manifests, a
folder for each version.  Layout (cap, scale, policy) never changes what is live.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import hashed
from ..operators import index as ix
from ..operators import lookup, sample
from ..operators.oplog import PAIR, live_counts, reduced, repeated
from ..schema import DELETE, INSERT, RUN
from ..storage import bytes_of, folders, new_folder, removed, written
from .levels import Plan, Run


class Engine:
    """``append`` and ``delete`` take DataFrames (key, value); queries see everything taken so far.

    Batches wait in a buffer until they hold ``cap`` operations, which are one flush, or
    ``tombstone_cap`` deletes, upon which all of them are flushed.  A flush is written with inserts
    and deletes of equal records cancelled, as counts by record; the plan says which runs are merged
    then.  Merges cancel further and, in the oldest run, drop deletes that meet nothing.
    A later batch's operations come after an earlier one's; ``seq`` orders those of one batch.
    """

    #: Tries that a draw of ``sample_by_runs`` has in each round; what is rejected in all is drawn from what is live.
    TRIES = (4, 16, 64)

    def __init__(self, spark: SparkSession, folder: str | None = None, cap: int = 1_000_000, scale: int = 6, policy: str = "tiering", max_tombstones: float = 1.0, tombstone_cap: int | None = None) -> None:
        self.spark, self.folder = spark, folder or new_folder(spark, "engine")
        self.plan = Plan(cap, scale, policy, max_tombstones)
        self.tombstone_cap = tombstone_cap or cap
        self.files: dict[tuple[int, int], str | None] = {}  # runs by their first and last flush; None: nothing was left of it
        self.buffer: list[str] = []
        self.buffered, self.buffered_tombstones = 0, 0
        self.flushes, self.sequence, self.version = 0, 0, 0
        self.consumed: dict[str, int] = {}  # the last batch taken from each stream
        self._index: ix.PositionIndex | None = None
        self._by_path: dict[str, ix.PositionIndex] = {}

    # -- writes

    def append(self, records: DataFrame) -> None:
        self.apply(records.select("key", "value", F.lit(INSERT).alias("op")))

    def delete(self, records: DataFrame) -> None:
        self.apply(records.select("key", "value", F.lit(DELETE).alias("op")))

    def apply(self, ops: DataFrame) -> None:
        """``ops`` (key, value, op[, seq]): one batch; without seq its operations are in no order and inserts come first."""
        if "seq" not in ops.columns:
            ops = ops.withColumn("seq", F.when(F.col("op") == INSERT, 0).otherwise(1).cast("long"))
        path = f"{self.folder}/batch-{uuid.uuid4().hex}"
        base = F.lit(self.sequence).cast("long")
        ops.select((base + F.col("seq")).alias("seq"), "key", "value", "op", F.lit(1).cast("long").alias("n")).write.parquet(path)
        n, dead, last = self._read([path]).agg(F.count(F.lit(1)), F.count_if(F.col("op") == DELETE), F.max("seq")).first()
        if not n:
            return
        self.sequence = last + 1
        self.buffer.append(path)
        self.buffered, self.buffered_tombstones = self.buffered + n, self.buffered_tombstones + dead
        self._index = None
        if self.buffered_tombstones >= self.tombstone_cap:
            self.flush()
        elif self.buffered >= self.plan.cap:
            self.flush(whole=False)

    def flush(self, whole: bool = True) -> None:
        """Writes the buffer as runs of ``cap`` operations; unless ``whole``, operations that fill none stay in it."""
        cap, first = self.plan.cap, self.flushes
        flushes = -(-self.buffered // cap) if whole else self.buffered // cap
        if not flushes:
            return
        log = self._read(self.buffer)
        if self.buffered <= cap:
            placed = log.withColumn("flush", F.lit(first))
        else:
            placed = ix.numbered(log, "seq", "key", "value").withColumn("flush", F.expr(f"cast({first} + ordinal div {cap} as int)"))
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        made = _rows(reduced(placed.where(F.col("flush") < first + flushes), ["flush", *PAIR]), "flush")
        made.repartitionByRange("flush", *PAIR).sortWithinPartitions("flush", *PAIR).write.partitionBy("flush").parquet(path)
        left, buffer = max(0, self.buffered - flushes * cap), []
        dead = 0
        if left:
            buffer = [f"{self.folder}/batch-{uuid.uuid4().hex}"]
            placed.where(F.col("flush") >= first + flushes).select(*RUN.names).write.parquet(buffer[0])
            dead = self._read(buffer).where(F.col("op") == DELETE).count()
        sizes = self.spark.read.schema(f"{_DDL}, flush int").parquet(path).groupBy("flush").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("op") == DELETE, F.col("n"))), F.lit(0)).alias("dead")).collect()
        sizes = {r["flush"]: r for r in sizes}
        for f in range(first, first + flushes):
            self.files[f, f] = f"{path}/flush={f}" if f in sizes else None
            self.plan.apply(f, sizes[f]["n"] if f in sizes else 0, sizes[f]["dead"] if f in sizes else 0)
        self.flushes += flushes
        self.buffer, self.buffered, self.buffered_tombstones = buffer, left, dead
        self._compact()

    def _compact(self) -> None:
        """Writes the runs that the plan has merged; a run that only changed its level keeps its file."""
        oldest = min((r.first for level in self.plan.levels for r in level), default=0)
        for level in self.plan.levels:
            for r in level:
                if (r.first, r.last) in self.files:
                    continue
                parts = sorted(k for k in self.files if r.first <= k[0] and k[1] <= r.last)
                held, path = [self.files[k] for k in parts if self.files[k]], None
                r.records = r.tombstones = 0
                if held:
                    path = f"{self.folder}/run-{uuid.uuid4().hex}"
                    made = _rows(reduced(self._read(held), PAIR), deletes=r.first != oldest)
                    made.repartitionByRange(*PAIR).sortWithinPartitions(*PAIR).write.parquet(path)
                    got = self._read([path]).agg(F.sum("n"), F.sum(F.when(F.col("op") == DELETE, F.col("n")))).first()
                    r.records, r.tombstones = got[0] or 0, got[1] or 0
                for k in parts:  # only now that what replaces them is written
                    del self.files[k]
                self.files[r.first, r.last] = path

    # -- reads

    def _paths(self) -> list[str]:
        return [p for _, p in sorted(self.files.items()) if p] + self.buffer

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def log(self) -> DataFrame:
        """(seq, key, value, op, n): what the runs and the buffer hold."""
        return self._read(self._paths())

    def live_counts(self) -> DataFrame:
        return live_counts(self.log())

    def live(self) -> DataFrame:
        return repeated(self.live_counts())

    def index(self) -> ix.PositionIndex:
        """The position index of what is live, copies as weights; built once between writes."""
        if self._index is None:
            self._index = ix.build(written(self.live_counts(), "live"), weight="n")
        return self._index

    def range_sample(self, queries: DataFrame, seed: int = 0) -> DataFrame:
        return sample.range_sample(self.index(), queries, seed)

    def range_count(self, queries: DataFrame) -> DataFrame:
        return lookup.range_counts(self.index(), queries)

    def flatten(self) -> DataFrame:
        return self.index().positions

    def run_indexes(self) -> list[ix.PositionIndex]:
        """A position index over the inserts of each run and batch; only those of new ones are built."""
        paths = self._paths()
        self._by_path = {p: self._by_path[p] if p in self._by_path else ix.build(self._read([p]).where(F.col("op") == INSERT), weight="n") for p in paths}
        return [self._by_path[p] for p in paths if self._by_path[p].size]

    def sample_by_runs(self, queries: DataFrame, seed: int = 0) -> DataFrame:
        """(qid, i, key, value): k uniform draws from what is live in each range, without an index of all of it.

        A draw picks a run by what it has in the range, then one of these inserts.  Of a record
        with m inserts in all runs, c of which are live, it is taken with the chance c / m, else the draw is tried
        again.  So a batch costs the index of its own run and lookups of the records drawn.
        Draws rejected in all TRIES, and those of ranges that have nothing live, are settled on what is live there.
        """
        few = queries.select("qid", "lo", "hi", "k").collect()  # a batch of ranges
        few = [q for q in few if (q["k"] or 0) > 0 and q["lo"] is not None and q["hi"] is not None and q["lo"] <= q["hi"]]
        indexes, schema = self.run_indexes(), "qid long, i long, key long, value long"
        if not few or not indexes:
            return self.spark.createDataFrame([], schema)
        whole = ix.chained(indexes)
        below = ix.below_each(indexes, whole, [q["lo"] for q in few] + [q["hi"] + 1 if q["hi"] < (1 << 63) - 1 else None for q in few])
        width, pieces, start = {}, [], 0
        for index, found in zip(indexes, below, strict=True):
            for q, first, stop in zip(few, found, found[len(few) :], strict=False):
                if stop > first:
                    at = width.get(q["qid"], 0)
                    pieces.append((q["qid"], start + first, at, at + stop - first))
                    width[q["qid"]] = at + stop - first
            start += index.size
        asked = [(q["qid"], q["k"], width[q["qid"]]) for q in few if q["qid"] in width]
        if not asked:
            return self.spark.createDataFrame([], schema)
        part = F.broadcast(self.spark.createDataFrame(pieces, "qid long, first long, low long, high long"))
        waiting = self.spark.createDataFrame(asked, "qid long, k long, width long").select("qid", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"))
        met, taken, left = self.log().where(_any_range([(q["lo"], q["hi"]) for q in few])), [], sum(k for _, k, _ in asked)
        for turn, tries in enumerate(self.TRIES):
            each = waiting.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
            u = hashed(seed, "run", F.lit(turn), F.col("qid"), F.col("i"), F.col("j")) % F.col("width")
            drawn = each.withColumn("u", u).join(part, "qid").where("u >= low and u < high").select("qid", (F.col("i") * tries + F.col("j")).alias("i"), (F.col("first") + F.col("u") - F.col("low")).alias("pos"))
            found = written(sample.records_at(whole, drawn, left * tries), "found")
            pairs = found.select(*PAIR).distinct()
            ends = reduced(met.join(F.broadcast(pairs) if left * tries <= ix.BROADCAST_PROBES else pairs, PAIR, "left_semi"), PAIR)
            keep = hashed(seed, "keep", F.lit(turn), F.col("qid"), F.col("i")) % F.col("inserted") < F.col("total") - F.col("low")
            tried = found.join(ends, PAIR).select("qid", F.expr(f"i div {tries}").alias("i"), F.expr(f"i % {tries}").alias("j"), *PAIR, keep.alias("keep"))
            judged = written(tried.groupBy("qid", "i").agg(F.min_by(F.struct(*PAIR), F.when(F.col("keep"), F.col("j"))).alias("at")), "judged")
            taken.append(judged.where("at is not null").select("qid", "i", "at.*"))
            again = judged.where("at is null").select("qid", "i")
            left = again.count()
            if not left:
                break
            waiting = again.join(F.broadcast(self.spark.createDataFrame(list(width.items()), "qid long, width long")), "qid")
        else:
            late = {r["qid"] for r in waiting.select("qid").distinct().collect()}  # among the queries of the batch
            alive = live_counts(met.where(_any_range([(q["lo"], q["hi"]) for q in few if q["qid"] in late])))
            exact = sample.range_sample(ix.build(written(alive, "alive"), weight="n"), queries.where(F.col("qid").isin(sorted(late))), seed)
            taken.append(exact.join(waiting.select("qid", "i"), ["qid", "i"], "left_semi").select("qid", "i", *PAIR))
        out = taken[0]
        for more in taken[1:]:
            out = out.unionByName(more)
        return out

    # -- accounts

    def stats(self) -> DataFrame:
        """(level, run, path, reccnt, tscnt, bytes): the manifest as a table; level -1 is the buffer."""
        rows = [(k, j, self.files[r.first, r.last], r.records, r.tombstones) for k, level in enumerate(self.plan.levels) for j, r in enumerate(level)]
        if self.buffered:
            rows += [(-1, j, p, None, None) for j, p in enumerate(self.buffer)]
        rows = [(*r, bytes_of(self.spark, r[2]) if r[2] else 0) for r in rows]
        return self.spark.createDataFrame(rows, "level int, run int, path string, reccnt long, tscnt long, bytes long")

    def bytes(self) -> int:
        """Bytes of all runs and batches that are in use."""
        return sum(bytes_of(self.spark, p) for p in self._paths())

    def validate_tombstone_proportion(self) -> bool:
        return self.plan.valid()

    # -- persistence

    def persist(self) -> str:
        """Writes a new version of the manifest beside the runs; returns the folder, which ``restore`` takes."""
        p, self.version = self.plan, self.version + 1
        held = {k: getattr(self, k) for k in ("tombstone_cap", "flushes", "sequence", "buffer", "buffered", "buffered_tombstones", "consumed")}
        held |= {"cap": p.cap, "scale": p.scale, "policy": p.policy, "max_tombstones": p.max_tombstones}
        held["levels"] = [[[r.first, r.last, r.records, r.tombstones, self.files[r.first, r.last]] for r in level] for level in p.levels]
        self.spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.text(f"{self.folder}/manifests/{self.version:012d}")
        return self.folder

    @classmethod
    def versions(cls, spark: SparkSession, folder: str) -> list[int]:
        """Versions whose manifests were written to the end."""
        place = f"{folder}/manifests"
        return [int(v) for v in folders(spark, place) if "_SUCCESS" in folders(spark, f"{place}/{v}")]

    @classmethod
    def _manifest(cls, spark: SparkSession, folder: str, version: int) -> dict:
        return json.loads(spark.read.text(f"{folder}/manifests/{version:012d}").first()["value"])

    @classmethod
    def restore(cls, spark: SparkSession, folder: str, version: int | None = None) -> Engine:
        """The engine as of its newest manifest, or of ``version``."""
        found = cls.versions(spark, folder)
        held = cls._manifest(spark, folder, max(found) if version is None else version)
        engine = cls(spark, folder, held["cap"], held["scale"], held["policy"], held["max_tombstones"], held["tombstone_cap"])
        for k in ("flushes", "sequence", "buffer", "buffered", "buffered_tombstones", "consumed"):
            setattr(engine, k, held[k])
        engine.version = max(found)
        for level in held["levels"]:
            engine.plan.levels.append([Run(a, b, n, t) for a, b, n, t, _ in level])
            engine.files |= {(a, b): path for a, b, _, _, path in level}
        return engine

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes manifests but the newest ``keep``, then folders of runs that neither they nor the engine use; returns their names."""
        found = self.versions(self.spark, self.folder)
        stay, gone = found[max(0, len(found) - keep) :], found[: max(0, len(found) - keep)]
        used = set(self._paths())
        for v in stay:
            held = self._manifest(self.spark, self.folder, v)
            used |= {path for level in held["levels"] for *_, path in level if path} | set(held["buffer"])
        names = {p[len(self.folder) + 1 :].split("/")[0] for p in used}
        old = [f"manifests/{v:012d}" for v in gone] + [x for x in folders(self.spark, self.folder) if x.startswith(("run-", "batch-")) and x not in names]
        for x in old:
            removed(self.spark, f"{self.folder}/{x}")
        return old


_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RUN.fields)


def _rows(ends: DataFrame, *by: str, deletes: bool = True) -> DataFrame:
    """Operations of reduced records: the deletes that act on older runs at the first sequence number, what is left at the last."""
    rows = F.array(
        F.struct(F.col("first_seq").alias("seq"), F.lit(DELETE).alias("op"), (-F.col("low") if deletes else F.lit(0).cast("long")).alias("n")),
        F.struct(F.col("last_seq").alias("seq"), F.lit(INSERT).alias("op"), (F.col("total") - F.col("low")).alias("n")),
    )
    return ends.select(*by, *PAIR, F.inline(rows)).where("n > 0").select(*by, *RUN.names)


def _any_range(ranges: list[tuple[int, int]]) -> Column:
    """Keys in one of the ranges, or, where they are many, in the span of them all."""
    ranges = sorted({(a, z) for a, z in ranges if a is not None and z is not None and a <= z})
    if len(ranges) > ix.INTERVALS:
        ranges = [(ranges[0][0], max(z for _, z in ranges))]
    out = F.lit(False)
    for a, z in ranges:
        out = out | F.col("key").between(a, z)
    return out
