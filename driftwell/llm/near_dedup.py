"""Near duplicates by a MinHash LSH forest, confirmed on full shingle sets.

Texts with the same shingle set are one class and one row from there on.  A class
has one signature for each tree of the forest: a sequence of minimum hashes.  A
tree is the order of its signatures; classes that share a prefix stand together
in it, in a region.  Regions begin at the depth ``DEPTHS[0]``, at which a pair at
the threshold shares one in some tree but for a chance of ``MISS``.  A small region
gives its pairs as candidates, less those whose whole signatures differ by six
standard deviations.  A large region is read deeper and deeper, to neighbours by
longest common prefix.  Candidates are confirmed on the full sets, and links give
components.

What the deeper reading may have left out of large regions is made good:
where the classes of one still have several components, blocks of the region
compare all their pairs of different components that share a region, less again those
apart by six standard deviations (1e-9 of the links at the threshold, beside MISS).  A task unites what it links and returns a spanning forest, so no
group's pairs are ever listed.

Defined results: a text without words has no shingles and links with nothing.
Repeated rows are of one class; rows of one id count as linked.  A row of null id
names no class: its component is that of the other rows of its set, null without any,
and whether it is kept is null.  Texts of any length are read whole.  Empty tables
give an empty result.  Columns other than id and text are passed over, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added, ship, written
from .components import components
from .shingles import common, mix, shingle_sets

DEPTHS = (3, 5, 8)
MISS = 1e-7
#: Classes in a region up to which all its pairs are candidates.
SMALL = 48
#: Neighbours on each side by longest common prefix in a large region.
NEIGHBOURS = 2
BLOCK = 256
#: Sets of a task that confirms candidates: so many of a block, and so many bytes, about.
GROUP = 512
GROUP_BYTES = 16 << 20
#: Candidate ids that are broadcast at most (16 bytes each); more are joined by exchange.
BROADCAST_IDS = 1_000_000
SEED = 90210


def trees_for(percent: int) -> int:
    """Trees so that a pair at the threshold is in no common region with a chance of MISS at most."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** DEPTHS[0]))


def least_matches(percent: int, hashes: int) -> int:
    """Matching minimum hashes that a pair at the threshold has, less six standard deviations."""
    p = percent / 100
    return math.floor(hashes * p - 6 * math.sqrt(hashes * p * (1 - p)))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    flip, times = functions
    low = (shingles >> np.uint64(29)).astype(np.uint32)
    out = np.full(len(flip), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(out, ((low[at : at + 2048, None] ^ flip) * times).min(axis=0), out=out)
    return out


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a = mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    b = mix(mix(shingles) + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


def _signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, n, h1, h2, sig) of every row."""
    hashes = trees_for(percent) * DEPTHS[-1]

    def rows(texts: list[str | None]) -> list[list]:
        functions = _functions(hashes)
        sets = shingle_sets(texts, width)
        names = [set_name(s) if len(s) else (0, 0) for s in sets]
        return [[len(s) for s in sets], [x[0] for x in names], [x[1] for x in names], [signature(s, functions).tobytes() if len(s) else b"" for s in sets]]

    return added(docs, ["id"], "text", "n long, h1 long, h2 long, sig binary", rows)


def _region(depth: int) -> Column:
    """Name of the region of a row (tree, sig) at a depth."""
    return F.xxhash64("tree", F.expr(f"substring(sig, tree * {4 * DEPTHS[-1]} + 1, {4 * depth})"))


def _likely(a: np.ndarray, n_a: int, rest: np.ndarray, n: np.ndarray, percent: int, least: int) -> np.ndarray:
    """Which rows of ``rest`` (signatures) with set sizes ``n`` can reach the threshold with ``a``."""
    return (100 * np.minimum(n, n_a) >= percent * np.maximum(n, n_a)) & ((rest == a).sum(axis=1) >= least)


def _candidates(regions: DataFrame, percent: int, hashes: int, reach: int) -> DataFrame:
    """Pairs (a, b, spans) of classes of each region's members, in the tree's order, up to ``reach`` places apart.

    The pairs that span connect all that a region's pairs connect.
    """
    least = least_matches(percent, hashes)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[tuple[int, int], bool] = {}
            for tree, members in zip(b["tree"], b["members"], strict=True):
                part = slice(int(tree) * 4 * DEPTHS[-1], (int(tree) + 1) * 4 * DEPTHS[-1])
                members = sorted(members, key=lambda m: (bytes(m["sig"])[part], m["rep"]))
                sigs = np.array([np.frombuffer(bytes(m["sig"]), dtype=np.uint32) for m in members])
                n, reps = np.array([m["n"] for m in members]), [m["rep"] for m in members]
                union = _Union()
                for i in range(len(members) - 1):
                    upto = i + 1 + reach
                    for j in np.flatnonzero(_likely(sigs[i], n[i], sigs[i + 1 : upto], n[i + 1 : upto], percent, least)):
                        x, y = reps[i], reps[i + 1 + int(j)]
                        if x != y:
                            pair = (min(x, y), max(x, y))
                            out[pair] = union.join(x, y) or out.get(pair, False)
            yield pd.DataFrame([(a, b, spans) for (a, b), spans in sorted(out.items())], columns=["a", "b", "spans"]).astype({"a": "int64", "b": "int64", "spans": "bool"})

    held = regions.groupBy("tree", "region").agg(F.collect_list(F.struct("rep", "n", "sig")).alias("members"))
    return held.mapInPandas(rows, "a long, b long, spans boolean")


def _forest(classes: DataFrame, trees: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs (a, b, spans), members (tree, region, size, rep) of large regions at the first depth)."""
    hashes = trees * DEPTHS[-1]
    heads = classes.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    pairs, large = [], None
    for k, depth in enumerate(DEPTHS):
        source = heads if large is None else deeper.join(classes.select("rep", "sig"), "rep")  # noqa: F821
        placed = source.select("rep", "tree", _region(depth).alias("region"))
        if large is not None:
            placed = written(placed, f"placed{depth}")
        sizes = written(placed.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"sizes{depth}")
        members = written(placed.join(sizes, ["tree", "region"]), f"members{depth}")
        small = members.where(F.col("size") <= SMALL).join(classes.select("rep", "n", "sig"), "rep")
        pairs.append(_candidates(small, percent, hashes, SMALL if k == 0 else NEIGHBOURS))
        deeper = members.where(F.col("size") > SMALL)
        if large is None:
            large = deeper
        if deeper.isEmpty():
            break
        deeper = deeper.select("rep", "tree") if k < len(DEPTHS) - 1 else deeper
    else:
        # One prefix to the last depth: nearly equal sets, each with the region's first.
        firsts = written(deeper.groupBy("tree", "region").agg(F.min("rep").alias("a")), "firsts")
        pairs.append(deeper.join(firsts, ["tree", "region"]).where("a < rep").select("a", F.col("rep").alias("b"), F.lit(True).alias("spans")))
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return written(out.groupBy("a", "b").agg(F.max("spans").alias("spans")), "pairs"), large


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(rep, shingles) for the ids that stand in pairs or large regions; the others' texts aren't moved."""
    ids = written(ids.distinct(), "ids")
    n = ids.count()
    wanted = docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, docs["id"] == ids["rep"], "left_semi")

    made = added(wanted, [F.col("id").alias("rep")], "text", "shingles binary", lambda texts: [[s.tobytes() for s in shingle_sets(texts, width)]])
    return written(made, "sets")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = common(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both) and both > 0


class _Union:
    """Disjoint sets of the ids of one task."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart until now."""
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of the links among candidate pairs.

    Candidates are grouped by the components that they form, so that a set goes to one
    task and not to one for each of its pairs.  A large component is cut into blocks, and
    a task holds the pairs of two blocks.
    """
    grouped = components(pairs.where("spans"), "candidates")
    sizes = grouped.join(sets.select(F.col("rep").alias("id"), F.length("shingles").alias("bytes")), "id").groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("c") / GROUP), F.ceil(F.col("bytes") / GROUP_BYTES))
    sizes = written(sizes.select("component", blocks.cast("long").alias("blocks")), "groups")
    placed = written(grouped.join(sizes, "component").select("id", "component", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")), "grouped")
    first = placed.select(F.col("id").alias("a"), "component", F.col("block").alias("of_a"))
    second = placed.select(F.col("id").alias("b"), F.col("block").alias("of_b"))
    sided = pairs.join(first, "a").join(second, "b").select("component", F.least("of_a", "of_b").alias("i"), F.greatest("of_a", "of_b").alias("j"), "a", "b")
    sided = written(sided, "sided")
    ends = sided.select("component", "i", "j", F.explode(F.array("a", "b")).alias("rep")).distinct().join(sets, "rep")
    none = F.lit(None).cast("long")
    rows = ends.select("component", "i", "j", "rep", "shingles", none.alias("a"), none.alias("b")).unionByName(sided.select("component", "i", "j", none.alias("rep"), F.lit(None).cast("binary").alias("shingles"), "a", "b"))

    def check(task: pd.DataFrame) -> pd.DataFrame:
        docs = task[task["rep"].notna()]
        held: dict[int, list[np.ndarray]] = {}
        for rep, raw in zip(docs["rep"].astype("int64"), docs["shingles"], strict=True):
            held.setdefault(rep, []).append(np.frombuffer(raw, dtype=np.uint64))
        union, out = _Union(), []
        asked = task[task["a"].notna()]
        for a, b in sorted(zip(asked["a"].astype("int64"), asked["b"].astype("int64"), strict=True)):
            if union.root(a) != union.root(b) and any(_linked(x, y, percent) for x in held.get(a, []) for y in held.get(b, [])):
                union.join(a, b)
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return written(rows.groupBy("component", "i", "j").applyInPandas(check, "a long, b long"), "links")


def _completed(large: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, trees: int) -> DataFrame | None:
    """Links between components inside large regions; None where no region has several.

    Large regions that share classes, which those of one group do in most trees, are one
    area, so that a group is compared once and not in each tree.
    """
    least = least_matches(percent, trees * DEPTHS[-1])
    pivots = written(large.groupBy("tree", "region").agg(F.min("rep").alias("a")), "pivots")
    areas = components(large.join(pivots, ["tree", "region"]).select("a", F.col("rep").alias("b")).where("a <> b").distinct(), "areas")
    areas = areas.select(F.col("id").alias("rep"), F.col("component").alias("area"))
    marked = written(areas.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("area", "rep", F.coalesce("component", "rep").alias("label")), "marked")
    by_label = marked.groupBy("area", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = by_label.groupBy("area").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("in_main"), (F.sum("c") - F.max("c")).alias("rest"))
    mixed = written(mixed.where("rest > 0"), "mixed")
    if mixed.isEmpty():
        return None
    # Blocks 0..p-1 hold the main component, p..p+q-1 the others; main blocks aren't paired with each other.
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    placed = marked.join(mixed.select("area", "main", blocks("in_main").alias("p"), blocks("rest").alias("q")), "area")
    is_main = F.col("label") == F.col("main")
    h = F.xxhash64("rep")
    block = F.when(is_main, F.pmod(h, F.col("p"))).otherwise(F.col("p") + F.pmod(h, F.col("q"))).cast("int")
    last = F.col("p") + F.col("q") - 1
    others = F.when(is_main, F.sequence(F.col("p"), last)).otherwise(F.sequence(F.lit(0), last))
    full = placed.select("area", "rep", "label", block.alias("block"), others.alias("others")).join(classes.select("rep", "n", "sig"), "rep").join(sets, "rep")
    spread = full.select("area", "rep", "label", "block", "n", "sig", "shingles", F.explode("others").alias("other"))
    tasks = spread.select("area", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "label", "block", "n", "sig", "shingles")

    def check(task: pd.DataFrame) -> pd.DataFrame:
        task = task.sort_values(["block", "rep"], kind="stable")
        return pd.DataFrame(_compare(task, bool(task["i"].iloc[0] == task["j"].iloc[0]), percent, least), columns=["a", "b"], dtype="int64")

    return written(tasks.groupBy("area", "i", "j").applyInPandas(check, "a long, b long"), "completed")


def _compare(task: pd.DataFrame, same: bool, percent: int, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the labels of two blocks, or of one with itself.

    Pairs count that share a region in some tree.
    """
    sigs = np.array([np.frombuffer(x, dtype=np.uint32) for x in task["sig"]])
    sets = [np.frombuffer(x, dtype=np.uint64) for x in task["shingles"]]
    n, block = task["n"].to_numpy(), task["block"].to_numpy()
    labels, reps = task["label"].tolist(), task["rep"].tolist()
    heads = sigs.reshape(len(sigs), -1, DEPTHS[-1])[:, :, : DEPTHS[0]]
    union, out = _Union(), []
    for i in range(len(reps) - 1):
        able = _likely(sigs[i], n[i], sigs[i + 1 :], n[i + 1 :], percent, least)
        if not same:
            able &= block[i + 1 :] != block[i]
        at = np.flatnonzero(able) + i + 1
        at = at[(heads[at] == heads[i]).all(axis=2).any(axis=1)]
        for j in at.tolist():
            if union.root(labels[i]) != union.root(labels[j]) and _linked(sets[i], sets[j], percent):
                union.join(labels[i], labels[j])
                out.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Documents link when 100 * intersection >= ``percent`` * union of their sets of
    shingles of ``width`` words; ``component_id`` is the smallest id reachable.
    """
    ship(docs.sparkSession)
    trees = trees_for(percent)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(_signed(base, width, percent), "signatures")
    classes = written(signed.where("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.min("sig").alias("sig")), "classes")
    pairs, large = _forest(classes, trees, percent)
    sets = _sets(base, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(large.select("rep")), width)
    links = _confirmed(pairs, sets, percent)
    labels = components(links, "near")
    if not large.isEmpty():
        more = _completed(large, labels, classes, sets, percent, trees)
        if more is not None and not more.isEmpty():
            labels = components(links.unionByName(more), "nearer")
    named = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    named = written(named, "named")
    out = signed.select("id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
