"""Best-fit packing of token sequences by a grouping genetic algorithm.

A document's tokens end with a separator; only documents longer than a sequence
are cut, into full pieces with the shorter one first.  Full pieces are sequences
already.  The others are dealt into shards of bounded size by a hash of their
identity, and each shard is packed by several islands.

An island holds a small population of packings, which are lists of bins.  The
crossover takes whole well-filled bins of one parent into the other, drops the
bins that hold one of their documents a second time, and puts the documents that
lost their bins back by best fit, largest first.  The mutation dissolves bins, and
their documents first take the places of smaller ones wherever a bin has room for
the difference.  An epoch ends on an island when so many generations in a row gave
no fewer bins, or when no fewer bins are possible.  After each epoch the best
packing of an island migrates to the next island of its shard, and a shard has
further epochs as long as they bring fewer bins.  The best packing of all is kept.
What then stands in poorly filled bins goes to the next round, in fewer shards,
until one shard is left; a round's bins are final otherwise.  The poor bins are final too where they hold half of a round's pieces or more, and more
than a shard: such pieces don't fit together, and dealing them anew gains little.

Every random choice is seeded by shard, island and epoch, and the rounds are
written to the shared folder, so lost tasks repeat with the same result.

Defined results: null counts as empty; an empty text is its separator alone.
Rows that repeat are packed each by itself.  Pieces of equal length are interchangeable:
their order follows shard, then id.  An empty table gives no rows.  Texts of any length
are read whole.  Other columns are passed over, whatever their names.
"""

from __future__ import annotations

import random
import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, ship, tokenizer_path, written

CAPACITY = 2048
SEPARATOR = 0
#: Pieces in a shard, about; an island's work and memory are bounded by it.
SHARD = 8192
ISLANDS = 3
POPULATION = 4
#: Generations in a row without fewer bins that end an epoch.
STALE = 8
#: Bins filled less than this go on to the next round.
FILLED = 0.985
PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"


# -- tokens ------------------------------------------------------------------


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Tokens:
    """Ids of a byte-level BPE vocabulary as little-endian unsigned 32-bit integers.

    The text is parted by the vocabulary's own pattern, and the tokenizers library gives
    the ids of every distinct part once for each memory of a worker.  ``checked`` holds
    whole texts against the library too.
    """

    #: Parts in the newer memory, and about as many in the older one; a task forgets both at its end, as its worker lives on.
    MEMORY = 250_000
    #: Characters of a text that is checked whole.
    CHECKED = 8192
    #: The parts that this kind of vocabulary fixes, with white space as Unicode defines it, and what they are up to U+00FF.
    PARTS = r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
    LATIN = {"L": "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "N": "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "S": "\t-\r \u0085\u00a0"}
    LATIN_PARTS = " ?[{L}]+|'(?:[stmd]|re|ve|ll)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+".format(**LATIN)

    def __init__(self, file: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.shown = "".join(chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256))
        self.any_part, self.latin_part = regex.compile(self.PARTS), re.compile(self.LATIN_PARTS)
        self.special = {t: struct.pack("<I", i) for t, i in special.items()}
        self.by_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _of_part(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():
            shown = part.replace(" ", self.shown[32])
        else:
            shown = part.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.shown)
        ids = [t.id for t in self.library.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        parts = (self.latin_part if _latin(text) else self.any_part).findall(text)
        new, old = self.new, self.old
        for p in {*parts}.difference(new):
            new[p] = old[p] if p in old else self._of_part(p)
        out = b"".join(map(new.__getitem__, parts))
        if len(new) > self.MEMORY:
            self.old, self.new = new, {}
        return out

    def __call__(self, text: str) -> bytes:
        if self.by_special and any(t in text for t in self.special):
            return b"".join(self.special.get(x) or self._plain(x) for x in self.by_special.split(text) if x)
        return self._plain(text)

    def checked(self, texts: list[str | None]) -> None:
        """Holds the first text of a batch that isn't long against the library; a difference ends the job."""
        text = next((t for t in texts if t and len(t) <= self.CHECKED), "")
        ids = self.library.encode(text, add_special_tokens=False).ids
        if self(text) != struct.pack(f"<{len(ids)}I", *ids):
            raise ValueError(f"the library encodes {text[:80]!r} otherwise")


_tokens: dict[str, Tokens] = {}


def cut(data: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's 4-byte ids."""
    n = len(data) // 4
    bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
    return [(i, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


def token_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents."""
    end = np.array([SEPARATOR], dtype="<u4").tobytes()

    def rows(texts: list[str | None]) -> list[list]:
        file = tokenizer_path(tokenizer)
        if file not in _tokens:
            _tokens[file] = Tokens(file)
        own = _tokens[file]
        own.checked(texts)
        found = [(i, *p) for i, t in enumerate(texts) for p in cut(own(t or "") + end, capacity)]
        return [[x[k] for x in found] for k in range(5)]

    def forget() -> None:
        for own in _tokens.values():
            own.new, own.old = {}, {}

    return added(docs, [F.col(id_col).cast("long").alias("doc_id")], text_col, "piece int, start long, length long, ids_crc32 long", rows, many=True, end=forget)


# -- one shard ---------------------------------------------------------------

Bins = list[list[int]]


def filled(held: list[int], sizes: list[int]) -> int:
    return sum(map(sizes.__getitem__, held))


def least_bins(sizes: list[int], capacity: int) -> int:
    """A number of bins that no packing is below.

    For each limit up to half a bin: pieces above ``capacity`` less the limit share a bin with none of
    at least the limit, those above a half with none of each other, and the rest fills the room of the latter.
    """
    count = np.bincount(np.array(sizes, dtype=np.int64), minlength=capacity + 1)
    n, tokens = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    limit = np.arange(capacity // 2 + 1)
    big = capacity - limit
    half = capacity // 2
    below = np.concatenate(([0], tokens))[limit]
    paired = n[big] - n[half]
    rest = tokens[half] - below - (paired * capacity - (tokens[big] - tokens[half]))
    return int((n[-1] - n[big] + paired + np.maximum(0, -(-rest // capacity))).max())


def best_fit(order: list[int], sizes: list[int], bins: Bins, capacity: int) -> Bins:
    """``bins`` with the items of ``order`` put, one by one, where they leave the least room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for k, b in enumerate(bins):
        r = capacity - filled(b, sizes)
        room[r].append(k)
        open_rooms |= 1 << r
    for i in order:
        size = sizes[i]
        fitting = open_rooms >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
            bins[k].append(i)
            r -= size
        else:
            k, r = len(bins), capacity - size
            bins.append([i])
        room[r].append(k)
        open_rooms |= 1 << r
    return bins


def fitness(bins: Bins, sizes: list[int], capacity: int) -> float:
    """Mean squared fill: fuller bins count for more, so fewer bins do too."""
    return sum([(filled(b, sizes) / capacity) ** 2 for b in bins]) / max(1, len(bins))


def crossover(taker: Bins, giver: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Whole well-filled bins of ``giver`` in ``taker``, duplicates removed, the displaced put back by best fit."""
    falling = sorted(giver, key=lambda b: -filled(b, sizes))
    top = falling[: max(1, len(falling) // 2)]
    injected = rng.sample(top, max(1, len(top) // 2))
    inside = {i for b in injected for i in b}
    stay, displaced = [], []
    for b in taker:
        if inside.isdisjoint(b):
            stay.append(b[:])
        else:
            displaced += [i for i in b if i not in inside]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(displaced, sizes, [b[:] for b in injected] + stay, capacity)


def exchange(loose: list[int], sizes: list[int], bins: Bins, capacity: int) -> list[int]:
    """What is loose when items of ``loose`` have taken the places of smaller ones in ``bins`` that have the room."""
    by_size: dict[int, list[int]] = {}
    there = 0
    for i in loose:
        by_size.setdefault(sizes[i], []).append(i)
        there |= 1 << sizes[i]
    for b in bins:
        r = capacity - filled(b, sizes)
        for k, i in enumerate(b):
            if not r:
                break
            fitting = (there >> (sizes[i] + 1)) & ((1 << r) - 1)
            if fitting:
                larger = fitting.bit_length()
                size = sizes[i] + larger
                b[k] = by_size[size].pop()
                if not by_size[size]:
                    there &= ~(1 << size)
                by_size.setdefault(sizes[i], []).append(i)
                there |= 1 << sizes[i]
                r -= larger
    return [i for held in by_size.values() for i in held]


def mutate(bins: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """The emptiest bins and a few others dissolved, their documents exchanged for smaller ones, the loose put back by best fit."""
    order = sorted(range(len(bins)), key=[filled(b, sizes) for b in bins].__getitem__)
    gone = set(order[: max(1, len(order) // 50)]) | set(rng.sample(range(len(bins)), max(1, len(bins) // 50)))
    stay = [b[:] for k, b in enumerate(bins) if k not in gone]
    loose = exchange([i for k in sorted(gone) for i in bins[k]], sizes, stay, capacity)
    return best_fit(sorted(loose, key=lambda i: (-sizes[i], rng.random())), sizes, stay, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[Bins]) -> Bins:
    """The best packing of one island after an epoch that starts from ``elites``."""
    if not sizes:
        return []
    rng = random.Random(seed)
    least = least_bins(sizes, capacity)
    falling = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    population = [*elites] or [best_fit(falling, sizes, [], capacity)]
    best = min(population, key=len)
    if len(best) <= least:
        return best
    while len(population) < POPULATION:
        noise = 1 + 0.3 * len(population)
        order = sorted(falling, key=lambda i: -sizes[i] * (1 + noise * 0.1 * rng.random()))
        population.append(best_fit(order, sizes, [], capacity))
    rated = sorted(((len(b), -fitness(b, sizes, capacity), k, b) for k, b in enumerate(population)), key=lambda x: x[:3])
    made, stale = POPULATION, 0
    while stale < STALE and rated[0][0] > least:
        a, b = rng.sample(rated[: max(2, POPULATION // 2 + 1)], 2)
        child = crossover(a[3], b[3], sizes, capacity, rng)
        child = mutate(child, sizes, capacity, rng)
        stale = 0 if len(child) < rated[0][0] else stale + 1
        rated = sorted([*rated, (len(child), -fitness(child, sizes, capacity), made, child)], key=lambda x: x[:3])[:POPULATION]
        made += 1
    return rated[0][3]


def _flat(bins: Bins, n: int) -> bytes:
    out = np.zeros(n, dtype="<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _bins(flat: bytes) -> Bins:
    at = np.frombuffer(flat, dtype="<i4")
    out: Bins = [[] for _ in range(int(at.max()) + 1 if len(at) else 0)]
    for i, k in enumerate(at.tolist()):
        out[k].append(i)
    return out


# -- all shards --------------------------------------------------------------


def _epoch(state: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """``state`` (shard, island, sizes, own, came) after one epoch: (shard, island, best, n_bins, fell).

    ``fell``: there are fewer bins than the epoch began with, or it was the first.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = []
            for r in b.itertuples(index=False):
                sizes = [int(x) for x in r.sizes]
                elites = [_bins(x) for x in (r.own, r.came) if x is not None]
                best = evolve(sizes, capacity, hash((int(r.shard), int(r.island), epoch)), elites)
                fell = not elites or len(best) < min(map(len, elites))
                done.append((r.shard, r.island, _flat(best, len(sizes)), len(best), fell))
            yield pd.DataFrame(done, columns=["shard", "island", "best", "n_bins", "fell"])

    return state.mapInPandas(rows, "shard long, island int, best binary, n_bins int, fell boolean")


def _round(items: DataFrame, shards: int, capacity: int, level: int, partitions: int) -> DataFrame:
    """``items`` with sequence_id, offset and filled, the tokens of the whole bin."""
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "start", F.lit(level)), F.lit(shards))
    shard = items.groupBy(dealt.alias("shard")).agg(F.array_sort(F.collect_list(F.struct("length", "doc_id", "piece", "start", "ids_crc32"))).alias("items"))
    shard = written(shard, f"shards{level}")
    sizes = F.transform("items", lambda x: x["length"].cast("int")).alias("sizes")
    islands = shard.select("shard", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), sizes)
    state = islands.withColumn("own", F.lit(None).cast("binary")).withColumn("came", F.lit(None).cast("binary"))
    ended, epoch, running = [], 0, True
    while running:
        best = written(_epoch(state.repartition(partitions, "shard", "island"), capacity, epoch), f"epoch{level}-{epoch}")
        falling = F.broadcast(best.where("fell").select("shard").distinct())
        running = not falling.isEmpty()
        ended.append(best.join(falling, "shard", "left_anti"))
        own = best.join(falling, "shard", "left_semi").select("shard", "island", F.col("best").alias("own"))
        migrants = own.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("own").alias("came"))
        state = islands.join(own, ["shard", "island"]).join(migrants, ["shard", "island"]).select("shard", "island", "sizes", "own", "came")
        epoch += 1
    best = reduce(DataFrame.unionByName, ended)
    won = best.groupBy("shard").agg(F.min_by("best", F.struct("n_bins", "island")).alias("best"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                for k, held in enumerate(_bins(r.best)):
                    full, offset = sum(r.items[i]["length"] for i in held), 0
                    for i in held:
                        x = r.items[i]
                        out.append((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"], (level << 54) | (int(r.shard) << 24) | k, offset, full))
                        offset += x["length"]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "filled"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, filled long"
    return written(shard.join(won, "shard").mapInPandas(placed, schema), f"placed{level}")


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    ship(pieces.sparkSession)
    partitions = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = written(pieces, "pieces")
    full = pieces.where(F.col("length") == capacity)
    out = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest, level = pieces.where(F.col("length") < capacity), 0
    n = rest.count()
    while n:
        shards = -(-n // shard)
        placed = _round(rest, shards, capacity, level, partitions)
        poor = F.col("filled") < FILLED * capacity
        left = placed.where(poor).count() if shards > 1 else 0
        if left > shard and left >= n / 2:
            left = 0
        out = out.unionByName((placed.where(~poor) if left else placed).drop("filled"))
        rest, level, n = placed.where(poor).drop("sequence_id", "offset", "filled"), level + 1, left
    return out


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece."""
    return pack(token_pieces(docs, tokenizer, capacity, id_col, text_col), capacity)
