"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of a fixed number of characters.  The blocks, sorted by
a 64-bit fingerprint and then by content, are named by integers; then the pairs
of adjacent names are named in the same way, level by level, until every text
has one name.  Two texts get the same (level, name) if and only if they are
equal.  No hash can collide: with each fingerprint goes the smallest and the
largest content that has it; where they differ, the contents themselves are
sorted and named.

So the text crosses one exchange, once per task and distinct block; everything
after that is integers.  A name is built from the partition and the place in its
sorted list of distinct keys, and each level is written, so a repeated task
gives the same names.

Defined results: a null text counts as empty; an empty text is one empty block.
Rows of the same id and text are separate members of one group.  A row of null id
is a member of its group; whether it is kept is null, as null equals no id.  An empty table
gives an empty result.  Other columns are passed over, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, joined_by_size, written

BLOCK_CHARS = 4096
#: Blocks in a stretch.
CUT = 64
KEY = ["id", "text_sha256"]


def _numbered(keys: DataFrame, columns: list[str], start: int = 0) -> DataFrame:
    """``keys``, distinct on ``columns``, sorted in their partitions and named."""
    return keys.sortWithinPartitions(*columns).withColumn("name", F.monotonically_increasing_id() + F.lit(start))


def _cut(block_chars: int, make: Callable[[Column, Column], Column]) -> Column:
    """What ``make`` gives of the place and the content of each block of ``text``.

    A text is cut into stretches of CUT blocks first: finding a place in a text means reading up to it.
    """
    upto = lambda text, size: F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length(text) / F.lit(size)).cast("int"), F.lit(1)) - 1)
    part = lambda text, i, size: F.substring(text, i * size + 1, F.lit(size))
    text, long = F.col("text"), CUT * block_chars
    stretches = F.transform(upto(text, long), lambda c: F.struct(c.alias("at"), part(text, c, long).alias("held")))
    return F.flatten(F.transform(stretches, lambda s: F.transform(upto(s["held"], block_chars), lambda i: make((s["at"] * CUT + i).cast("int"), part(s["held"], i, block_chars)))))


def _name_blocks(texts: DataFrame, units: DataFrame, block_chars: int, fingerprint: Callable[[Column], Column]) -> DataFrame:
    """(KEY, n, at, name) for the blocks of ``texts``; ``units`` (KEY, prints) holds their fingerprints."""
    contents = texts.select(F.explode(_cut(block_chars, lambda i, b: b)).alias("block")).withColumn("print", fingerprint(F.col("block")))
    prints = contents.groupBy("print").agg(F.min("block").alias("least"), F.max("block").alias("most"), F.count(F.lit(1)).alias("held"))
    prints = written(_numbered(prints, ["print"]).select("print", "name", "held", (F.col("least") != F.col("most")).alias("collided")), "prints")
    placed = units.select(*KEY, F.size("prints").alias("n"), F.posexplode("prints").alias("at", "print"))
    sound = prints.where(~F.col("collided")).select("print", "name", "held")
    blocks = prints.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    named = joined_by_size(placed, sound, ["print"], "held", blocks).select(*KEY, "n", "at", "name")
    clashing = prints.where("collided").select("print")
    if clashing.isEmpty():
        return named
    n = F.greatest(F.ceil(F.char_length("text") / F.lit(block_chars)).cast("int"), F.lit(1))
    whole = texts.select(*KEY, n.alias("n"), F.inline(_cut(block_chars, lambda i, b: F.struct(i.alias("at"), b.alias("block"))))).withColumn("print", fingerprint(F.col("block")))
    apart = written(whole.join(clashing, "print", "left_semi"), "apart")
    by_content = written(_numbered(apart.groupBy("print", "block").agg(F.count(F.lit(1)).alias("c")).drop("c"), ["print", "block"], 1 << 62), "contents")
    return named.unionByName(apart.join(by_content, ["print", "block"]).select(*KEY, "n", "at", "name"))


def block_identity(texts: DataFrame, units: DataFrame, block_chars: int = BLOCK_CHARS, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, text_sha256, level, name) for ``texts`` (id, text_sha256, text), text not null."""
    named, level, finished = _name_blocks(texts, units, block_chars, fingerprint), 0, None
    while True:
        named = written(named, f"level{level}")
        done = named.where("n = 1").select(*KEY, F.lit(level).alias("level"), "name")
        finished = done if finished is None else finished.unionByName(done)
        if named.where("n > 1").isEmpty():
            return finished.distinct()  # repeated rows of an id have the same blocks
        level += 1
        even = F.col("at") % 2 == 0
        pairs = (
            named.where("n > 1")
            .groupBy(*KEY, F.shiftright((F.col("n") + 1).cast("int"), 1).alias("m"), F.shiftright("at", 1).alias("half"))
            .agg(F.max(F.when(even, F.col("name"))).alias("first"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("second"))
        )
        pairs = written(pairs, f"pairs{level}")
        names = written(_numbered(pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("held")), ["first", "second"]), f"names{level}")
        named = joined_by_size(pairs, names, ["first", "second"], "held", pairs.count()).select(*KEY, F.col("m").alias("n"), F.col("half").alias("at"), "name")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    Texts are equal when identical after lower-casing A-Z alone; of equal texts
    the row of the largest id stays (rows that repeat that id with it).
    """
    base = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    base = base.select("id", F.sha2("text", 256).alias("text_sha256"), "text")
    units = written(base.select(*KEY, _cut(block_chars, lambda i, b: fingerprint(b)).alias("prints")), "units")
    named = block_identity(base, units, block_chars, fingerprint).withColumnsRenamed({"id": "named_id", "text_sha256": "named_sha256"})
    same = F.col("id").eqNullSafe(F.col("named_id")) & (F.col("text_sha256") == F.col("named_sha256"))
    identity = written(units.select(*KEY).join(named, same).select(*KEY, "level", "name"), "identity")
    groups = written(identity.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    out = joined_by_size(identity, groups, ["level", "name"], "group_size", identity.count())
    return out.select("id", "keep_id", "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), "text_sha256")
