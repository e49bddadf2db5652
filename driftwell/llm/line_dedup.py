"""Line deduplication that returns keep bitmaps, in DataFrame operations only.

Line hashes are range-partitioned and sorted by document and position within each
hash.  One pass over each partition's sorted rows carries the first document of
the hash along; a later document's line is dropped where it is met, so only the
dropped lines go on, and become one keep bitmap per document in run-length form:
the runs of line numbers that stay.

A hash that holds a notable part of all lines is dealt by document into salted
ranges, so that no partition has it whole; the first occurrences of its ranges,
a row for each, are then settled among themselves.  Which hashes these are comes
from a sample of the lines, which decides about balance alone and never about results.

Defined results: a null text counts as empty and has one empty line.  Rows of
the same id are one document to the rule: a line that they share isn't dropped
from either.  A row of null id keeps its lines, and no line goes for its sake.
An empty table gives an empty result.  Columns of the caller that bear the names
of the results (n_lines, n_dropped, kept_runs, kept_text) give way to them; all
others are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, partitions_for, written

MIN_CHARS = 10
SPACES = " \t\n\x0b\x0c\r"
#: Lines in a range partition, about.
LINES = 4_000_000
#: Sampled lines for each partition, and how many of them of one hash make it a frequent one; at most
#: SAMPLED / FREQUENT hashes for each partition are.
SAMPLED = 200
FREQUENT = 25
MADE = ["n_lines", "n_dropped", "kept_runs", "kept_text"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def frequent_hashes(hashed: DataFrame, rows: int, partitions: int) -> DataFrame:
    """Hashes (h1, h2) that fill a quarter of a partition or more, about: a table of bounded size."""
    bits = 30
    rate = min(1.0, SAMPLED * partitions / max(1, rows))
    drawn = hashed.where(F.pmod(F.xxhash64("id", "pos", F.lit(bits)), F.lit(1 << bits)) < int(rate * (1 << bits)))
    return drawn.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= FREQUENT).select("h1", "h2")


def with_first(hashed: DataFrame, frequent: DataFrame, partitions: int) -> DataFrame:
    """``hashed`` with ``salt`` and ``first_id``, the first document of the row's hash in its range."""
    marked = hashed.join(F.broadcast(frequent.withColumn("often", F.lit(True))), ["h1", "h2"], "left")
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("id"), F.lit(partitions)) + 1).otherwise(0).cast("int")
    dealt = marked.withColumn("salt", salt).drop("often")
    ranged = dealt.repartitionByRange(partitions, "h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "id", "pos")
    # The ranges cluster this window's rows and the sort orders them: it adds no exchange and no sort.
    passed = W.partitionBy("h1", "h2", "salt").orderBy("id", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranged.withColumn("first_id", F.first("id").over(passed))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, partitions: int | None = None) -> DataFrame:
    """(id, row_hash, dropped) for the documents that lose lines.

    ``dropped`` holds the numbers of the lines that go (from 0, ascending).
    ``row_hash`` is xxhash64 of the text; with the id it names the row.
    """
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = base.select("id", F.xxhash64("text").alias("row_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= min_chars)
    hashed = written(keys.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(17), F.col("line")).alias("h2"), "id", "row_hash", "pos"), "lines")
    rows = hashed.count()
    partitions = partitions or partitions_for(docs.sparkSession, rows, LINES)
    frequent = written(frequent_hashes(hashed, rows, partitions), "frequent")
    met = with_first(hashed, frequent, partitions)
    late = written(met.where("salt > 0 or id > first_id"), "late")
    across = late.where("salt > 0").groupBy("h1", "h2").agg(F.min("first_id").alias("first"))  # a row for each frequent hash at most
    gone = late.join(F.broadcast(across), ["h1", "h2"], "left").where(F.col("id") > F.coalesce("first", "first_id"))
    return gone.groupBy("id", "row_hash").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def kept_runs(n_lines: Column, dropped: Column) -> Column:
    """Runs (start, length) of 0..n_lines-1 without ``dropped`` (ascending)."""
    ends = F.concat(dropped, F.array(n_lines))
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda x: x + 1))
    runs = F.arrays_zip(starts.alias("start"), ends.alias("stop"))
    return F.transform(F.filter(runs, lambda r: r["start"] < r["stop"]), lambda r: F.struct(r["start"].alias("start"), (r["stop"] - r["start"]).alias("length")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the columns n_lines, n_dropped, kept_runs and kept_text added.

    A key (the line without x20 and x09-x0D at both ends, A-Z lower-cased) of at
    least ``min_chars`` characters found in two documents or more loses all its
    lines but those of the smallest id.
    """
    apart = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))
    own_id, own_hash, own = f"{apart}id", f"{apart}hash", f"{apart}dropped"
    gone = keep_bitmaps(docs, id_col, text_col, min_chars).select(F.col("id").alias(own_id), F.col("row_hash").alias(own_hash), F.col("dropped").alias(own))
    text = F.coalesce(F.col(text_col), F.lit(""))
    passed = [c for c in docs.columns if c.lower() not in MADE or c in (id_col, text_col)]
    joined = docs.select(*[F.col(f"`{c}`") for c in passed]).join(gone, (F.col(id_col) == F.col(own_id)) & (F.xxhash64(text) == F.col(own_hash)), "left")
    dropped = F.coalesce(F.col(own), F.array().cast("array<int>"))
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")
    out = joined.withColumns({"n_lines": n_lines.cast("long"), "n_dropped": F.size(dropped).cast("long"), "kept_runs": kept_runs(n_lines, dropped)})
    # One element that holds the lines, so that they are split once and not for each run.
    held = F.array(F.struct(_lines(F.col(text_col)).alias("lines"), F.col("kept_runs").alias("runs")))
    kept = F.transform(held, lambda h: F.flatten(F.transform(h["runs"], lambda r: F.slice(h["lines"], r["start"] + 1, r["length"]))))[0]
    out = out.withColumn("kept_text", F.when(F.col("n_dropped") == 0, text).otherwise(F.array_join(kept, "\n")))
    return out.drop(own_id, own_hash, own)
