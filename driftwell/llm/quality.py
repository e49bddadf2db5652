"""Quality rules: counts that fail a text outright, and an n-gram likelihood ratio for the rest.

The ratio follows importance-weight selection: hashed byte n-grams, one
multinomial of a trusted target and one of the raw corpus, and for each document
the mean over its n-grams of log p(target) - log p(raw).  The raw counts cover
every document, the target's every trusted one, and the threshold is found on all
labelled rows.  It decides each document by itself.  The target's texts meet their
labels by exchange, compressed; labels and ratios are exchanged without texts, and
the driver gets a row for each bucket and for each range of ratios.

Defined results: a null text has no words and fails; so does an empty one.
Without trusted rows every ratio is 0 and the base rules decide alone.  Texts of any
length are read whole.  Repeated rows are judged each by itself, alike; a ratio equal
to the threshold passes.  Empty tables give an empty result.  Other columns are passed
over, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import added, partitions_for, ship, written
from .ngrams import hashed, pieces
from .shingles import _SPACE, word_hashes

BITS = 16
WIDTH = 4
SMOOTHING = 1.0
#: Distinct ratios in a range that one task orders.
RATIOS = 1 << 20
#: Share of trusted rows that the threshold may reject.
TRUSTED_LOSS = 0.002
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Scorer:
    """``log_ratio`` by bucket; documents with a mean below ``threshold`` are rejected."""

    log_ratio: np.ndarray
    threshold: float


def base_counts(text: str | None, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); ``words``: the text's word hashes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, dtype=np.uint8)
    chars = int(np.count_nonzero(~_SPACE[raw] & ((raw & 0xC0) != 0x80)))
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line.strip(b" \t\n\r\v\f"):
            dup += line in seen
            seen.add(line)
    repeat = 0
    if len(words) > WINDOW:
        n = len(words) - WINDOW + 1
        h = np.zeros(n, dtype=np.uint64)
        for j in range(WINDOW):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : n + j]
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[back] > 1)
        if len(twice):
            step = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(step, twice, 1)
            np.add.at(step, twice + WINDOW, -1)
            repeat = int(np.count_nonzero(np.cumsum(step[:-1])))
    return len(words), chars, int(np.count_nonzero(_SYMBOL[raw])), dup, repeat


def mean_ratio(text: str | None, log_ratio: np.ndarray) -> float:
    total, n = 0.0, 0
    for piece in pieces((text or "").encode("utf-8", "surrogatepass"), WIDTH):
        found = hashed(piece, WIDTH, BITS)
        total += float(log_ratio[found].sum(dtype=np.float64))
        n += len(found)
    return total / n if n else 0.0


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashed n-grams of the texts, UTF-8 and compressed where they are binary."""
    held = np.zeros(1 << BITS, dtype=np.int64)
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        for text in batch["text"]:
            data = opener.decompress(text) if isinstance(text, (bytes, bytearray)) else (text or "").encode("utf-8", "surrogatepass")
            for piece in pieces(data, WIDTH):
                held += np.bincount(hashed(piece, WIDTH, BITS), minlength=1 << BITS)
    at = np.flatnonzero(held)
    yield pd.DataFrame({"bucket": at, "n": held[at]})


def _summed(texts: DataFrame) -> np.ndarray:
    """Counts by bucket over all rows of ``texts`` (text)."""
    counted = texts.mapInPandas(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # 2**BITS rows at most
    out = np.zeros(1 << BITS)
    out[table["bucket"]] = table["n"]
    return out


def _marked(labels: DataFrame, id_col: str, quality_col: str) -> DataFrame:
    """(id, quality), one row for each labelled id, with its largest quality."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(quality_col).cast("long")).alias("quality"))


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> np.ndarray | None:
    """log p(target) - log p(raw) by bucket, over all trusted rows and all of ``docs``; None without trusted n-grams."""
    ship(docs.sparkSession)

    def compressed(texts: list[str | None]) -> list[list]:
        maker = zstandard.ZstdCompressor(level=1)
        return [[maker.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]]

    trusted = _marked(labels, id_col, quality_col).where(F.col("quality") > 0).select("id")
    sent = added(docs.where(F.col(id_col).isNotNull()), [F.col(id_col).alias("id")], text_col, "packed binary", compressed)
    target = _summed(sent.join(trusted.hint("shuffle_hash"), "id", "left_semi").select(F.col("packed").alias("text")))
    if not target.sum():
        return None
    p, q = target + SMOOTHING, _summed(docs.select(F.col(text_col).alias("text"))) + SMOOTHING
    return (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)


def _cut(rows: DataFrame, labels: DataFrame, id_col: str, quality_col: str) -> float:
    """The threshold on all labelled rows of ``rows`` (id, base_failed, ratio) that the base rules pass."""
    fine = rows.where(~F.col("base_failed") & F.col("id").isNotNull()).select("id", "ratio")
    return threshold(fine.join(_marked(labels, id_col, quality_col).hint("shuffle_hash"), "id"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> Scorer:
    """Multinomials over all of ``docs`` and over all trusted rows, and the threshold on all labelled ones.

    ``labels``: (id, quality 0 or 1); ids that repeat count by their largest quality.
    """
    log_ratio = log_ratios(docs, labels, id_col, text_col, quality_col)
    if log_ratio is None:
        return Scorer(np.zeros(1 << BITS, dtype=np.float32), -1.0)
    return Scorer(log_ratio, _cut(measured(docs, log_ratio, id_col, text_col), labels, id_col, quality_col))


def threshold(seen: DataFrame) -> float:
    """The cut with the fewest errors among those that lose at most TRUSTED_LOSS of the trusted rows of ``seen`` (quality, ratio)."""
    good, bad = (F.sum(x.cast("long")) for x in (F.col("quality") > 0, F.col("quality") <= 0))
    steps = written(seen.groupBy("ratio").agg(good.alias("good"), bad.alias("bad")), "ratios")
    ranges = steps.repartitionByRange(partitions_for(seen.sparkSession, steps.count(), RATIOS), "ratio")
    steps = written(ranges.withColumn("part", F.spark_partition_id()), "ranges")
    parts = sorted(steps.groupBy("part").agg(F.sum("good"), F.sum("bad")).collect())
    n_good = sum(r[1] for r in parts)
    if not n_good:
        return -1e9
    before, held = [], [0, 0]
    for part, *sums in parts:
        before.append((part, *held))
        held = [a + b for a, b in zip(held, sums, strict=True)]
    before = F.broadcast(seen.sparkSession.createDataFrame(before, "part int, good_before long, bad_before long"))
    rising = Window.partitionBy("part").orderBy("ratio")
    upto = [(F.sum(x).over(rising) + F.col(f"{x}_before")).alias(f"{x}_upto") for x in ("good", "bad")]
    steps = steps.join(before, "part").select("ratio", "bad", *upto)
    limit = steps.where(F.col("good_upto") > int(TRUSTED_LOSS * n_good)).agg(F.min("ratio")).first()[0]
    cuts = steps.where((F.col("ratio") < limit) & (F.col("bad") > 0) | (F.col("ratio") == limit))
    best = cuts.agg(F.min(F.struct(F.col("good_upto") - F.col("bad_upto"), "ratio"))).first()[0][1]
    above = steps.where(F.col("ratio") > best).agg(F.min("ratio")).first()[0]
    return best if above is None else (best + above) / 2


def _picked(counts: tuple[int, int, int, int, int]) -> tuple[int, int]:
    return counts[0], counts[4]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def measured(docs: DataFrame, log_ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio)."""
    spread = docs.sparkSession.sparkContext.broadcast(log_ratio)

    def rows(texts: list[str | None]) -> list[list]:
        hashes, bound = word_hashes(texts, fold=False)
        found = [base_counts(t, hashes[bound[i] : bound[i + 1]]) for i, t in enumerate(texts)]
        failed = [base_failed(*_picked(x)) for x in found]
        counts = [[x[k] for x in found] for k in range(5)]
        return [*counts, failed, [mean_ratio(t, spread.value) for t in texts]]

    made = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double"
    return added(docs, [F.col(id_col).alias("id")], text_col, made, rows)


def _decided(rows: DataFrame, cut: float) -> DataFrame:
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= F.lit(cut)))


def judge(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept)."""
    return _decided(measured(docs, scorer.log_ratio, id_col, text_col), scorer.threshold)


def fit_and_judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """``judge`` of ``docs`` by what ``fit`` learns of them; ratios are taken once."""
    log_ratio = log_ratios(docs, labels, id_col, text_col, quality_col)
    if log_ratio is None:
        return judge(docs, Scorer(np.zeros(1 << BITS, dtype=np.float32), -1.0), id_col, text_col)
    rows = written(measured(docs, log_ratio, id_col, text_col), "measured")
    return _decided(rows, _cut(rows, labels, id_col, quality_col))
