"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the byte 2-, 3- and 4-grams of the lower-cased text with white space
and digits folded to one space; each has a bucket with an embedding.  A text is
the mean of its subwords' embeddings, mapped to languages by a linear softmax.
Both layers are trained by stochastic gradient descent in numpy on a sample of
labelled rows that is bounded in rows and bytes.  A fifth of that sample isn't
trained on; it calibrates the scores, by a temperature, and the rejection: a text
is rejected where its score lies below all but the REJECT_RATE least of the right
predictions there, so that about that share of texts in known languages goes.

As mean and map are linear, a trained model is one table of language logits by
bucket, which is what executors get (2**BITS x languages floats).

Defined results: null text or text without letters: ``und``, score 0, rejected.
Without labelled rows every text is ``und``.  Texts of any length are read whole.
Repeated rows are judged each by itself, alike; of equally likely languages the first
by name is told.  An empty table gives an empty result.  Columns of the caller that
bear the names of the results give way to them; others are passed over or on.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added
from .ngrams import hashed, pieces

BITS = 16
WIDTHS = (2, 3, 4)
DIM = 16
EPOCHS = 8
RATE = 0.5
#: Rows of the training sample for each language, by hash of the id, about.
PER_LANGUAGE = 1500
#: Bytes of the training sample's texts, about.
SAMPLE_BYTES = 64 << 20
#: Share of right predictions of held-out rows that the rejection would reject.
REJECT_RATE = 0.002
#: Where that is less than one row, the bound is this part of the least log-odds of a right prediction.
REJECT_PART = 0.9
SEED = 20240711
#: Characters from which a text's subwords are counted piece by piece.
LONG = 1 << 16
UNKNOWN = "und"
_BLANK = re.compile(rb"[\x00-\x20\d]+")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logits: np.ndarray  # (2**BITS, languages)
    bias: np.ndarray
    temperature: float
    reject_below: float


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of all subwords of a text, in arrays of bounded size."""
    data = _BLANK.sub(b" ", b" " + text.lower().encode("utf-8", "surrogatepass") + b" ")
    for w in WIDTHS:
        for p in pieces(data, w):
            yield hashed(p, w, BITS)


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's subwords, ascending, and how many fall into each."""
    parts = list(subwords(text)) if len(text) < LONG else None
    if parts is not None:
        return np.unique(np.concatenate(parts), return_counts=True)
    n = np.zeros(1 << BITS, dtype=np.int64)
    for found in subwords(text):
        n += np.bincount(found, minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, n[at]


def _mean(text: str, table: np.ndarray) -> np.ndarray:
    if len(text) >= LONG:
        at, n = _counted(text)
        return n @ table[at].astype(np.float64) / n.sum()
    found = np.concatenate(list(subwords(text)))
    return np.ones(len(found), dtype=table.dtype) @ table[found] / max(1, len(found))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z.astype(np.float64)
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str]) -> Model:
    """Fits on four fifths of the rows, calibrates on the others; the same rows give the same model."""
    names = tuple(sorted(set(langs)))
    target = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(texts))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    if not len(held):
        held = used
    # Two flat arrays for all rows: freed at once, they leave no holes in the driver's memory.
    places, shares, bounds = array("i"), array("f"), [0]
    for t in texts:
        at, n = _counted(t)
        places.frombytes(at.astype(np.int32).tobytes())
        shares.frombytes((n / max(1, n.sum())).astype(np.float32).tobytes())
        bounds.append(len(places))
    places, shares = np.frombuffer(places, dtype=np.int32), np.frombuffer(shares, dtype=np.float32)
    row = lambda i: (places[bounds[i] : bounds[i + 1]], shares[bounds[i] : bounds[i + 1]])
    embedding = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    weight = np.zeros((DIM, len(names)), dtype=np.float32)
    weight += rng.normal(0, 0.1, weight.shape).astype(np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    balance = len(used) / (len(names) * np.maximum(1, np.bincount(target[used], minlength=len(names))))
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for i in rng.permutation(used):
            at, share = row(i)
            x = share @ embedding[at]
            g = _softmax(x @ weight + bias).astype(np.float32)
            g[target[i]] -= 1
            g *= np.float32(min(4.0, balance[target[i]]))
            back = weight @ g
            weight -= rate * np.outer(x, g)
            bias -= rate * np.float32(0.1) * g
            # A subword's step is scaled up to its share in an average text, or rare ones never move.
            embedding[at] -= rate * np.minimum(share * 200, 1)[:, None] * back
    logits = (embedding @ weight).astype(np.float32)
    z = np.array([row(i)[1] @ logits[row(i)[0]] + bias for i in held])
    grid = np.geomspace(0.25, 16, 49)
    losses = [-np.log(_softmax(z / t)[np.arange(len(held)), target[held]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    p = _softmax(z / temperature)
    return Model(names, logits, bias, temperature, rejection(p.max(axis=1)[p.argmax(axis=1) == target[held]]))


def rejection(right: np.ndarray) -> float:
    """The score below which texts are rejected, from the scores of right predictions."""
    if not len(right):
        return 0.0
    least = np.sort(right)
    k = int(REJECT_RATE * len(least))
    if k:
        return float(least[k])
    odds = REJECT_PART * (np.log(least[0]) - np.log1p(-min(least[0], 1 - 1e-12)))
    return float(1 / (1 + np.exp(-odds)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of the rows of ``docs`` with a language and letters; None without any."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.col(lang_col) != UNKNOWN) & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row for each language
    if not sizes:
        return None
    room = SAMPLE_BYTES / len(sizes)
    share = F.create_map(*[x for r in sorted(sizes) for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["n"], room / r["bytes"])))])
    sample = known.where(F.pmod(F.xxhash64(F.col("id"), F.lit(SEED)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).toPandas()
    sample = sample.sort_values(["id", "text"], kind="stable")
    if sample.empty:
        return None
    return train(list(sample["text"]), list(sample["lang"]))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns of ``keep``, lang_pred, score, rejected) for every row of ``docs``."""
    kept = [c for c in keep if c not in ("id", "lang_pred", "score", "rejected")]
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def rows(texts: list[str | None]) -> list[list]:
        m = spread.value
        lang, score = [], []
        for text in texts:
            if m is None or not text or not any(c.isalpha() for c in text):
                lang.append(UNKNOWN)
                score.append(0.0)
                continue
            p = _softmax((_mean(text, m.logits) + m.bias) / m.temperature)
            lang.append(m.languages[int(p.argmax())])
            score.append(float(min(1.0, max(0.0, p.max()))))
        return [lang, score, [x == UNKNOWN or s < m.reject_below for x, s in zip(lang, score, strict=True)]]

    return added(docs, [F.col(id_col).alias("id"), *kept], text_col, "lang_pred string, score double, rejected boolean", rows)
