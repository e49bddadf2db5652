"""The corpus pipeline: language, line dedup, near dedup, secrets, packing.

Every stage works on all that its predecessor kept.  Stages but the last return
the columns of documents; where a stage changes a text, n_chars follows it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import language, line_dedup, near_dedup, packing, secrets
from driftwell.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects, or that have no letters, go."""
    model = language.fit(docs)
    judged = language.predict(docs, model, keep=("text", "lang", "source", "n_chars"))
    return judged.where(~F.col("rejected")).withColumnRenamed("id", "doc_id").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document left without words goes too."""
    out = line_dedup.dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    out = out.where(~changed | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    n = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", n.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id."""
    judged = near_dedup.near_duplicates(docs)
    gone = written(judged.where(~F.col("kept")).select("id").distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["id"], "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked out; their documents stay."""
    found = secrets.scan(docs, keep=("lang", "source", "n_chars"), with_text=True)
    changed = F.col("spans") != ""
    n = F.when(changed, F.char_length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return found.select(F.col("id").alias("doc_id"), F.col("redacted").alias("text"), "lang", "source", n.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("secret_scans", secret_scan),
    ("packing", pack),
]
#: The language model, the secret method and the packing aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
