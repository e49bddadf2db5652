"""Structured Streaming into an operation log.

Each micro-batch is written to a folder of its batch id, which a repeated batch
overwrites, so the log holds every operation once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..schema import OP_LOG


def ingest(stream: DataFrame, folder: str, once: bool = True) -> StreamingQuery:
    """Starts writing ``stream`` (seq, key, value, op) to ``folder``; ``once``: until the input ends."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        batch.select(*OP_LOG.names).repartitionByRange("key", "value", "seq").sortWithinPartitions("key", "value", "seq").write.mode("overwrite").parquet(f"{folder}/ops/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(flush).option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(availableNow=True) if once else writer).start()


def into(stream: DataFrame, engine: Engine, progress: str, source: str = "stream", once: bool = True) -> StreamingQuery:
    """Starts taking ``stream`` (seq, key, value, op) into the engine, batch by batch.

    The number of the last batch taken stands in the manifest, which is written with each batch, so
    a batch that comes again after a failure, or after ``Engine.restore``, is taken once.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        if batch_id > engine.consumed.get(source, -1):
            engine.apply(batch.select(*OP_LOG.names))
            engine.consumed[source] = batch_id
            engine.persist()

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """All operations taken so far."""
    return spark.read.schema(OP_LOG).option("basePath", f"{folder}/ops").parquet(f"{folder}/ops")
