"""What the operators of this package share: tables, text expressions, shared storage."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import partitions_for, shared_folder, written

__all__ = ["added", "ascii_lower", "joined_by_size", "partitions_for", "shared_folder", "ship", "table", "tokenizer_path", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of word and line keys: x20 and x09-x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the fast ``lower``."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def joined_by_size(many: DataFrame, sized: DataFrame, on: list[str], size: str, rows: int, each: int = 1 << 20) -> DataFrame:
    """``many`` joined with ``sized``, one row for each key with ``size``, the rows of ``many`` that have it.

    Keys of so many rows that they would fill a quarter of a task are sent to the rows (at most
    four for each partition); the others are joined by exchange.
    """
    limit = rows // (4 * partitions_for(many.sparkSession, rows, each))
    hot = F.broadcast(sized.where(F.col(size) > limit))
    few = many.join(F.broadcast(sized.where(F.col(size) > limit).select(*on)), on, "left_anti").join(sized.where(F.col(size) <= limit), on)
    return many.join(hot, on).unionByName(few)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, whatever their import path."""
    context = spark.sparkContext
    if getattr(context, "_driftwell_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="driftwell-code-")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    file = os.path.join(folder, "driftwell_code.zip")
    Path(file).write_bytes(held.getvalue())
    context.addPyFile(file)
    context._driftwell_shipped = True


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; DRIFTWELL_TOKENIZERS names another folder."""
    folder = os.environ.get("DRIFTWELL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts that Python takes at once, which bounds its memory.
ROWS = 1000


def added(df: DataFrame, keep: list[Column | str], text_col: str, made: str, fn, many: bool = False, end: Callable[[], None] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` and the columns ``made`` (DDL) that ``fn`` makes of each text.

    ``fn`` gets the texts of an Arrow batch, None where null, and returns a list of
    values for each column of ``made``.  With ``many`` it first returns a list of row
    numbers, one for each row of the result.  Kept columns stay in Arrow as they are.
    ``end`` is called when a task is done, as its worker lives on.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    ship(df.sparkSession)
    source = df.select(*keep, F.col(text_col).alias("__text"))
    kept = source.schema.fields[:-1]
    schema = StructType(kept + _parse_datatype_string(made).fields)
    arrow = to_arrow_schema(schema)
    n = len(kept)

    def run(batches):
        for b in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
            texts = b.column(n).to_pylist()
            found = fn(texts)
            held = [b.column(i) for i in range(n)]
            if many:
                at = pa.array(found[0], type=pa.int64())
                held, found = [c.take(at) for c in held], found[1:]
            held = [c if c.type == arrow.field(i).type else c.cast(arrow.field(i).type) for i, c in enumerate(held)]
            yield pa.RecordBatch.from_arrays(held + [pa.array(c, type=arrow.field(n + i).type) for i, c in enumerate(found)], schema=arrow)
        if end is not None:
            end()
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)
