"""Shared helpers: what goes to the executors, columns beside the text, memory of Python workers, and word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.operators.tables import free, materialize, new_path, owned, shared_dir
from marlstone.shipping import ship_package

__all__ = ["free", "materialize", "new_path", "owned", "shared_dir"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Most rows and bytes of an Arrow batch: whole texts go to Python, so batches of rows alone would have no bound.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def _number(value: str) -> int:
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    v = value.lower().removesuffix("b")
    return int(v[:-1]) << units[v[-1]] if v and v[-1] in units else int(v or 0)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that tasks can import it wherever they run, and lowers the session's
    Arrow batches to BATCH where they are larger."""
    for key, most in BATCH.items():
        if not 0 < _number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))
    ship_package(spark)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null texts empty; other columns, whatever their names, play no part."""
    ship(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches of at most so many rows: what a task makes of whole texts is held for a slice at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def like(rows: DataFrame, more: str) -> T.StructType:
    """rows' doc_id, whatever its type, and the columns of a DDL string."""
    return T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *T._parse_datatype_string(more).fields])


def released(run: Callable) -> Callable:
    """A function over a task's batches, after which the Python worker, which goes on to other tasks, gives its free memory back."""

    def wrapped(batches: Iterator) -> Iterator:
        import pyarrow

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes not to be one of the columns'."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def beside(docs: DataFrame, text_col: str) -> Column:
    """All columns but the text as one struct whose fields go by position, so that no name clashes."""
    return F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col)).alias("rest")


def put_back(out: DataFrame, docs: DataFrame, text_col: str, more: Column, name: str) -> DataFrame:
    """The columns of docs from out's `rest` and `text`, and one more at the end."""
    return out.select(*(F.col("text" if c == text_col else f"rest.c{k}").alias(c) for k, c in enumerate(docs.columns)), more.alias(free_name(docs, name)))


def last(df: DataFrame) -> Column:
    return F.col(f"`{df.columns[-1]}`")


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)
