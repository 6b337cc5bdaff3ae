"""Helpers shared by the training-data operators: inputs, staged tables, Arrow batch bounds."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir

#: Bounds of one Arrow batch handed to a Python worker; a single longer row still travels whole.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; every other column is left behind, so none can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: a Python worker's memory must not depend on how long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, giving freed memory back to the system when a task's rows are done: a Python worker serves
    many tasks, and what the allocators keep would count against its executor."""
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)
    return wrapped


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _BLOCKS:
        _BLOCKS[-1].append((path, out))
    return out


_BLOCKS: list[list[tuple[str, DataFrame]]] = []


@contextlib.contextmanager
def staged_only() -> Iterator[Callable[[DataFrame], None]]:
    """Remove the tables that are staged inside the block, when it ends well, but for those given to the returned function."""
    kept: list[DataFrame] = []
    _BLOCKS.append([])
    try:
        yield kept.append
    finally:
        made = _BLOCKS.pop()
    unstage(*(path for path, table in made if not any(table is k for k in kept)), spark=made[0][1].sparkSession if made else None)


def unstage(*paths: str, spark: SparkSession | None) -> None:
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row runs of ``batch`` whose ``column`` holds about ``limit`` bytes at most (one row at least)."""
    n = batch.num_rows
    col = batch.column(batch.schema.get_field_index(column))
    lengths = [len(x) if x is not None else 0 for x in col.to_pylist()] if n else []
    at = size = 0
    for i, k in enumerate(lengths):
        if size and size + k > limit:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += k
    if at < n:
        yield batch.slice(at, n - at)


def one_of_each(rows: DataFrame, keys: DataFrame, on: list[str], but: Column | None = None) -> DataFrame:
    """The rows whose ``on`` columns are among ``keys``, one row of each (all those for which ``but`` holds).

    NULL matches NULL. The join and the numbering of repeated rows share one exchange of the rows, as both are keyed by the
    same plain columns.
    """
    plain: dict[str, Column] = {}
    for i, c in enumerate(on):
        kind = keys.schema[c].dataType
        plain |= {f"_on{i}": F.coalesce(F.col(c), F.lit(0 if kind.simpleString() == "bigint" else "").cast(kind)),
                  f"_null{i}": F.col(c).isNull()}
    held = rows.withColumns(plain).join(keys.select(*(c.alias(n) for n, c in plain.items())), list(plain), "left_semi")
    nth = F.row_number().over(W.partitionBy(*plain).orderBy(*plain))
    keep = F.col("_nth") == 1
    return held.withColumn("_nth", nth).where(keep if but is None else keep | but).drop("_nth", *plain)
