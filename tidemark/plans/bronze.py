"""Drifting partitions -> bronze table (T-10, T-11, P-01, A-28, A-29).

One scan per distinct schema, one write, and the verification (rows per
partition, nulls per column) computed from the *written* table in two
grouped queries instead of a count per partition and per column.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timefn import ts_lit
from tidemark.operators import drift as dr
from tidemark.operators import quality as qa
from tidemark.operators.merge import new_partitions
from tidemark.operators.repair import partition_counts
from tidemark.sources import io


def add_load_metadata(df: DataFrame, as_of: dt.datetime, source: str, version: str) -> DataFrame:
    """P-01: load time (a literal: the clock is a parameter), source file
    and pipeline version."""
    return df.withColumns({"_ingested_at": ts_lit(as_of), "_source_file": F.input_file_name(),
                           "_source_root": F.lit(source), "_pipeline_version": F.lit(version)})


def full_load(spark: SparkSession, source: str, partition_col: str, mapping: dict[str, T.DataType],
              target: str, as_of: dt.datetime, version: str = "1",
              formats: dict[str, str] | None = None, store: str | None = None) -> dict:
    """T-10: align every partition, validate, overwrite the target
    partitioned by ``partition_col``, verify from the written data.
    ``store`` keeps the schemas of known files between runs.

    Returns ``{"summary", "validation", "partitions", "nulls"}`` DataFrames."""
    # footers are read once; the small (file, column, type) table is staged
    # and shared by the failure list, the drift report and the load
    with io.staged(dr.file_schemas(spark, source, partition_col, store=store)) as schemas:
        failed = dr.failed_partitions(schemas, partition_col)
        failed = spark.createDataFrame(failed.collect(), failed.schema)   # one row per unreadable file
        report = dr.drift_report(schemas, partition_col)
        drifted = sorted({r["column_name"] for r in report.select("column_name").distinct().collect()})
        df = dr.load_aligned(spark, source, partition_col, mapping, formats, schemas=schemas)
    validation = dr.validate_target(df, mapping)
    io.overwrite(add_load_metadata(df, as_of, source, version), target, [partition_col])
    written = io.read_merged(spark, target)
    parts = partition_counts(written, partition_col)
    nulls = qa.null_profile(written, [c for c in mapping if c in written.columns])
    tot = parts.agg(F.count(F.lit(1)).alias("n"), F.sum("record_count").alias("rows")).first()
    n_failed = failed.select(partition_col).distinct().count()
    summary = dr.load_summary(spark, tot["n"], n_failed, int(tot["rows"] or 0), drifted)
    return {"summary": summary, "validation": validation, "partitions": parts, "nulls": nulls,
            "failed": failed}


def incremental_load(spark: SparkSession, source: str, partition_col: str, mapping: dict[str, T.DataType],
                     target: str, as_of: dt.datetime, version: str = "1",
                     formats: dict[str, str] | None = None, store: str | None = None) -> DataFrame:
    """T-11: load only partitions not yet in the target, aligned, with
    metadata, appended. Loaded values come from the target's folder names, as
    the source's do (S-05), so ``01`` and ``1`` are told apart and compared as
    spelled (D-19). Footers of other partitions are not opened. Returns the
    rows appended per partition."""
    todo = dr.partition_values(spark, source, partition_col)
    if io.path_exists(spark, target):
        todo = new_partitions(todo, dr.partition_values(spark, target, partition_col), partition_col)
    if todo.isEmpty():
        return spark.createDataFrame([], f"{partition_col} string, record_count long")
    df = dr.load_aligned(spark, source, partition_col, mapping, formats, only_partitions=todo, store=store)
    with io.staged(add_load_metadata(df, as_of, source, version)) as staged:
        counts = partition_counts(staged, partition_col)
        counts = spark.createDataFrame(counts.collect(), counts.schema)   # one row per new partition
        io.append(staged, target, [partition_col])
    return counts


def partition_status(parts: DataFrame, failed: DataFrame, partition_col: str) -> DataFrame:
    """A-29: records and status per partition: ``loaded`` with the count
    read back from the target, ``failed`` with 0 and the error text."""
    # partition values compare as strings (D-19): a read-back infers types
    parts = parts.withColumn(partition_col, F.col(partition_col).cast("string"))
    failed = failed.withColumn(partition_col, F.col(partition_col).cast("string"))
    ok = parts.select(partition_col, "record_count", F.lit("loaded").alias("status"),
                      F.lit(None).cast("string").alias("error"))
    bad = (failed.join(parts.select(partition_col), partition_col, "left_anti")
           .groupBy(partition_col).agg(F.min("error").alias("error"))
           .select(partition_col, F.lit(0).cast("long").alias("record_count"), F.lit("failed").alias("status"),
                   "error"))
    return ok.unionByName(bad)
