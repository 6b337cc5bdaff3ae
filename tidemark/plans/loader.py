"""Daily incremental loading (I-01..I-04, S-21, A-30).

Sources are ``year=/month=/day=`` layouts; the partition date is the
watermark. Every table load is independent: a failure is recorded in the
result frame and the other tables still load (S-21). Clock and limits are
parameters.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.repair import latest_per_key
from tidemark.sources import io

RESULT_SCHEMA = ("table_name string, partition_loaded string, status string, rows long, "
                 "columns int, error string")
LOG_SCHEMA = ("job_run_id string, run_date date, partition_loaded string, tables_processed int, "
              "rows_loaded long, run_timestamp timestamp_ntz")
DAY_COLS = ["year", "month", "day"]


@dataclass
class TableLoad:
    """One entry of the load configuration."""
    source: str
    target: str
    mode: str = "append"                       # "append" or "upsert"
    merge_keys: list[str] = field(default_factory=list)
    partition_by: list[str] = field(default_factory=lambda: list(DAY_COLS))
    order_by: list[str] = field(default_factory=list)   # newest-first tie-break inside a key
    merge_within_partitions: bool = False                # keys never move between partitions
    version: list[str] = field(default_factory=list)     # upsert only rows that are not older by these columns
    name: str | None = None

    @property
    def table_name(self) -> str:
        return self.name or self.target.rstrip("/").rsplit("/", 1)[-1]


def day_partition(day: dt.date) -> str:
    """F-07: ``year=YYYY/month=MM/day=DD``."""
    return f"year={day.year}/month={day.month:02d}/day={day.day:02d}"


def _result(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def _apply(spark: SparkSession, cfg: TableLoad, df: DataFrame, newest_first: bool = False) -> int:
    if cfg.mode == "append":
        return io.append(df, cfg.target, cfg.partition_by)
    if cfg.mode != "upsert":
        raise ValueError(f"unknown mode {cfg.mode}")
    src = df
    if newest_first:
        # several days in one batch: the newest partition wins per key (W-01)
        order = [F.make_date("year", "month", "day").desc()] + [F.col(c).desc() for c in cfg.order_by]
        src = latest_per_key(df, cfg.merge_keys, order)
    # The upsert reads its source for the touched partitions, the key check
    # and the union: stage it once in the shared folder.
    with io.staged_and_counted(src) as (src, rows):
        io.write_upsert(spark, cfg.target, src, cfg.merge_keys, cfg.partition_by, cfg.merge_within_partitions,
                        version=cfg.version or None)
        return rows


def load_day(spark: SparkSession, tables: list[TableLoad], day: dt.date) -> DataFrame:
    """I-01: load one day's partition of every table, append or upsert."""
    out = []
    for cfg in tables:
        part = day_partition(day)
        try:
            df = io.read_day(spark, cfg.source, day)
            if df is None:
                out.append((cfg.table_name, part, "skipped", 0, None, "partition missing or empty"))
                continue
            n = _apply(spark, cfg, df)
            out.append((cfg.table_name, part, "ok", n, len(df.columns), None))
        except Exception as e:  # one table failing does not stop the others
            out.append((cfg.table_name, part, "failed", 0, None, f"{type(e).__name__}: {e}"))
    return _result(spark, out)


def load_daily(spark: SparkSession, tables: list[TableLoad], as_of: dt.datetime) -> DataFrame:
    """I-01: yesterday's partition relative to ``as_of``."""
    return load_day(spark, tables, (as_of - dt.timedelta(days=1)).date())


def load_range(spark: SparkSession, tables: list[TableLoad], start: dt.date, end: dt.date) -> DataFrame:
    """I-02: backfill an inclusive day range with one scan per table; the
    table's mode is honoured: upsert tables merge (newest day wins, D-11),
    append tables have the range's days replaced, so a second run adds
    nothing. A source without rows in the range is skipped."""
    out = []
    label = f"{day_partition(start)}..{day_partition(end)}"
    for cfg in tables:
        try:
            df = io.read_days(spark, cfg.source, start, end)
            if df is None:
                out.append((cfg.table_name, label, "skipped", 0, None, "no data in the range"))
                continue
            if cfg.mode == "append" and io.path_exists(spark, cfg.target):
                days = F.make_date("year", "month", "day").between(F.lit(start.isoformat()).cast("date"),
                                                                   F.lit(end.isoformat()).cast("date"))
                io.write_replace_where(spark, cfg.target, df, days, cfg.partition_by)
                n = df.count()
            else:
                n = _apply(spark, cfg, df, newest_first=True)
            out.append((cfg.table_name, label, "ok", n, len(df.columns), None))
        except Exception as e:
            out.append((cfg.table_name, label, "failed", 0, None, f"{type(e).__name__}: {e}"))
    return _result(spark, out)


def load_with_lookback(spark: SparkSession, tables: list[TableLoad], as_of: dt.datetime,
                       lookback_days: int = 3) -> DataFrame:
    """I-03: re-upsert the last ``lookback_days`` days (upsert tables only) in
    one scan; for a key seen on several days the newest day wins."""
    end = (as_of - dt.timedelta(days=1)).date()
    start = (as_of - dt.timedelta(days=lookback_days)).date()
    return load_range(spark, [t for t in tables if t.mode == "upsert"], start, end)


def load_today(spark: SparkSession, tables: list[TableLoad], as_of: dt.datetime,
               date_col: str | None = None) -> DataFrame:
    """I-04: intraday refresh of today's partition. Append tables replace
    today's rows (delete + re-append as one replace-where); upsert tables
    merge."""
    day = as_of.date()
    out = []
    for cfg in tables:
        part = day_partition(day)
        try:
            df = io.read_day(spark, cfg.source, day)
            if df is None:
                out.append((cfg.table_name, part, "skipped", 0, None, "no data yet"))
                continue
            if cfg.mode == "append":
                pred = (F.make_date("year", "month", "day") == F.lit(day.isoformat()).cast("date")) \
                    if date_col is None else (F.to_date(date_col) == F.lit(day.isoformat()).cast("date"))
                if io.path_exists(spark, cfg.target):
                    n = io.write_replace_where(spark, cfg.target, df, pred, cfg.partition_by)
                else:
                    n = io.append(df, cfg.target, cfg.partition_by)
            else:
                n = _apply(spark, cfg, df)
            out.append((cfg.table_name, part, "ok", n, len(df.columns), None))
        except Exception as e:
            out.append((cfg.table_name, part, "failed", 0, None, f"{type(e).__name__}: {e}"))
    return _result(spark, out)


def log_execution(spark: SparkSession, log_path: str, job_run_id: str, run_date: dt.date,
                  partition_loaded: str, tables_processed: int, run_timestamp: dt.datetime,
                  rows_loaded: int | None = None) -> DataFrame:
    """A-30: append one load-log row with an explicit schema."""
    row = spark.createDataFrame([(job_run_id, run_date, partition_loaded, tables_processed, rows_loaded,
                                  run_timestamp)], LOG_SCHEMA)
    row.write.mode("append").parquet(log_path)
    return row


@dataclass
class IngestSpec:
    """S-21: one entry of a many-table ingest: a source file and a target."""
    source: str
    fmt: str
    target: str
    options: dict = field(default_factory=dict)
    query: str | None = None   # optional SQL over ``{view}`` (P-15)
    if_exists: str = "replace"


def run_query(df: DataFrame, query: str, args: dict | None = None) -> DataFrame:
    """P-15: user SQL over one DataFrame, bound as ``{view}``; values go in
    as named parameters, never by text substitution (D-1, D-15)."""
    return df.sparkSession.sql(query, args=args or {}, view=df)


def batch_ingest(spark: SparkSession, specs: list[IngestSpec]) -> DataFrame:
    """S-21: run every spec; one result row each (table, status, rows,
    columns, error); failures do not stop the batch."""
    out = []
    for s in specs:
        name = s.target.rstrip("/").rsplit("/", 1)[-1]
        try:
            df = io.read_source(spark, s.source, s.fmt, s.options)
            if s.query:
                df = run_query(df, s.query)
            io.export_table(df, s.target, s.if_exists)
            written = spark.read.parquet(s.target)
            out.append((name, s.source, "success", written.count(), len(written.columns), None))
        except Exception as e:
            out.append((name, s.source, "failed", 0, None, f"{type(e).__name__}: {e}"))
    return _result(spark, out).withColumnRenamed("partition_loaded", "source")
