"""Safe slice replacement and month backfill (Q-09, Q-12, W-02 persisted).

Order of work, each step a Spark job over the slice only:
backup (written copy, counted) -> stage the new slice (written once, so the
gate, the write and the recount all read the same rows, D-14) -> one-pass
gate -> replace-where write -> recount from the target -> optional
compaction. The backup is made before anything can fail, so a restore
pointer always exists (D-13).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality as qa
from tidemark.operators.repair import dedup_slice, in_range, rollup
from tidemark.sources import io


@dataclass
class ReplaceResult:
    backup_path: str
    backup_rows: int
    new_rows: int
    written_rows: int
    checks: list[str]


class ReplaceFailed(RuntimeError):
    def __init__(self, msg: str, backup_path: str):
        super().__init__(f"{msg} (restore from {backup_path})")
        self.backup_path = backup_path


def safe_replace(spark: SparkSession, path: str, new: DataFrame, pred: Column, partition_by: list[str],
                 critical: list[str], tolerance_pct: float = 20.0, backup_suffix: str | None = None,
                 compact_keys: list[str] | None = None) -> ReplaceResult:
    """Q-09: replace the slice ``pred`` of the table at ``path`` with ``new``."""
    current = io.read_merged(spark, path)
    inside = F.coalesce(pred, F.lit(False))
    backup_path, backup_rows = io.create_backup(spark, current, pred, path, backup_suffix)
    try:
        with io.staged_and_counted(new) as (staged, expected):
            checks = qa.raise_on_failure(qa.replacement_gate(current.where(inside), staged, critical, tolerance_pct))
            io.write_replace_where(spark, path, staged, pred, partition_by)
            written = io.read_merged(spark, path).where(inside).count()
        if written != expected:
            raise ValueError(f"post-replacement verification failed: {written} != {expected}")
        if compact_keys:
            io.compact(spark, path, pred, partition_by, compact_keys)  # counts whole partitions itself
        return ReplaceResult(backup_path, backup_rows, expected, written, checks)
    except Exception as e:
        raise ReplaceFailed(str(e), backup_path) from e


def dedup_and_replace(spark: SparkSession, path: str, date_col: str, start, end, keys: list[str],
                      order: list[Column], partition_by: list[str], tolerance_pct: float = 60.0) -> ReplaceResult:
    """W-02 persisted: dedup the slice, require rows after = distinct keys
    before, then Q-09. A dedup legitimately shrinks a slice (2x duplicates =
    -50 %), so the tolerance is a parameter (D-13)."""
    table = io.read_merged(spark, path)
    deduped, proof = dedup_slice(table, date_col, start, end, keys, order)
    p = proof.collect()[0]
    if not p["ok"]:
        raise ValueError(f"deduplication proof failed: {p.asDict()}")
    return safe_replace(spark, path, deduped, in_range(date_col, start, end), partition_by, keys + [date_col],
                        tolerance_pct)


def backfill_month(spark: SparkSession, bronze: DataFrame, silver_path: str, date_col: str,
                   year: int, month: int, keys: list[str], aggs: list[Column], partition_by: list[str],
                   tolerance_pct: float = 50.0, require_complete: bool = True) -> ReplaceResult:
    """Q-12: completeness of the bronze month (Q-07) -> rollup (A-27) -> Q-09."""
    start = dt.date(year, month, 1)
    end = (dt.date(year + (month == 12), month % 12 + 1, 1) - dt.timedelta(days=1))
    comp = qa.day_completeness(bronze, date_col, start.isoformat(), end.isoformat()).collect()[0]
    if require_complete and not comp["complete"]:
        raise ValueError(f"bronze incomplete: {comp['distinct_days']}/{comp['expected_days']} days")
    new = rollup(bronze, keys, date_col, start.isoformat(), end.isoformat(), aggs)
    return safe_replace(spark, silver_path, new, in_range(date_col, start.isoformat(), end.isoformat()),
                        partition_by, keys + [date_col], tolerance_pct)
