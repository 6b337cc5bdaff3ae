"""The hourly status update as one plan (query lifecycle (1)).

The poll result is a DataFrame; mapping (J-08), error handling (J-09) and
the stuck sweep (J-07) are composed into one plan over the log and staged
once. Only the months that hold a changed row are rewritten (in one write,
moved in place), and the summary (A-17) comes from the staged copy, which is
removed at the end.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import joblog as jl
from tidemark.sources import io


def status_cycle(spark: SparkSession, log_path: str, snapshot: DataFrame, as_of: dt.datetime,
                 yearmonth: str | None = None, stuck_hours: float = 24) -> dict:
    log = io.read_merged(spark, log_path)
    scope = log.where(F.col("yearmonth") == yearmonth) if yearmonth else log
    with io.staged(jl.apply_status_snapshot(scope, snapshot, as_of)) as applied:
        stuck = jl.stuck(as_of, stuck_hours)
        polled = F.coalesce(F.col("poll_outcome").isin("updated", "retry", "gave_up"), F.lit(False))
        months = [r[0] for r in applied.where(polled | stuck).select("yearmonth").distinct().collect()]
        if months:  # one value per changed month
            swept = jl.fail_stuck(applied.where(F.col("yearmonth").isin(months)).drop("poll_outcome"), as_of, stuck_hours)
            held = io.with_folder(io.read_merged(spark, log_path)).where(F.col("yearmonth").isin(months))
            io.publish(spark, log_path, swept.select(*log.columns), ["yearmonth"], io.touched_folders(spark, log_path, held))
        summary = jl.poll_summary(applied)
        # a metric or a status per row
        summary = spark.createDataFrame(summary.collect(), summary.schema)
    return {"poll_summary": summary, "statistics": jl.status_statistics(io.read_merged(spark, log_path), yearmonth)}
