"""Job-log queries: lookups (P-03..P-16), mutations (J-01, J-05..J-09) and
statistics (A-01..A-17) over the ``batch_log`` fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import register
from suite.fixtures import AS_OF, AS_OF_SQL, batch_log, status_snapshot, with_views
from tidemark.operators import joblog as jl
from tidemark.sources.tables import read_table

MONTH = "200107"


def hours_sql(a: str, b: str) -> str:
    """SQL twin of ``hours_between``: whole seconds, as DOUBLE hours."""
    return f"(CAST(floor(epoch({b})) - floor(epoch({a})) AS DOUBLE) / 3600.0)"


LOG_COLS = [f.name for f in jl.LOG_SCHEMA.fields if f.name not in ("job_name", "job_run_id", "created_date")]
LOG_STAR = ", ".join(LOG_COLS)


def _log(spark, d):
    return batch_log(spark, d)


def L(sql: str, *extra: str) -> str:
    return with_views(sql, "batch_log", *extra)


register("p03_non_terminal", L(f"SELECT {LOG_STAR} FROM batch_log "
                               "WHERE batch_status IN ('PENDING','PROCESSING') ORDER BY created_at, batch_id"))(
    lambda spark, d: jl.non_terminal(_log(spark, d)))

register("p04_batch_by_id", L(f"SELECT {LOG_STAR} FROM batch_log WHERE batch_id = 'b4242'"))(
    lambda spark, d: jl.batch_by_id(_log(spark, d), "b4242"))

register("p05_stuck_batches", L(
    f"SELECT {LOG_STAR} FROM batch_log WHERE batch_status IN ('PENDING','PROCESSING') "
    f"AND updated_at < {AS_OF_SQL} - INTERVAL 24 HOUR ORDER BY updated_at, batch_id"))(
    lambda spark, d: jl.stuck_batches(_log(spark, d), AS_OF, 24))

register("p06_failed_for_resubmit", L(
    f"SELECT {LOG_STAR} FROM batch_log WHERE batch_status = 'FAILED' AND yearmonth = '{MONTH}'"))(
    lambda spark, d: jl.failed_for_resubmit(_log(spark, d), MONTH))


def _retry_ids(spark, d):
    log = _log(spark, d)
    known = log.where(F.col("error_message").isNotNull()).select("batch_id")
    unknown = read_table(spark, d, "supplier").select(
        F.concat(F.lit("missing-"), F.col("s_suppkey").cast("string")).alias("batch_id"))
    return log, known.unionByName(unknown)


@register("p12_retry_eligibility", L(
    "SELECT i.batch_id, COALESCE(l.retry_count < l.max_retries, false) AS should_retry FROM "
    "(SELECT DISTINCT batch_id FROM (SELECT batch_id FROM batch_log WHERE error_message IS NOT NULL "
    " UNION ALL SELECT CONCAT('missing-', CAST(s_suppkey AS VARCHAR)) FROM supplier)) i "
    "LEFT JOIN batch_log l ON i.batch_id = l.batch_id"))
def p12(spark, d):
    log, ids = _retry_ids(spark, d)
    return jl.retry_eligibility(log, ids)


P13_SQL = L(
    "SELECT batch_id, jsonl_file_path, batch_status, total_prompts, completed_prompts, failed_prompts, "
    "model_id, output_s3_uri, yearmonth, CAST(submitted_at AS DATE) AS submission_date, "
    "CAST(completed_at AS DATE) AS completion_date, "
    f"round({hours_sql('submitted_at', 'completed_at')}, 2) AS processing_hours "
    "FROM batch_log WHERE batch_status IN ('COMPLETED','FAILED') ORDER BY completed_at DESC, batch_id")
register("p13_results_export", P13_SQL)(
    lambda spark, d: jl.results_export(_log(spark, d)))


def _part_rule(year, month, i):
    return F.concat(F.lit("in/part-"), i.cast("string"), F.lit(".jsonl"))


@register("p16_unsubmitted_files", L(
    "SELECT m.yearmonth, CAST(f.file_no AS BIGINT) AS file_no, "
    "CONCAT('in/part-', CAST(f.file_no AS VARCHAR), '.jsonl') AS jsonl_file_path "
    "FROM (SELECT DISTINCT yearmonth FROM batch_log) m, "
    "(SELECT unnest(range(0, 100)) AS file_no) f "
    "WHERE NOT EXISTS (SELECT 1 FROM batch_log l WHERE l.yearmonth = m.yearmonth "
    "AND l.jsonl_file_path = CONCAT('in/part-', CAST(f.file_no AS VARCHAR), '.jsonl'))"))
def p16(spark, d):
    log = _log(spark, d)
    exp = jl.expected_batch_files(log, 100, _part_rule, start=0)
    return jl.unsubmitted_files(exp, log).withColumn("file_no", F.col("file_no").cast("bigint"))


# ---------------------------------------------------------------- mutations

J01_UPDATES_SQL = ("SELECT batch_id, 'COMPLETED' AS new_status, total_prompts AS completed_prompts, "
                   "CONCAT('store://out/', batch_id) AS output_s3_uri FROM batch_log "
                   "WHERE batch_status = 'PROCESSING'")


def _j01_updates(log):
    return log.where(F.col("batch_status") == "PROCESSING").select(
        "batch_id", F.lit("COMPLETED").alias("new_status"),
        F.col("total_prompts").alias("completed_prompts"),
        F.concat(F.lit("store://out/"), F.col("batch_id")).alias("output_s3_uri"))


def _log_select(over: dict) -> str:
    return ", ".join(f"{over[c]} AS {c}" if c in over else f"l.{c}" for c in LOG_COLS)


J01_SQL = L(
    f"WITH u AS ({J01_UPDATES_SQL}) SELECT " + _log_select({
        "batch_status": "CASE WHEN u.batch_id IS NOT NULL THEN u.new_status ELSE l.batch_status END",
        "updated_at": f"CASE WHEN u.batch_id IS NOT NULL THEN {AS_OF_SQL} ELSE l.updated_at END",
        "completed_at": f"CASE WHEN u.batch_id IS NOT NULL AND u.new_status IN "
                        f"('COMPLETED','FAILED','EXPIRED','CANCELLED') THEN {AS_OF_SQL} ELSE l.completed_at END",
        "completed_prompts": "COALESCE(u.completed_prompts, l.completed_prompts)",
        "output_s3_uri": "COALESCE(u.output_s3_uri, l.output_s3_uri)",
    }) + " FROM batch_log l LEFT JOIN u ON l.batch_id = u.batch_id")


@register("j01_update_status", J01_SQL)
def j01(spark, d):
    log = _log(spark, d)
    return jl.update_status(log, _j01_updates(log), AS_OF)


RET_PRED = ("(completed_at < TIMESTAMP '2001-05-04 00:00:00' "
            "AND batch_status IN ('COMPLETED','FAILED','CANCELLED'))")

register("j05_retention_removed", L(f"SELECT {LOG_STAR} FROM batch_log WHERE {RET_PRED}"))(
    lambda spark, d: jl.retention_split(_log(spark, d), AS_OF, 90)[1])

register("j05_retention_kept", L(f"SELECT {LOG_STAR} FROM batch_log WHERE NOT COALESCE({RET_PRED}, false)"))(
    lambda spark, d: jl.retention_split(_log(spark, d), AS_OF, 90)[0])


@register("j06_increment_retry", L(
    "WITH ids AS (SELECT DISTINCT batch_id FROM status_snapshot WHERE poll_error IS NOT NULL) SELECT "
    + _log_select({"retry_count": "CASE WHEN i.batch_id IS NOT NULL THEN l.retry_count + 1 ELSE l.retry_count END",
                   "updated_at": f"CASE WHEN i.batch_id IS NOT NULL THEN {AS_OF_SQL} ELSE l.updated_at END"})
    + " FROM batch_log l LEFT JOIN ids i ON l.batch_id = i.batch_id", "status_snapshot"))
def j06(spark, d):
    log = _log(spark, d)
    ids = status_snapshot(spark, d).where(F.col("poll_error").isNotNull()).select("batch_id")
    return jl.increment_retry(log, ids, AS_OF)


STUCK_SQL = (f"(batch_status IN ('PENDING','PROCESSING') AND updated_at < {AS_OF_SQL} - INTERVAL 24 HOUR)")

register("j07_fail_stuck", L("SELECT " + _log_select({
    "batch_status": f"CASE WHEN {STUCK_SQL} THEN 'FAILED' ELSE batch_status END",
    "error_message": f"CASE WHEN {STUCK_SQL} THEN CONCAT('Batch stuck in ', batch_status, "
                     f"' status for over 24 hours') ELSE error_message END",
    "updated_at": f"CASE WHEN {STUCK_SQL} THEN {AS_OF_SQL} ELSE updated_at END",
    "completed_at": f"CASE WHEN {STUCK_SQL} THEN {AS_OF_SQL} ELSE completed_at END",
}).replace("l.", "") + " FROM batch_log"))(
    lambda spark, d: jl.fail_stuck(_log(spark, d), AS_OF, 24))

_MAP_SQL = ("CASE s.source_status WHEN 'InProgress' THEN 'PROCESSING' WHEN 'Completed' THEN 'COMPLETED' "
            "WHEN 'Failed' THEN 'FAILED' WHEN 'Stopping' THEN 'PROCESSING' WHEN 'Stopped' THEN 'CANCELLED' "
            "WHEN 'Submitted' THEN 'PENDING' WHEN 'Validating' THEN 'PENDING' ELSE s.source_status END")

SNAPSHOT_APPLY_SQL = (
    "WITH j AS (SELECT l.*, s.batch_id IS NOT NULL AS hit, s.poll_error, " + _MAP_SQL + " AS mapped "
    "FROM batch_log l LEFT JOIN status_snapshot s ON l.batch_id = s.batch_id), "
    "k AS (SELECT *, hit AND poll_error IS NOT NULL AS err, "
    "  hit AND poll_error IS NULL AND mapped IS NOT NULL AND mapped <> batch_status AS changed, "
    "  retry_count < max_retries AS can_retry FROM j), "
    "m AS (SELECT *, err AND NOT can_retry AS give_up, "
    "  CASE WHEN changed THEN mapped WHEN err AND NOT can_retry THEN 'FAILED' ELSE batch_status END AS new_status "
    "  FROM k) SELECT " + ", ".join({
        "batch_status": "new_status AS batch_status",
        "updated_at": f"CASE WHEN changed OR err THEN {AS_OF_SQL} ELSE updated_at END AS updated_at",
        "completed_at": f"CASE WHEN (changed OR give_up) AND new_status IN "
                        f"('COMPLETED','FAILED','EXPIRED','CANCELLED') THEN {AS_OF_SQL} ELSE completed_at END "
                        f"AS completed_at",
        "retry_count": "CASE WHEN err AND can_retry THEN retry_count + 1 ELSE retry_count END AS retry_count",
        "error_message": "CASE WHEN give_up THEN CONCAT('Max retries exceeded. Last error: ', poll_error) "
                         "ELSE error_message END AS error_message",
    }.get(c, c) for c in LOG_COLS) +
    ", CASE WHEN NOT hit THEN NULL WHEN err AND can_retry THEN 'retry' WHEN give_up THEN 'gave_up' "
    "WHEN changed THEN 'updated' ELSE 'unchanged' END AS poll_outcome FROM m")


def _applied(spark, d):
    return jl.apply_status_snapshot(_log(spark, d), status_snapshot(spark, d), AS_OF)


register("j08_apply_status_snapshot", L(SNAPSHOT_APPLY_SQL, "status_snapshot"))(_applied)

register("a17_poll_summary", L(
    "WITH applied AS (" + SNAPSHOT_APPLY_SQL + ") "
    "SELECT 'checked' AS metric, CAST(NULL AS VARCHAR) AS status, "
    "  CAST(count(*) FILTER (WHERE poll_outcome IN ('updated','unchanged')) AS BIGINT) AS value FROM applied "
    "UNION ALL SELECT 'updated', NULL, CAST(count(*) FILTER (WHERE poll_outcome = 'updated') AS BIGINT) FROM applied "
    "UNION ALL SELECT 'errors', NULL, CAST(count(*) FILTER (WHERE poll_outcome IN ('retry','gave_up')) AS BIGINT) "
    "  FROM applied "
    "UNION ALL SELECT 'updated_by_status', batch_status, CAST(count(*) AS BIGINT) FROM applied "
    "  WHERE poll_outcome = 'updated' GROUP BY batch_status", "status_snapshot"))(
    lambda spark, d: jl.poll_summary(_applied(spark, d)))


# --------------------------------------------------------------- statistics

register("a01_status_statistics", L(
    "SELECT batch_status, COUNT(*) AS count, CAST(SUM(total_prompts) AS BIGINT) AS total_prompts, "
    "CAST(SUM(completed_prompts) AS BIGINT) AS completed_prompts, "
    "CAST(SUM(failed_prompts) AS BIGINT) AS failed_prompts, AVG(retry_count) AS avg_retry_count "
    "FROM batch_log GROUP BY batch_status ORDER BY batch_status"))(
    lambda spark, d: jl.status_statistics(_log(spark, d)))

register("a01_status_statistics_month", L(
    "SELECT batch_status, COUNT(*) AS count, CAST(SUM(total_prompts) AS BIGINT) AS total_prompts, "
    "CAST(SUM(completed_prompts) AS BIGINT) AS completed_prompts, "
    "CAST(SUM(failed_prompts) AS BIGINT) AS failed_prompts, AVG(retry_count) AS avg_retry_count "
    f"FROM batch_log WHERE yearmonth = '{MONTH}' GROUP BY batch_status ORDER BY batch_status"))(
    lambda spark, d: jl.status_statistics(_log(spark, d), MONTH))


def _rate_sql(status, name):
    return (f"SELECT CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE batch_status = '{status}') "
            f"* CAST(100 AS DOUBLE) / COUNT(*) ELSE 0.0 END AS {name} FROM batch_log")


register("a02_completion_rate", L(_rate_sql("COMPLETED", "completion_rate")))(
    lambda spark, d: jl.completion_rate(_log(spark, d)))
register("a03_failure_rate", L(_rate_sql("FAILED", "failure_rate")))(
    lambda spark, d: jl.failure_rate(_log(spark, d)))

register("a04_avg_processing_hours", L(
    f"SELECT AVG({hours_sql('submitted_at', 'completed_at')}) AS avg_hours FROM batch_log "
    "WHERE completed_at IS NOT NULL AND submitted_at IS NOT NULL AND batch_status = 'COMPLETED'"))(
    lambda spark, d: jl.average_processing_hours(_log(spark, d)))

_AGE = "date_diff('day', CAST(created_at AS DATE), DATE '2001-08-02')"
register("a05_batches_by_age", L(
    f"SELECT age_category, COUNT(*) AS count, CASE age_category WHEN 'Today' THEN 1 WHEN 'Yesterday' THEN 2 "
    "WHEN 'This Week' THEN 3 WHEN 'This Month' THEN 4 ELSE 5 END AS sort_key FROM ("
    f"SELECT CASE WHEN {_AGE} = 0 THEN 'Today' WHEN {_AGE} = 1 THEN 'Yesterday' WHEN {_AGE} <= 7 THEN 'This Week' "
    f"WHEN {_AGE} <= 30 THEN 'This Month' ELSE 'Older' END AS age_category FROM batch_log) "
    "GROUP BY age_category ORDER BY sort_key"))(
    lambda spark, d: jl.batches_by_age(_log(spark, d), AS_OF))

register("a06_daily_submissions", L(
    "SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS batches_submitted, "
    "CAST(SUM(total_prompts) AS BIGINT) AS total_prompts FROM batch_log "
    "WHERE created_at >= TIMESTAMP '2001-07-03 00:00:00' GROUP BY 1 ORDER BY 1"))(
    lambda spark, d: jl.daily_submissions(_log(spark, d), AS_OF, 30))

register("a07_error_summary", L(
    "SELECT error_message, COUNT(*) AS occurrence_count, MAX(updated_at) AS last_occurrence "
    "FROM batch_log WHERE error_message IS NOT NULL GROUP BY error_message "
    "ORDER BY occurrence_count DESC, error_message LIMIT 10"))(
    lambda spark, d: jl.error_summary(_log(spark, d), 10))

register("a08_active_batches", L(
    "SELECT batch_status, COUNT(*) AS count, CAST(SUM(total_prompts) AS BIGINT) AS total_prompts, "
    "CAST(SUM(completed_prompts) AS BIGINT) AS completed_prompts, round(AVG(retry_count), 2) AS avg_retries "
    "FROM batch_log WHERE batch_status IN ('PENDING','PROCESSING') GROUP BY batch_status"))(
    lambda spark, d: jl.active_batches(_log(spark, d)))

register("a09_completion_trend", L(
    "SELECT CAST(completed_at AS DATE) AS date, COUNT(*) AS batches_completed, "
    "CAST(SUM(total_prompts) AS BIGINT) AS prompts_processed, "
    f"AVG({hours_sql('submitted_at', 'completed_at')}) AS avg_hours FROM batch_log "
    "WHERE completed_at >= TIMESTAMP '2001-07-03 00:00:00' AND batch_status = 'COMPLETED' "
    "GROUP BY 1 ORDER BY 1"))(
    lambda spark, d: jl.completion_trend(_log(spark, d), AS_OF, 30))

register("a10_failure_analysis", L(
    "WITH f AS (SELECT * FROM batch_log WHERE batch_status = 'FAILED' AND error_message IS NOT NULL), "
    "h AS (SELECT error_message, COUNT(*) AS count, MAX(updated_at) AS last_occurrence FROM f "
    "GROUP BY error_message ORDER BY count DESC, error_message LIMIT 20) "
    "SELECT h.error_message, f.batch_id AS affected_batch, h.count, h.last_occurrence "
    "FROM f JOIN h ON f.error_message = h.error_message"))(
    lambda spark, d: jl.failure_analysis(_log(spark, d), 20))

register("a11_efficiency_by_model", L(
    "SELECT model_id, COUNT(*) AS total_batches, COUNT(*) FILTER (WHERE batch_status = 'COMPLETED') AS completed, "
    "COUNT(*) FILTER (WHERE batch_status = 'FAILED') AS failed, "
    f"round(AVG(CASE WHEN batch_status = 'COMPLETED' THEN {hours_sql('submitted_at', 'completed_at')} END), 2) "
    "AS avg_completion_hours, round(AVG(retry_count), 2) AS avg_retries FROM batch_log GROUP BY model_id"))(
    lambda spark, d: jl.efficiency_by_model(_log(spark, d)))

register("a12_stuck_alert", L(
    "SELECT batch_id, batch_status, jsonl_file_path, created_at, updated_at, "
    f"round({hours_sql('updated_at', AS_OF_SQL)}, 1) AS hours_stuck, retry_count FROM batch_log "
    f"WHERE {STUCK_SQL} ORDER BY updated_at, batch_id"))(
    lambda spark, d: jl.stuck_alert(_log(spark, d), AS_OF, 24))

register("a13_monthly_summary", L(
    "SELECT yearmonth, COUNT(*) AS total_batches, COUNT(*) FILTER (WHERE batch_status = 'COMPLETED') AS completed, "
    "COUNT(*) FILTER (WHERE batch_status = 'FAILED') AS failed, "
    "COUNT(*) FILTER (WHERE batch_status IN ('PENDING','PROCESSING')) AS in_progress, "
    "CAST(SUM(total_prompts) AS BIGINT) AS total_prompts, CAST(SUM(completed_prompts) AS BIGINT) AS "
    "completed_prompts, MIN(created_at) AS first_batch_date, MAX(updated_at) AS last_update_date "
    "FROM batch_log GROUP BY yearmonth ORDER BY yearmonth DESC"))(
    lambda spark, d: jl.monthly_summary(_log(spark, d)))

register("a14_system_health", L(
    "SELECT *, stuck_batches = 0 AND failed < completed * 0.05 AS is_healthy FROM ("
    f"SELECT COUNT(*) FILTER (WHERE {STUCK_SQL}) AS stuck_batches, "
    "COUNT(*) FILTER (WHERE batch_status = 'PENDING') AS pending, "
    "COUNT(*) FILTER (WHERE batch_status = 'PROCESSING') AS processing, "
    "COUNT(*) FILTER (WHERE batch_status = 'FAILED') AS failed, "
    "COUNT(*) FILTER (WHERE batch_status = 'COMPLETED') AS completed FROM batch_log)"))(
    lambda spark, d: jl.system_health(_log(spark, d), AS_OF))

register("a15_month_dashboard", L(
    f"SELECT '{MONTH}' AS yearmonth, COUNT(*) AS total_batches, CASE WHEN COUNT(*) > 0 THEN "
    "COUNT(*) FILTER (WHERE batch_status = 'COMPLETED') * CAST(100 AS DOUBLE) / COUNT(*) ELSE 0.0 END "
    f"AS progress_pct, COUNT(*) FILTER (WHERE {STUCK_SQL}) AS stuck_count FROM batch_log "
    f"WHERE yearmonth = '{MONTH}'"))(
    lambda spark, d: jl.month_dashboard(_log(spark, d), AS_OF, MONTH))

_REPORT_SQL = (
    "WITH o AS (SELECT COUNT(*) AS total_batches, CAST(SUM(total_prompts) AS BIGINT) AS total_prompts, "
    "CAST(SUM(completed_prompts) AS BIGINT) AS completed_prompts, "
    "CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE batch_status = 'COMPLETED') * CAST(100 AS DOUBLE) "
    "/ COUNT(*) ELSE 0.0 END AS completion_rate, "
    "CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE batch_status = 'FAILED') * CAST(100 AS DOUBLE) "
    "/ COUNT(*) ELSE 0.0 END AS failure_rate, "
    f"AVG(CASE WHEN batch_status = 'COMPLETED' AND submitted_at IS NOT NULL THEN "
    f"{hours_sql('submitted_at', 'completed_at')} END) AS avg_processing_hours, "
    "COUNT(*) FILTER (WHERE batch_status IN ('PENDING','PROCESSING')) AS open_batches FROM batch_log), "
    "s AS (SELECT batch_status, COUNT(*) AS count, SUM(total_prompts) AS total_prompts, "
    "SUM(completed_prompts) AS completed_prompts, SUM(failed_prompts) AS failed_prompts FROM batch_log "
    "GROUP BY batch_status), "
    f"a AS (SELECT CASE WHEN {_AGE} = 0 THEN 'Today' WHEN {_AGE} = 1 THEN 'Yesterday' WHEN {_AGE} <= 7 "
    f"THEN 'This Week' WHEN {_AGE} <= 30 THEN 'This Month' ELSE 'Older' END AS age_category, COUNT(*) AS count "
    "FROM batch_log GROUP BY 1), "
    "e AS (SELECT error_message, COUNT(*) AS occurrence_count "
    "FROM batch_log WHERE error_message IS NOT NULL GROUP BY batch_log.error_message "
    "ORDER BY occurrence_count DESC, batch_log.error_message LIMIT 5) "
    + " UNION ALL ".join(
        [f"SELECT 'overall' AS section, CAST(NULL AS VARCHAR) AS key, '{m}' AS metric, "
         f"CAST({m} AS DOUBLE) AS value FROM o"
         for m in ["total_batches", "total_prompts", "completed_prompts", "completion_rate",
                   "failure_rate", "avg_processing_hours", "open_batches"]]
        + [f"SELECT 'status', batch_status, '{m}', CAST({m} AS DOUBLE) FROM s"
           for m in ["count", "total_prompts", "completed_prompts", "failed_prompts"]]
        + ["SELECT 'age', age_category, 'count', CAST(count AS DOUBLE) FROM a",
           "SELECT 'error', error_message, 'occurrence_count', CAST(occurrence_count AS DOUBLE) FROM e"]))

register("a16_status_report", L(_REPORT_SQL))(
    lambda spark, d: jl.status_report(_log(spark, d), AS_OF))


# The hourly cycle (SURVEY §3 (1)): poll applied (J-08/J-09) and stuck rows
# swept (J-07) in one plan, written once, statistics (A-01) from the result.
@register("j08_status_cycle", L(
    "WITH applied AS (" + SNAPSHOT_APPLY_SQL + "), swept AS (SELECT CASE WHEN " + STUCK_SQL +
    " THEN 'FAILED' ELSE batch_status END AS batch_status, total_prompts, completed_prompts, failed_prompts, "
    "retry_count FROM applied) "
    "SELECT batch_status, COUNT(*) AS count, CAST(SUM(total_prompts) AS BIGINT) AS total_prompts, "
    "CAST(SUM(completed_prompts) AS BIGINT) AS completed_prompts, "
    "CAST(SUM(failed_prompts) AS BIGINT) AS failed_prompts, AVG(retry_count) AS avg_retry_count "
    "FROM swept GROUP BY batch_status", "status_snapshot"))
def j08_cycle(spark, d):
    from suite.loading import scratch
    from tidemark.plans.status_cycle import status_cycle
    path = scratch(spark, "status-cycle")
    _log(spark, d).write.partitionBy("yearmonth").parquet(path)
    status_cycle(spark, path, status_snapshot(spark, d), AS_OF, None, 24)
    return jl.status_statistics(spark.read.parquet(path))
