"""Job-log operators on hand-made frames: edge cases of SURVEY §8 and laws."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joblog as jl

AS_OF = dt.datetime(2024, 3, 2, 12, 0, 0)


def _log(spark, rows):
    base = {c.name: None for c in jl.LOG_SCHEMA.fields}
    full = []
    for r in rows:
        x = dict(base)
        x.update({"jsonl_file_path": "in/x.jsonl", "total_prompts": 10, "completed_prompts": 0,
                  "failed_prompts": 0, "created_at": dt.datetime(2024, 3, 1), "updated_at": dt.datetime(2024, 3, 1),
                  "retry_count": 0, "max_retries": 3, "yearmonth": "202403"})
        x.update(r)
        full.append(tuple(x[c.name] for c in jl.LOG_SCHEMA.fields))
    return spark.createDataFrame(full, jl.LOG_SCHEMA)


def test_stuck_threshold_is_strict(spark):
    # exactly 24 h old is not stuck; one second more is
    log = _log(spark, [
        {"batch_id": "a", "batch_status": "PENDING", "updated_at": AS_OF - dt.timedelta(hours=24)},
        {"batch_id": "b", "batch_status": "PROCESSING", "updated_at": AS_OF - dt.timedelta(hours=24, seconds=1)},
        {"batch_id": "c", "batch_status": "COMPLETED", "updated_at": AS_OF - dt.timedelta(days=9)},
    ])
    got = [r.batch_id for r in jl.stuck_batches(log, AS_OF, 24).collect()]
    assert got == ["b"]


def test_fail_stuck_message_and_times(spark):
    log = _log(spark, [{"batch_id": "b", "batch_status": "PROCESSING",
                        "updated_at": AS_OF - dt.timedelta(hours=50)}])
    r = jl.fail_stuck(log, AS_OF, 48).collect()[0]
    assert r.batch_status == "FAILED"
    assert r.error_message == "Batch stuck in PROCESSING status for over 48 hours"
    assert r.completed_at == AS_OF and r.updated_at == AS_OF


def test_update_status_keeps_unset_fields_and_quotes(spark):
    log = _log(spark, [{"batch_id": "a", "batch_status": "PROCESSING", "completed_prompts": 4,
                        "output_s3_uri": "s3://old"},
                       {"batch_id": "b", "batch_status": "PENDING"}])
    upd = spark.createDataFrame([("a", "FAILED", None, "it's broken \"badly\"")],
                                "batch_id string, new_status string, completed_prompts int, error_message string")
    out = {r.batch_id: r for r in jl.update_status(log, upd, AS_OF).collect()}
    assert out["a"].batch_status == "FAILED"
    assert out["a"].completed_prompts == 4            # unset -> kept
    assert out["a"].error_message == "it's broken \"badly\""   # no quoting problems (D-1)
    assert out["a"].completed_at == AS_OF              # terminal status sets completed_at
    assert out["b"].batch_status == "PENDING" and out["b"].updated_at == dt.datetime(2024, 3, 1)


def test_update_status_rejects_duplicate_source_keys(spark):
    log = _log(spark, [{"batch_id": "a", "batch_status": "PENDING"}])
    upd = spark.createDataFrame([("a", "FAILED"), ("a", "COMPLETED")], "batch_id string, new_status string")
    with pytest.raises(Exception, match="duplicate key"):
        jl.update_status(log, upd, AS_OF).collect()


def test_increment_retry_unknown_id_raises(spark):
    log = _log(spark, [{"batch_id": "a", "batch_status": "PENDING"}])
    ok = jl.increment_retry(log, spark.createDataFrame([("a",)], "batch_id string"), AS_OF).collect()
    assert ok[0].retry_count == 1
    with pytest.raises(Exception, match="Batch not found"):
        jl.increment_retry(log, spark.createDataFrame([("zz",)], "batch_id string"), AS_OF).collect()


def test_retry_eligibility_missing_id_is_false(spark):
    log = _log(spark, [{"batch_id": "a", "batch_status": "FAILED", "retry_count": 3},
                       {"batch_id": "b", "batch_status": "FAILED", "retry_count": 1}])
    ids = spark.createDataFrame([("a",), ("b",), ("nope",)], "batch_id string")
    got = {r.batch_id: r.should_retry for r in jl.retry_eligibility(log, ids).collect()}
    assert got == {"a": False, "b": True, "nope": False}


def test_snapshot_mapping_errors_and_unknown_states(spark):
    log = _log(spark, [
        {"batch_id": "a", "batch_status": "PENDING"},
        {"batch_id": "b", "batch_status": "PROCESSING"},
        {"batch_id": "c", "batch_status": "PROCESSING", "retry_count": 3},
        {"batch_id": "d", "batch_status": "PROCESSING", "retry_count": 1},
        {"batch_id": "e", "batch_status": "PENDING"},
        {"batch_id": "f", "batch_status": "PENDING"},
    ])
    snap = spark.createDataFrame([
        ("a", "InProgress", None), ("b", "Stopping", None), ("c", None, "boom"), ("d", None, "boom"),
        ("e", "Weird", None)], "batch_id string, source_status string, poll_error string")
    out = {r.batch_id: r for r in jl.apply_status_snapshot(log, snap, AS_OF).collect()}
    assert out["a"].batch_status == "PROCESSING" and out["a"].poll_outcome == "updated"
    assert out["b"].batch_status == "PROCESSING" and out["b"].poll_outcome == "unchanged"
    assert out["c"].batch_status == "FAILED" and out["c"].error_message == "Max retries exceeded. Last error: boom"
    assert out["d"].retry_count == 2 and out["d"].batch_status == "PROCESSING"
    assert out["e"].batch_status == "Weird"            # unknown state passes through
    assert out["f"].poll_outcome is None               # not polled
    summary = {(r.metric, r.status): r.value for r in jl.poll_summary(
        jl.apply_status_snapshot(log, snap, AS_OF)).collect()}
    assert summary[("checked", None)] == 3 and summary[("errors", None)] == 2
    assert summary[("updated", None)] == 2


def test_empty_log_statistics(spark):
    empty = spark.createDataFrame([], jl.LOG_SCHEMA)
    assert jl.status_statistics(empty).count() == 0
    assert jl.completion_rate(empty).collect()[0][0] == 0.0
    assert jl.system_health(empty, AS_OF).collect()[0].is_healthy is False  # 0 < 0 is false


def test_retention_honours_month(spark):
    old = dt.datetime(2023, 1, 1)
    log = _log(spark, [
        {"batch_id": "a", "batch_status": "COMPLETED", "completed_at": old, "yearmonth": "202301"},
        {"batch_id": "b", "batch_status": "COMPLETED", "completed_at": old, "yearmonth": "202302"},
        {"batch_id": "c", "batch_status": "EXPIRED", "completed_at": old, "yearmonth": "202301"},
    ])
    kept, removed = jl.retention_split(log, AS_OF, 90, yearmonth="202301")
    assert [r.batch_id for r in removed.collect()] == ["a"]
    assert kept.count() == 2


def test_new_log_rows_defaults(spark):
    b = spark.createDataFrame([("x1", "in/a.jsonl", 5)], "batch_id string, jsonl_file_path string, total_prompts int")
    r = jl.new_log_rows(b, AS_OF, model_id="m").collect()[0]
    assert (r.batch_status, r.completed_prompts, r.retry_count, r.max_retries, r.yearmonth) == \
        ("PENDING", 0, 0, 3, "202403")
    assert r.completed_at is None and r.created_at == AS_OF


def test_failure_analysis_is_long_form(spark):
    log = _log(spark, [{"batch_id": f"b{i}", "batch_status": "FAILED", "error_message": "e1" if i % 3 else "e2"}
                       for i in range(9)])
    out = jl.failure_analysis(log, top=1).collect()
    assert {r.error_message for r in out} == {"e1"} and len(out) == 6


def test_status_cycle_persists_and_summarises_from_staged_poll(spark, tmp_dir):
    import os
    from tidemark.plans.status_cycle import status_cycle
    path = os.path.join(tmp_dir, "log")
    _log(spark, [
        {"batch_id": "a", "batch_status": "PENDING", "updated_at": AS_OF - dt.timedelta(hours=1)},
        {"batch_id": "b", "batch_status": "PROCESSING", "updated_at": AS_OF - dt.timedelta(hours=1)},
        {"batch_id": "c", "batch_status": "PROCESSING", "updated_at": AS_OF - dt.timedelta(hours=30)},
        {"batch_id": "d", "batch_status": "COMPLETED", "updated_at": AS_OF - dt.timedelta(days=2)},
    ]).write.partitionBy("yearmonth").parquet(path)
    snap = spark.createDataFrame([("a", "Completed", None), ("b", None, "Throttled")],
                                 "batch_id string, source_status string, poll_error string")
    out = status_cycle(spark, path, snap, AS_OF, "202403", 24)
    got = {r.batch_id: (r.batch_status, r.retry_count) for r in spark.read.parquet(path).collect()}
    assert got == {"a": ("COMPLETED", 0), "b": ("PROCESSING", 1), "c": ("FAILED", 0), "d": ("COMPLETED", 0)}
    summary = {(r.metric, r.status): r.value for r in out["poll_summary"].collect()}
    assert summary[("updated", None)] == 1 and summary[("errors", None)] == 1
    stats = {r.batch_status: r["count"] for r in out["statistics"].collect()}
    assert stats == {"COMPLETED": 2, "PROCESSING": 1, "FAILED": 1}
