"""Batch-job status log: lookups, set-based updates and statistics.

The log is an ordinary DataFrame with the schema of ``LOG_SCHEMA``. Every
mutation is a pure function ``(log, changes) -> new log`` computed as one
plan over the whole set of changes (one join, no job per row); persisting
the result is ``tidemark.sources.io``'s job. Lookups return DataFrames; only
callers that want Python values collect them.

Scale notes: ``batch_id`` is unique in the log, so joins on it never skew.
Change sets are de-duplicated by an aggregation on ``batch_id`` whose output
partitioning the following join reuses (no second exchange on that side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timefn import hours_before, days_before, hours_between, ts_lit
from tidemark.operators.merge import assert_unique_keys

# The status domain of the log.
PENDING, PROCESSING = "PENDING", "PROCESSING"
COMPLETED, FAILED, EXPIRED, CANCELLED = "COMPLETED", "FAILED", "EXPIRED", "CANCELLED"
NON_TERMINAL = [PENDING, PROCESSING]
TERMINAL = [COMPLETED, FAILED, EXPIRED, CANCELLED]
RETENTION_STATUSES = [COMPLETED, FAILED, CANCELLED]

# Source-service state -> log status.
SOURCE_STATE_MAP = {
    "InProgress": PROCESSING,
    "Completed": COMPLETED,
    "Failed": FAILED,
    "Stopping": PROCESSING,
    "Stopped": CANCELLED,
    "Submitted": PENDING,
    "Validating": PENDING,
}

LOG_SCHEMA = T.StructType([
    T.StructField("batch_id", T.StringType(), False),
    T.StructField("jsonl_file_path", T.StringType(), False),
    T.StructField("batch_status", T.StringType(), False),
    T.StructField("total_prompts", T.IntegerType()),
    T.StructField("completed_prompts", T.IntegerType()),
    T.StructField("failed_prompts", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), False),
    T.StructField("submitted_at", T.TimestampNTZType()),
    T.StructField("completed_at", T.TimestampNTZType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("input_s3_uri", T.StringType()),
    T.StructField("output_s3_uri", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("max_retries", T.IntegerType()),
    T.StructField("job_name", T.StringType()),
    T.StructField("job_run_id", T.StringType()),
    T.StructField("created_date", T.DateType()),   # the day of created_at, computed on write
    T.StructField("yearmonth", T.StringType(), False),
])

def _st() -> Column:
    return F.col("batch_status")


def _month(df: DataFrame, yearmonth: str | None) -> DataFrame:
    # yearmonth is the log's partition column: this filter prunes partitions.
    return df.where(F.col("yearmonth") == F.lit(yearmonth)) if yearmonth else df


def _bigint_sum(c: str) -> Column:
    return F.sum(F.col(c)).cast("bigint")


def unique_by_key(df: DataFrame, keys: list[str], what: str = "change set") -> DataFrame:
    """Rows of ``df`` with ``keys`` asserted unique, inside the plan.

    MERGE refuses a source in which one target row matches several source
    rows; this does the same without a separate action: a count per key
    (numbers only, pre-aggregated) is joined back and raises at execution
    when a key occurs twice.
    """
    return assert_unique_keys(df, keys, what)


# ---------------------------------------------------------------- lookups

def non_terminal(log: DataFrame, yearmonth: str | None = None, limit: int | None = None) -> DataFrame:
    """P-03: PENDING/PROCESSING rows, oldest first, optional month and limit."""
    out = _month(log, yearmonth).where(_st().isin(NON_TERMINAL)).orderBy("created_at", "batch_id")
    return out.limit(limit) if limit else out


def batch_by_id(log: DataFrame, batch_id: str) -> DataFrame:
    """P-04: point lookup (zero or one row)."""
    return log.where(F.col("batch_id") == F.lit(batch_id))


def stuck_batches(log: DataFrame, as_of, hours: float = 24, yearmonth: str | None = None) -> DataFrame:
    """P-05: non-terminal and not updated for more than ``hours`` before ``as_of``."""
    return (_month(log, yearmonth)
            .where(_st().isin(NON_TERMINAL) & (F.col("updated_at") < hours_before(as_of, hours)))
            .orderBy("updated_at", "batch_id"))


def failed_for_resubmit(log: DataFrame, yearmonth: str) -> DataFrame:
    """P-06: FAILED rows of one month."""
    return _month(log, yearmonth).where(_st() == FAILED)


def retry_eligibility(log: DataFrame, ids: DataFrame) -> DataFrame:
    """P-12: ``retry_count < max_retries`` per requested id; unknown id -> false."""
    j = ids.select("batch_id").distinct().join(
        log.select("batch_id", "retry_count", "max_retries"), "batch_id", "left")
    return j.select("batch_id", F.coalesce(F.col("retry_count") < F.col("max_retries"),
                                           F.lit(False)).alias("should_retry"))


def results_export(log: DataFrame, yearmonth: str | None = None) -> DataFrame:
    """P-13: export projection of finished batches, newest completion first."""
    return (_month(log, yearmonth).where(_st().isin(COMPLETED, FAILED))
            .select("batch_id", "jsonl_file_path", "batch_status", "total_prompts",
                    "completed_prompts", "failed_prompts", "model_id", "output_s3_uri", "yearmonth",
                    F.to_date("submitted_at").alias("submission_date"),
                    F.to_date("completed_at").alias("completion_date"),
                    F.round(hours_between("submitted_at", "completed_at"), 2).alias("processing_hours"))
            .orderBy(F.col("completed_at").desc(), "batch_id"))


def monthly_batch_path(base: str):
    """Path rule ``<base>/YYYY/MM/batch_0001.jsonl`` for :func:`expected_batch_files`."""
    def rule(year: Column, month: Column, i: Column) -> Column:
        return F.format_string(base.rstrip("/") + "/%04d/%02d/batch_%04d.jsonl", year, month, i)
    return rule


def expected_batch_files(months: DataFrame, files_per_month: int, path_rule,
                         start: int = 1) -> DataFrame:
    """P-16: the expected input files of each month in ``months`` (column ``yearmonth``).

    Generated on the executors with ``sequence``/``explode``: no driver list.
    """
    ym = F.col("yearmonth")
    y = F.substring(ym, 1, 4).cast("int")
    m = F.substring(ym, 5, 2).cast("int")
    return (months.select("yearmonth").distinct()
            .select("yearmonth", y.alias("_y"), m.alias("_m"),
                    F.explode(F.sequence(F.lit(start), F.lit(start + files_per_month - 1))).alias("file_no"))
            .select("yearmonth", "file_no", path_rule(F.col("_y"), F.col("_m"), F.col("file_no"))
                    .alias("jsonl_file_path")))


def unsubmitted_files(expected: DataFrame, log: DataFrame) -> DataFrame:
    """P-16: expected files that have no batch in the log for their month."""
    return expected.join(log.select("yearmonth", "jsonl_file_path"),
                         ["yearmonth", "jsonl_file_path"], "left_anti")


# --------------------------------------------------------------- mutations

def _terminal_time(new_status: Column, as_of_col: Column, old: Column) -> Column:
    return F.when(new_status.isin(TERMINAL), as_of_col).otherwise(old)


def update_status(log: DataFrame, updates: DataFrame, as_of) -> DataFrame:
    """J-01: apply ``updates`` (batch_id, new_status[, completed_prompts,
    failed_prompts, output_s3_uri, error_message]) to matched rows only.

    Unset (NULL / absent) fields keep the old value; ``updated_at`` becomes
    ``as_of``; a terminal status sets ``completed_at`` to ``as_of``.
    """
    optional = ["completed_prompts", "failed_prompts", "output_s3_uri", "error_message"]
    cols = ["batch_id", "new_status"] + [c for c in optional if c in updates.columns]
    u = unique_by_key(updates.select(*cols), ["batch_id"], "status updates")
    u = u.select("batch_id", *[F.col(c).alias(f"__u_{c}") for c in cols[1:]], F.lit(True).alias("__hit"))
    j = log.join(u, "batch_id", "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    now = ts_lit(as_of)
    new_status = F.col("__u_new_status")
    out = {}
    for c in log.columns:
        if c == "batch_status":
            out[c] = F.when(hit, new_status).otherwise(F.col(c))
        elif c == "updated_at":
            out[c] = F.when(hit, now).otherwise(F.col(c))
        elif c == "completed_at":
            out[c] = F.when(hit, _terminal_time(new_status, now, F.col(c))).otherwise(F.col(c))
        elif c in optional and c in cols:
            out[c] = F.coalesce(F.col(f"__u_{c}").cast(log.schema[c].dataType), F.col(c))
        else:
            out[c] = F.col(c)
    return j.select(*[v.alias(k) for k, v in out.items()])


def retention_split(log: DataFrame, as_of, days_to_keep: int = 90, yearmonth: str | None = None,
                    statuses=tuple(RETENTION_STATUSES)) -> tuple[DataFrame, DataFrame]:
    """J-05: (kept, removed). Removed = finished in ``statuses`` with
    ``completed_at`` older than ``days_to_keep`` days (month filter honoured)."""
    pred = (F.col("completed_at") < days_before(as_of, days_to_keep)) & _st().isin(list(statuses))
    if yearmonth:
        pred = pred & (F.col("yearmonth") == F.lit(yearmonth))
    pred = F.coalesce(pred, F.lit(False))
    return log.where(~pred), log.where(pred)


def increment_retry(log: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """J-06: ``retry_count + 1`` and ``updated_at = as_of`` for each id in ``ids``.

    An id absent from the log raises at execution: a left join marks the rows
    (AQE can split it), and the ids joined to the log are unioned behind a
    check that no row passes.
    """
    u = unique_by_key(ids.select("batch_id"), ["batch_id"], "retry ids")
    j = log.join(u.withColumn("__hit", F.lit(True)), "batch_id", "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    over = {"retry_count": F.when(hit, F.coalesce(F.col("retry_count"), F.lit(0)) + 1).otherwise(F.col("retry_count")),
            "updated_at": F.when(hit, ts_lit(as_of)).otherwise(F.col("updated_at"))}
    done = j.select(*[over.get(c, F.col(c)).alias(c) for c in log.columns])
    message = F.concat(F.lit("Batch not found: "), F.coalesce(F.col("batch_id"), F.lit("null")))
    known = log.select("batch_id", F.lit(True).alias("__known"))
    absent = u.join(known, "batch_id", "left").where(
        F.when(F.col("__known").isNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(False)))
    return done.unionByName(absent.select(*[(F.col(c) if c == "batch_id" else F.lit(None)).cast(log.schema[c].dataType).alias(c)
                                            for c in log.columns]))


def fail_stuck(log: DataFrame, as_of, hours: float = 24, yearmonth: str | None = None) -> DataFrame:
    """J-07: mark stuck rows FAILED with a message naming the old status and
    the threshold; one projection over the log."""
    stuck = _st().isin(NON_TERMINAL) & (F.col("updated_at") < hours_before(as_of, hours))
    if yearmonth:
        stuck = stuck & (F.col("yearmonth") == F.lit(yearmonth))
    stuck = F.coalesce(stuck, F.lit(False))
    h = int(hours) if float(hours).is_integer() else hours
    msg = F.concat(F.lit("Batch stuck in "), _st(), F.lit(f" status for over {h} hours"))
    now = ts_lit(as_of)
    repl = {"batch_status": F.lit(FAILED), "error_message": msg, "updated_at": now, "completed_at": now}
    return log.select(*[F.when(stuck, repl[c]).otherwise(F.col(c)).alias(c) if c in repl else F.col(c)
                        for c in log.columns])


def _state_map() -> Column:
    items = []
    for k, v in SOURCE_STATE_MAP.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def map_source_state(state: Column) -> Column:
    """Source-service state -> log status; an unknown state passes through."""
    return F.coalesce(_state_map()[state], state)


def apply_status_snapshot(log: DataFrame, snapshot: DataFrame, as_of) -> DataFrame:
    """J-08 + J-09: apply one poll of the service to the log, as one plan.

    ``snapshot``: batch_id, source_status, poll_error and optionally
    completed_prompts, failed_prompts, output_s3_uri, failure_message.
    Rows whose mapped status differs from the log change (J-01 rules). Rows
    with a ``poll_error`` get ``retry_count + 1`` while retries remain, else
    FAILED with ``Max retries exceeded. Last error: <error>``. The state map
    is a literal map expression: no join, no broadcast.
    """
    opt = {"completed_prompts": "completed_prompts", "failed_prompts": "failed_prompts",
           "output_s3_uri": "output_s3_uri", "failure_message": "error_message"}
    present = [c for c in opt if c in snapshot.columns]
    s = unique_by_key(snapshot.select("batch_id", "source_status", "poll_error", *present),
                      ["batch_id"], "status snapshot")
    s = s.select("batch_id", F.col("source_status").alias("__state"), F.col("poll_error").alias("__err"),
                 *[F.col(c).alias(f"__s_{c}") for c in present], F.lit(True).alias("__hit"))
    j = log.join(s, "batch_id", "left")
    now = ts_lit(as_of)
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    err = hit & F.col("__err").isNotNull()
    mapped = map_source_state(F.col("__state"))
    changed = hit & ~err & mapped.isNotNull() & (mapped != _st())
    # NULL counts as the column's default: no retry so far, three at most
    retries = F.coalesce(F.col("retry_count"), F.lit(0))
    can_retry = retries < F.coalesce(F.col("max_retries"), F.lit(3))
    give_up = err & ~can_retry
    new_status = F.when(changed, mapped).when(give_up, F.lit(FAILED)).otherwise(_st())
    out = []
    for c in log.columns:
        if c == "batch_status":
            e = new_status
        elif c == "updated_at":
            e = F.when(changed | err, now).otherwise(F.col(c))
        elif c == "completed_at":
            e = F.when(changed | give_up, _terminal_time(new_status, now, F.col(c))).otherwise(F.col(c))
        elif c == "retry_count":
            e = F.when(err & can_retry, retries + 1).otherwise(F.col(c))
        elif c == "error_message":
            e = F.when(give_up, F.concat(F.lit("Max retries exceeded. Last error: "), F.col("__err")))
            if "failure_message" in present:
                e = e.when(changed, F.coalesce(F.col("__s_failure_message"), F.col(c)))
            e = e.otherwise(F.col(c))
        elif c in opt.values() and any(opt[p] == c for p in present):
            src = next(p for p in present if opt[p] == c)
            e = F.when(changed, F.coalesce(F.col(f"__s_{src}").cast(log.schema[c].dataType),
                                           F.col(c))).otherwise(F.col(c))
        else:
            e = F.col(c)
        out.append(e.alias(c))
    # Carry the poll outcome for the summary (A-17); callers drop it before writing.
    outcome = (F.when(~hit, F.lit(None)).when(err & can_retry, F.lit("retry"))
               .when(give_up, F.lit("gave_up")).when(changed, F.lit("updated"))
               .otherwise(F.lit("unchanged")))
    return j.select(*out, outcome.alias("poll_outcome"))


def poll_summary(applied: DataFrame) -> DataFrame:
    """A-17: checked / updated / errors and the count per new status of the
    updated rows, from :func:`apply_status_snapshot` output. Long form:
    (metric, status, value)."""
    o = F.col("poll_outcome")
    polled = applied.where(o.isNotNull())
    totals = polled.agg(
        F.count(F.when(o.isin("updated", "unchanged"), 1)).alias("checked"),
        F.count(F.when(o == "updated", 1)).alias("updated"),
        F.count(F.when(o.isin("retry", "gave_up"), 1)).alias("errors"))
    totals = totals.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"),
                                                        F.lit(None).cast("string").alias("status"),
                                                        F.col(m).cast("bigint").alias("value"))
                                               for m in ["checked", "updated", "errors"]])).alias("r")
                           ).select("r.*")
    by = (polled.where(o == "updated").groupBy("batch_status")
          .agg(F.count(F.lit(1)).cast("bigint").alias("value"))
          .select(F.lit("updated_by_status").alias("metric"), F.col("batch_status").alias("status"), "value"))
    return totals.unionByName(by)


def new_log_rows(batches: DataFrame, as_of, model_id: str | None = None,
                 yearmonth: str | None = None, job_name: str | None = None,
                 job_run_id: str | None = None) -> DataFrame:
    """J-10: full log rows for newly submitted batches, with the defaults.

    ``batches`` holds batch_id, jsonl_file_path, total_prompts and optionally
    model_id, input_s3_uri, output_s3_uri. Status PENDING, counters 0, all
    times ``as_of`` (completed_at NULL), retries 0 of 3, month from ``as_of``
    unless given. One append for the whole set.
    """
    now = ts_lit(as_of)
    ym = yearmonth or as_of.strftime("%Y%m")

    def opt(c, default):
        return F.col(c) if c in batches.columns else F.lit(default)

    cols = {
        "batch_id": F.col("batch_id"),
        "jsonl_file_path": F.col("jsonl_file_path"),
        "batch_status": F.lit(PENDING),
        "total_prompts": F.col("total_prompts"),
        "completed_prompts": F.lit(0),
        "failed_prompts": F.lit(0),
        "created_at": now, "updated_at": now, "submitted_at": now,
        "completed_at": F.lit(None),
        "model_id": opt("model_id", model_id),
        "input_s3_uri": opt("input_s3_uri", None),
        "output_s3_uri": opt("output_s3_uri", None),
        "error_message": F.lit(None),
        "retry_count": F.lit(0),
        "max_retries": F.lit(3),
        "job_name": opt("job_name", job_name),
        "job_run_id": opt("job_run_id", job_run_id),
        "created_date": F.to_date(now),
        "yearmonth": opt("yearmonth", ym),
    }
    return batches.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in LOG_SCHEMA.fields])


# -------------------------------------------------------------- statistics

def status_statistics(log: DataFrame, yearmonth: str | None = None) -> DataFrame:
    """A-01: per status count, prompt sums and average retry count."""
    return (_month(log, yearmonth).groupBy("batch_status")
            .agg(F.count(F.lit(1)).alias("count"),
                 _bigint_sum("total_prompts").alias("total_prompts"),
                 _bigint_sum("completed_prompts").alias("completed_prompts"),
                 _bigint_sum("failed_prompts").alias("failed_prompts"),
                 F.avg("retry_count").alias("avg_retry_count"))
            .orderBy("batch_status"))


def _rate(status: str) -> Column:
    total = F.count(F.lit(1))
    return F.when(total > 0, F.count(F.when(_st() == status, 1)) * 100.0 / total).otherwise(F.lit(0.0))


def completion_rate(log: DataFrame, yearmonth: str | None = None) -> DataFrame:
    """A-02: percent of COMPLETED rows (0 when empty); one row."""
    return _month(log, yearmonth).agg(_rate(COMPLETED).alias("completion_rate"))


def failure_rate(log: DataFrame, yearmonth: str | None = None) -> DataFrame:
    """A-03: percent of FAILED rows (0 when empty); one row."""
    return _month(log, yearmonth).agg(_rate(FAILED).alias("failure_rate"))


def average_processing_hours(log: DataFrame, yearmonth: str | None = None) -> DataFrame:
    """A-04: mean submitted->completed hours over COMPLETED rows with both times."""
    return (_month(log, yearmonth)
            .where(F.col("completed_at").isNotNull() & F.col("submitted_at").isNotNull()
                   & (_st() == COMPLETED))
            .agg(F.avg(hours_between("submitted_at", "completed_at")).alias("avg_hours")))


AGE_ORDER = ["Today", "Yesterday", "This Week", "This Month", "Older"]


def _age_category(as_of) -> Column:
    d = F.datediff(F.to_date(ts_lit(as_of)), F.to_date("created_at"))
    return (F.when(d == 0, "Today").when(d == 1, "Yesterday").when(d <= 7, "This Week")
            .when(d <= 30, "This Month").otherwise("Older"))


def batches_by_age(log: DataFrame, as_of) -> DataFrame:
    """A-05: counts by age bucket of ``created_at`` relative to ``as_of``, in bucket order."""
    bucket = _age_category(as_of)
    order = F.when(F.col("age_category") == "Today", 1).when(F.col("age_category") == "Yesterday", 2) \
        .when(F.col("age_category") == "This Week", 3).when(F.col("age_category") == "This Month", 4) \
        .otherwise(5)
    return (log.groupBy(bucket.alias("age_category")).agg(F.count(F.lit(1)).alias("count"))
            .withColumn("sort_key", order).orderBy("sort_key"))


def daily_submissions(log: DataFrame, as_of, days: int = 30) -> DataFrame:
    """A-06: batches and prompts per creation day over the last ``days`` days."""
    return (log.where(F.col("created_at") >= days_before(as_of, days))
            .groupBy(F.to_date("created_at").alias("date"))
            .agg(F.count(F.lit(1)).alias("batches_submitted"),
                 _bigint_sum("total_prompts").alias("total_prompts"))
            .orderBy("date"))


def error_summary(log: DataFrame, limit: int = 10) -> DataFrame:
    """A-07: top-``limit`` error messages by occurrences with last time seen
    (ties broken by message). Partial aggregation before the shuffle; the
    top-k is a TakeOrdered, never a global sort."""
    return (log.where(F.col("error_message").isNotNull())
            .groupBy("error_message")
            .agg(F.count(F.lit(1)).alias("occurrence_count"), F.max("updated_at").alias("last_occurrence"))
            .orderBy(F.col("occurrence_count").desc(), "error_message").limit(limit))


def active_batches(log: DataFrame) -> DataFrame:
    """A-08: dashboard of PENDING/PROCESSING rows."""
    return (log.where(_st().isin(NON_TERMINAL)).groupBy("batch_status")
            .agg(F.count(F.lit(1)).alias("count"), _bigint_sum("total_prompts").alias("total_prompts"),
                 _bigint_sum("completed_prompts").alias("completed_prompts"),
                 F.round(F.avg("retry_count"), 2).alias("avg_retries")))


def completion_trend(log: DataFrame, as_of, days: int = 30) -> DataFrame:
    """A-09: completions per day over the last ``days`` days."""
    start = F.date_sub(F.to_date(ts_lit(as_of)), days)
    return (log.where((F.col("completed_at") >= start) & (_st() == COMPLETED))
            .groupBy(F.to_date("completed_at").alias("date"))
            .agg(F.count(F.lit(1)).alias("batches_completed"),
                 _bigint_sum("total_prompts").alias("prompts_processed"),
                 F.avg(hours_between("submitted_at", "completed_at")).alias("avg_hours"))
            .orderBy("date"))


def failure_analysis(log: DataFrame, top: int = 20) -> DataFrame:
    """A-10: the ``top`` error messages of FAILED rows with their affected batches.

    The affected ids come out one row per (error, batch) instead of one list
    per error: a message may cover a third of the log, and a list that size
    would have to sit in one task. The top-k side is tiny and fixed in size
    (``top`` rows), so it is broadcast into a semi-join with the log.
    """
    failed = log.where((_st() == FAILED) & F.col("error_message").isNotNull())
    head = (failed.groupBy("error_message")
            .agg(F.count(F.lit(1)).alias("count"), F.max("updated_at").alias("last_occurrence"))
            .orderBy(F.col("count").desc(), "error_message").limit(top))
    return (failed.select("error_message", F.col("batch_id").alias("affected_batch"))
            .join(F.broadcast(head), "error_message"))


def efficiency_by_model(log: DataFrame) -> DataFrame:
    """A-11: per model: batches, completed, failed, mean hours of completed, mean retries."""
    return (log.groupBy("model_id")
            .agg(F.count(F.lit(1)).alias("total_batches"),
                 F.count(F.when(_st() == COMPLETED, 1)).alias("completed"),
                 F.count(F.when(_st() == FAILED, 1)).alias("failed"),
                 F.round(F.avg(F.when(_st() == COMPLETED, hours_between("submitted_at", "completed_at"))), 2)
                 .alias("avg_completion_hours"),
                 F.round(F.avg("retry_count"), 2).alias("avg_retries")))


def stuck_alert(log: DataFrame, as_of, hours: float = 24) -> DataFrame:
    """A-12: stuck rows with hours since last update to one decimal."""
    return (stuck_batches(log, as_of, hours)
            .select("batch_id", "batch_status", "jsonl_file_path", "created_at", "updated_at",
                    F.round(hours_between(F.col("updated_at"), ts_lit(as_of)), 1).alias("hours_stuck"),
                    "retry_count"))


def monthly_summary(log: DataFrame) -> DataFrame:
    """A-13: one row per month, newest first."""
    return (log.groupBy("yearmonth")
            .agg(F.count(F.lit(1)).alias("total_batches"),
                 F.count(F.when(_st() == COMPLETED, 1)).alias("completed"),
                 F.count(F.when(_st() == FAILED, 1)).alias("failed"),
                 F.count(F.when(_st().isin(NON_TERMINAL), 1)).alias("in_progress"),
                 _bigint_sum("total_prompts").alias("total_prompts"),
                 _bigint_sum("completed_prompts").alias("completed_prompts"),
                 F.min("created_at").alias("first_batch_date"),
                 F.max("updated_at").alias("last_update_date"))
            .orderBy(F.col("yearmonth").desc()))


def stuck(as_of, hours) -> Column:
    """Open rows not updated for ``hours`` (false where the time is NULL)."""
    return F.coalesce(_stuck_pred(as_of, hours), F.lit(False))


def _stuck_pred(as_of, hours) -> Column:
    return _st().isin(NON_TERMINAL) & (F.col("updated_at") < hours_before(as_of, hours))


def system_health(log: DataFrame, as_of, yearmonth: str | None = None, hours: float = 24,
                  max_failed_share: float = 0.05) -> DataFrame:
    """A-14: one pass: stuck, pending, processing, failed, completed, healthy."""
    h = _month(log, yearmonth).agg(
        F.count(F.when(_stuck_pred(as_of, hours), 1)).alias("stuck_batches"),
        F.count(F.when(_st() == PENDING, 1)).alias("pending"),
        F.count(F.when(_st() == PROCESSING, 1)).alias("processing"),
        F.count(F.when(_st() == FAILED, 1)).alias("failed"),
        F.count(F.when(_st() == COMPLETED, 1)).alias("completed"))
    return h.withColumn("is_healthy", (F.col("stuck_batches") == 0)
                        & (F.col("failed") < F.col("completed") * F.lit(max_failed_share)))


def month_dashboard(log: DataFrame, as_of, yearmonth: str, hours: float = 24) -> DataFrame:
    """A-15: progress percent and stuck count of one month; one row."""
    total = F.count(F.lit(1))
    return _month(log, yearmonth).agg(
        F.lit(yearmonth).alias("yearmonth"),
        total.alias("total_batches"),
        F.when(total > 0, F.count(F.when(_st() == COMPLETED, 1)) * 100.0 / total)
        .otherwise(F.lit(0.0)).alias("progress_pct"),
        F.count(F.when(_stuck_pred(as_of, hours), 1)).alias("stuck_count"))


def status_report(log: DataFrame, as_of, yearmonth: str | None = None, top_errors: int = 5) -> DataFrame:
    """A-16: the status report as a tidy DataFrame (section, key, metric, value).

    Sections: overall, status, age, error (the top messages, whole),
    open_work (pending + processing of the month). Rendering text, and
    shortening it, is the caller's job.
    """
    m = _month(log, yearmonth)

    def longify(df: DataFrame, section: str, key: Column, metrics: list[str]) -> DataFrame:
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"),
                     F.lit(x).alias("metric"), F.col(x).cast("double").alias("value"))
            for x in metrics])).alias("r")).select("r.*")

    # One pass over the log: everything below is summed from the rows per (status, age, message), whose exchange Spark reuses.
    hours = F.when((_st() == COMPLETED) & F.col("submitted_at").isNotNull(), hours_between("submitted_at", "completed_at"))
    base = m.groupBy("batch_status", _age_category(as_of).alias("age_category"), "error_message").agg(
        F.count(F.lit(1)).alias("n"), *[_bigint_sum(c).alias(c) for c in ("total_prompts", "completed_prompts", "failed_prompts")],
        F.sum(hours).alias("hours"), F.count(hours).alias("timed"))
    n = F.coalesce(F.sum("n"), F.lit(0))

    def share(status: str) -> Column:
        return F.when(n > 0, F.coalesce(F.sum(F.when(_st() == status, F.col("n"))), F.lit(0)) * 100.0 / n).otherwise(0.0)

    overall = base.agg(
        n.alias("total_batches"), _bigint_sum("total_prompts").alias("total_prompts"),
        _bigint_sum("completed_prompts").alias("completed_prompts"), share(COMPLETED).alias("completion_rate"),
        share(FAILED).alias("failure_rate"), F.try_divide(F.sum("hours"), F.sum("timed")).alias("avg_processing_hours"),
        F.coalesce(F.sum(F.when(_st().isin(NON_TERMINAL), F.col("n"))), F.lit(0)).alias("open_batches"))
    parts = [longify(overall, "overall", F.lit(None), ["total_batches", "total_prompts",
                                                        "completed_prompts", "completion_rate",
                                                        "failure_rate", "avg_processing_hours",
                                                        "open_batches"])]
    st = base.groupBy("batch_status").agg(F.sum("n").alias("count"), *[
        _bigint_sum(c).alias(c) for c in ("total_prompts", "completed_prompts", "failed_prompts")])
    parts.append(longify(st, "status", F.col("batch_status"),
                         ["count", "total_prompts", "completed_prompts", "failed_prompts"]))
    parts.append(longify(base.groupBy("age_category").agg(F.sum("n").alias("count")), "age", F.col("age_category"), ["count"]))
    err = (base.where(F.col("error_message").isNotNull()).groupBy("error_message").agg(F.sum("n").alias("occurrence_count"))
           .orderBy(F.col("occurrence_count").desc(), "error_message").limit(top_errors))
    parts.append(longify(err, "error", F.col("error_message"), ["occurrence_count"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
