"""Request datasets for offline model inference (M-01..M-12, F-15, F-16, X-01).

The service call is not part of this library; everything around it is:
building request records, token budgets, sharding, control tables, limit
checks, result validation and reconciliation, and feature scoring.

Scale notes:
* Sharding never uses a global window. Records are spread over ``buckets``
  hash buckets (a parameter sized so one bucket fits a task); shards are
  numbered by a running sum *inside* each bucket. Hash buckets of a record
  id cannot be skewed by a hot business key.
* Cross-shard running totals (token waves) use a two-level prefix sum: a
  per-bucket total (one row per bucket, a bound fixed by the parameter) is
  prefix-summed and broadcast back, then each bucket sums locally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHARS_PER_TOKEN = 4.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def estimate_tokens(text, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    """F-16: ``ceil(length / chars_per_token)`` as BIGINT (0 for NULL text)."""
    return F.coalesce(F.ceil(F.length(_c(text)) / F.lit(chars_per_token)).cast("bigint"), F.lit(0).cast("bigint"))


def token_count_udf(count_fn):
    """X-01: a vectorised token counter from a caller's tokenizer function.

    ``count_fn(str) -> int`` runs inside an Arrow-batched pandas UDF, for a
    function that has no built-in twin; :func:`estimate_tokens` and
    :func:`count_matches` stay in the JVM."""
    import pandas as pd

    def count(s):
        return s.map(lambda x: 0 if x is None else int(count_fn(x))).astype("int64")

    # real (not string) hints, so the Series -> Series form is recognised
    count.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(count, T.LongType())


def count_matches(text, pattern: str) -> Column:
    """X-01 for a tokenizer that is a pattern: matches of ``pattern`` as BIGINT (0 for NULL text), without leaving the JVM."""
    return F.coalesce(F.size(F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(0))), F.lit(0)).cast("bigint")


def hash_bucket(id_col, buckets: int) -> Column:
    """Stable bucket of a record id: first 32 bits of md5, modulo ``buckets``.

    md5 keeps the assignment reproducible across engines and versions."""
    h = F.conv(F.substring(F.md5(_c(id_col).cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(buckets)).cast("int")


def build_requests(df: DataFrame, id_col: str, template: str, fields: list[str],
                   max_tokens: int | None = None, extra: dict | None = None) -> DataFrame:
    """M-01: one JSON request record per row: ``{"recordId", "modelInput":
    {"prompt", ...}}`` with the prompt filled from ``template`` (printf
    style) and ``fields``. Adds ``prompt_tokens`` (F-16) and ``request_bytes``."""
    prompt = F.format_string(template, *[F.col(f) for f in fields])
    model_input = [prompt.alias("prompt")]
    if max_tokens is not None:
        model_input.append(F.lit(max_tokens).alias("max_tokens"))
    for k, v in (extra or {}).items():
        model_input.append(F.lit(v).alias(k))
    rec = F.to_json(F.struct(F.col(id_col).cast("string").alias("recordId"),
                             F.struct(*model_input).alias("modelInput")))
    return (df.select(F.col(id_col).alias("record_id"), prompt.alias("__p"), rec.alias("request"))
            .select("record_id", "request", estimate_tokens("__p").alias("prompt_tokens"),
                    F.octet_length("request").cast("bigint").alias("request_bytes")))


def token_limit_split(df: DataFrame, max_tokens: int, token_col: str = "prompt_tokens"
                      ) -> tuple[DataFrame, DataFrame]:
    """M-02: (within the limit, set aside)."""
    ok = F.coalesce(F.col(token_col) <= F.lit(max_tokens), F.lit(False))
    return df.where(ok), df.where(~ok)


def bucket_count(df: DataFrame, bytes_col: str | None = "request_bytes", per_bucket: int = 1 << 30) -> int:
    """How many hash buckets M-03/M-04 should use so that one bucket -- one
    window task -- holds about ``per_bucket`` bytes of requests, or rows
    where no bytes column is named. One aggregation (a partial sum per task,
    one row to the driver)."""
    size = F.count(F.lit(1)) if bytes_col is None else F.coalesce(F.sum(bytes_col), F.lit(0))
    return max(1, -(-int(df.agg(size.cast("bigint")).first()[0]) // int(per_bucket)))


def shard_by_count(df: DataFrame, id_col: str, per_shard: int, buckets: int) -> DataFrame:
    """M-03: shards of at most ``per_shard`` records. ``shard`` =
    ``BBBB-SSSSS`` (bucket and sequence inside the bucket, padded, never
    cut), stable for a given id set and bucket count. Record ids are unique, so the md5 buckets are
    balanced; size ``buckets`` with :func:`bucket_count` at scale."""
    b = hash_bucket(id_col, buckets)
    w = Window.partitionBy("shard_bucket").orderBy(id_col)
    x = df.withColumn("shard_bucket", b).withColumn("__rn", F.row_number().over(w))
    seq = F.floor((F.col("__rn") - 1) / F.lit(per_shard)).cast("int")
    return x.withColumn("shard_seq", seq).withColumn("shard", _shard_name("shard_bucket", "shard_seq")).drop("__rn")


def _shard_name(bucket, seq) -> Column:
    # pads to at least 4 and 5 digits; longer numbers keep all their digits
    return F.format_string("%04d-%05d", _c(bucket).cast("int"), _c(seq).cast("int"))


def shard_by_budget(df: DataFrame, id_col: str, buckets: int, token_col: str = "prompt_tokens",
                    token_budget: int | None = None, bytes_col: str = "request_bytes",
                    byte_budget: int | None = None) -> DataFrame:
    """M-04: shards bounded by a token budget and/or a byte budget.

    Inside a bucket, records in id order get running sums; the shard index of
    a record is ``floor((running - own) / budget)`` per measure, and a new
    shard starts whenever either index moves. Every shard therefore holds less
    than ``budget + one record`` of each measure; pass ``budget = cap -
    largest record`` for a hard cap. Each bucket is one window partition;
    :func:`bucket_count` sizes ``buckets`` from the data.
    """
    if token_budget is None and byte_budget is None:
        raise ValueError("give token_budget and/or byte_budget")
    w = Window.partitionBy("shard_bucket").orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("shard_bucket", hash_bucket(id_col, buckets))
    parts = []
    if token_budget is not None:
        run = F.sum(token_col).over(w)
        x = x.withColumn("__ti", F.floor((run - F.col(token_col)) / F.lit(token_budget)).cast("long"))
        parts.append(F.col("__ti"))
    if byte_budget is not None:
        run_b = F.sum(bytes_col).over(w)
        x = x.withColumn("__bi", F.floor((run_b - F.col(bytes_col)) / F.lit(byte_budget)).cast("long"))
        parts.append(F.col("__bi"))
    # Both indexes only grow along the order, so each distinct pair is one
    # contiguous run; dense_rank numbers the runs (same window partitioning).
    w2 = Window.partitionBy("shard_bucket").orderBy(*parts)
    x = x.withColumn("shard_seq", (F.dense_rank().over(w2) - 1).cast("int"))
    return x.withColumn("shard", _shard_name("shard_bucket", "shard_seq")).drop("__ti", "__bi")


def hash_prefix(id_col, width: int = 2) -> Column:
    """M-05: ``00``..``99`` prefix of a record id, from the same md5 bucket
    as the shards (JVM-side, reproducible in any engine that has md5)."""
    return F.lpad(hash_bucket(id_col, 10 ** width).cast("string"), width, "0")


def shard_manifest(sharded: DataFrame, run_id: str, input_prefix: str, output_prefix: str, yearmonth: str,
                   token_col: str = "prompt_tokens", bytes_col: str = "request_bytes") -> DataFrame:
    """M-06: control table, one row per shard: input/output file (the names
    S-18 gives under ``<prefix>/<yearmonth>/``), run, status, records, tokens
    in, bytes; tokens out and duration start NULL."""
    g = sharded.groupBy("shard_bucket", "shard_seq", "shard").agg(
        F.count(F.lit(1)).alias("records"), F.sum(token_col).cast("bigint").alias("token_in"),
        F.sum(bytes_col).cast("bigint").alias("shard_bytes"))
    folder = F.lit(input_prefix.rstrip("/") + f"/{yearmonth}/"), F.lit(output_prefix.rstrip("/") + f"/{yearmonth}/")
    return g.select(
        F.col("shard").alias("shard_id"), "shard_bucket", "shard_seq",
        F.concat(folder[0], shard_file("shard")).alias("input_file"),
        F.concat(folder[1], shard_file("shard"), F.lit(".out")).alias("output_file"),
        F.lit(run_id).alias("run_id"), F.lit("PENDING").alias("status"), "records", "token_in", "shard_bytes",
        F.lit(None).cast("bigint").alias("token_out"), F.lit(None).cast("double").alias("batch_duration"))


def shard_file(shard) -> Column:
    """The file name of a shard; S-18 writes it and M-06 lists it."""
    return F.concat(F.lit("shard_"), _c(shard), F.lit(".jsonl"))


def limit_check(manifest: DataFrame, active_jobs: DataFrame, max_shard_bytes: int = 50 * 1024 * 1024,
                max_files: int = 5000, max_active_jobs: int = 10) -> DataFrame:
    """M-07: per run: shards, largest shard, and the three limit flags.

    ``active_jobs`` is a one-column DataFrame (``active_jobs``), e.g. the
    count of non-terminal batches in the log. Its total is one row (a proven
    size), attached by a broadcast equi-join on a constant key."""
    per_run = manifest.groupBy("run_id").agg(F.count(F.lit(1)).alias("shards"),
                                             F.max("shard_bytes").alias("max_shard_bytes"))
    jobs = active_jobs.agg(F.coalesce(F.sum("active_jobs"), F.lit(0)).cast("bigint").alias("active_jobs"))
    u = per_run.withColumn("__k", F.lit(1)).join(F.broadcast(jobs.withColumn("__k", F.lit(1))), "__k")
    return u.select("run_id", "shards", "max_shard_bytes", "active_jobs",
                    (F.col("max_shard_bytes") <= max_shard_bytes).alias("bytes_ok"),
                    (F.col("shards") <= max_files).alias("files_ok"),
                    (F.col("active_jobs") < max_active_jobs).alias("jobs_ok"))


def two_level_cumsum(df: DataFrame, bucket_col: str, order_col: str, value_col: str,
                     out: str = "cum") -> DataFrame:
    """Global running sum of ``value_col`` in (bucket, order) order without a
    single-task window: per-bucket totals are prefix-summed (one row per
    bucket) and broadcast back; each bucket then sums locally."""
    tot = df.groupBy(bucket_col).agg(F.sum(value_col).alias("__bt"))
    off = tot.withColumn("__off", F.coalesce(F.sum("__bt").over(
        Window.orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__bt")
    w = Window.partitionBy(bucket_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return (df.join(F.broadcast(off), bucket_col)
            .withColumn(out, F.col("__off") + F.sum(value_col).over(w)).drop("__off"))


def token_plan(manifest: DataFrame, output_tokens_per_record: int, window_minutes: float,
               daily_quota: int) -> DataFrame:
    """M-08: one row: records, tokens in/out/total, tokens per minute needed
    to finish in ``window_minutes``, and days needed under ``daily_quota``."""
    g = manifest.agg(F.sum("records").cast("bigint").alias("records"),
                     F.sum("token_in").cast("bigint").alias("tokens_in"))
    return (g.withColumn("tokens_out", F.col("records") * F.lit(output_tokens_per_record))
            .withColumn("tokens_total", F.col("tokens_in") + F.col("tokens_out"))
            .withColumn("tokens_per_minute", F.col("tokens_total") / F.lit(float(window_minutes)))
            .withColumn("days_needed", F.ceil(F.col("tokens_total") / F.lit(float(daily_quota))).cast("bigint")))


def assign_waves(manifest: DataFrame, output_tokens_per_record: int, daily_quota: int) -> DataFrame:
    """M-08: day (wave) of each shard so that a day's tokens stay under the
    quota plus one shard: ``floor((cumulative - own) / quota)`` over shards in
    (bucket, sequence) order, as a two-level prefix sum."""
    m = manifest.withColumn("__tok", F.col("token_in") + F.col("records") * F.lit(output_tokens_per_record))
    c = two_level_cumsum(m, "shard_bucket", "shard_seq", "__tok", "__cum")
    return c.select("shard_id", "__tok", F.floor((F.col("__cum") - F.col("__tok")) / F.lit(daily_quota))
                    .cast("int").alias("wave")).withColumnRenamed("__tok", "shard_tokens")


def assign_limited_waves(shards: DataFrame, order: list[str], limits: dict[str, float], name: str = "wave") -> DataFrame:
    """M-08 under several limits: consecutive shards, in the unique ``order``, go into one wave as long as the wave's sum of
    every column in ``limits`` (amounts of 0 or more, NULL counts as 0) stays within its limit; the next shard opens the next
    wave. A column of ones limits the number of files or jobs. A shard that is over a limit by itself is an error.

    No task sees all shards. Rows are numbered in ranges, and sums run per range from the ranges' totals. The wave that a shard
    would open ends where the first of its limits is passed: for each limit that place is looked up by running sum, among the
    rows in the same multiple of the limit, or else at the beginning of the next multiple that has rows. Which shards do open
    waves follows from the first by doubling the jumps from wave to wave, a join per round and as many rounds as the number of
    waves has bits; the waves' numbers come out of the same rounds.
    """
    from tidemark.operators.repair import with_row_index
    from tidemark.sources.io import stage
    cols = list(limits)
    over = [F.when(F.coalesce(F.col(c), F.lit(0)) > limits[c], F.lit(c)) for c in cols]
    message = F.concat(F.lit("a shard is over the limit of "), F.coalesce(*over))
    checked = shards.where(F.when(F.coalesce(*over).isNotNull(), F.raise_error(message)).otherwise(F.lit(True)).cast("boolean"))
    rows = with_row_index(checked, order, "__at").withColumn("__range", F.floor(F.col("__at") / WAVE_RANGE))
    totals = rows.groupBy("__range").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"__t{i}") for i, c in enumerate(cols)])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = totals.select("__range", *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__t{i}") for i in range(len(cols))])
    upto = Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    rows = stage(rows.join(totals, "__range").select(
        *shards.columns, "__at", *[(F.col(f"__t{i}") + F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto)).alias(f"__s{i}")
                                   for i, c in enumerate(cols)]))
    ends = None  # (__at, __next): the first shard that a wave opened by __at cannot hold
    for i, c in enumerate(cols):
        limit = F.lit(limits[c])
        own = F.col(f"__s{i}") - F.coalesce(F.col(c), F.lit(0))
        held = rows.select("__at", F.col(f"__s{i}").alias("__v"), F.lit(0).alias("__asks"))
        asked = rows.select("__at", (own + limit).alias("__v"), F.lit(1).alias("__asks"))
        both = held.union(asked).withColumn("__cell", F.floor(F.col("__v") / limit))
        # rows whose sum is over the asked value, from the highest down: those equal to it come after the question
        above = Window.partitionBy("__cell").orderBy(F.col("__v").desc(), F.col("__asks").desc()).rowsBetween(
            Window.unboundedPreceding, 0)
        cells = held.withColumn("__cell", F.floor(F.col("__v") / limit)).groupBy("__cell").agg(F.min("__at").alias("__first"))
        later = Window.orderBy("__cell").rowsBetween(1, Window.unboundedFollowing)  # a row per multiple of the limit
        asks = (both.withColumn("__next", F.min(F.when(F.col("__asks") == 0, F.col("__at"))).over(above)).where("__asks = 1"))
        every = (cells.unionByName(asks.select("__cell").distinct(), allowMissingColumns=True).groupBy("__cell")
                 .agg(F.min("__first").alias("__first")).select("__cell", F.min("__first").over(later).alias("__after")))
        found = (asks.join(every, "__cell")
                 .select("__at", F.coalesce("__next", "__after").alias(f"__n{i}")))
        ends = found if ends is None else ends.join(found, "__at")
    nothing = F.lit(1 << 62)
    jump = stage(ends.select("__at", F.least(*[F.coalesce(f"__n{i}", nothing) for i in range(len(cols))], nothing).alias("__to")))
    opened = jump.where("__at = 0").select("__at", F.lit(0).cast("long").alias(name))
    step = 1
    while True:  # after k rounds: all openers up to 2**k waves on, and jumps of 2**k waves
        more = (opened.join(jump, "__at").where(F.col("__to") < nothing)
                .select(F.col("__to").alias("__at"), (F.col(name) + step).alias(name)))
        if more.isEmpty():
            break
        opened = stage(opened.union(more))
        far = jump.select(F.col("__at").alias("__to"), F.col("__to").alias("__far"))
        jump = stage(jump.where(F.col("__to") < nothing).join(far, "__to").select("__at", F.col("__far").alias("__to")))
        step *= 2
    # shards of a range take the last wave opened at or before them: by range, then by the latest of the ranges before
    marked = rows.join(opened, "__at", "left").withColumn("__range", F.floor(F.col("__at") / WAVE_RANGE))
    last = marked.groupBy("__range").agg(F.max(name).alias("__last"))
    last = last.select("__range", F.max("__last").over(before).alias("__last"))
    return (marked.join(last, "__range")
            .select(*shards.columns, F.coalesce(F.max(name).over(upto), F.col("__last")).cast("int").alias(name)))


#: Shards whose sums run in one task.
WAVE_RANGE = 10_000


def validate_output(df: DataFrame, text_col: str, schema: T.StructType,
                    required: list[str] | None = None) -> DataFrame:
    """M-09 / F-15: parse model output as JSON of ``schema``; malformed text
    or missing required fields set ``is_valid`` false (PERMISSIVE parse, the
    raw text is kept)."""
    parsed = F.from_json(F.col(text_col), schema, {"mode": "PERMISSIVE"})
    required = required if required is not None else [f.name for f in schema.fields]
    x = df.withColumn("parsed", parsed)
    ok = F.col("parsed").isNotNull()
    for r in required:
        ok = ok & F.col(f"parsed.{r}").isNotNull()
    return x.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


def json_field(text_col, path: str) -> Column:
    """F-15: one field of a JSON text (``$.a.b``), NULL if absent/malformed."""
    return F.get_json_object(_c(text_col), path)


def shards_to_rerun(sharded: DataFrame, reconciled: DataFrame, id_col: str) -> DataFrame:
    """M-10: shards holding at least one missing or failed record, with counts."""
    bad = reconciled.where(F.col("status").isin("missing", "failed"))
    j = sharded.select(id_col, "shard").join(bad, id_col)
    return j.groupBy("shard").agg(F.count(F.lit(1)).alias("bad_records"))


def gold_features(events: DataFrame, entity: str, ts_col: str, value_col: str, type_col: str,
                  as_of) -> DataFrame:
    """M-12: per entity: events, value sum, purchases, distinct days active,
    last event and recency in days behind ``as_of`` (A-27 with feature
    aggregates; partial aggregation before the shuffle)."""
    g = events.groupBy(entity).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum(F.col(value_col).cast("decimal(18,2)")).alias("value_sum"),
        F.count(F.when(F.col(type_col) == "purchase", 1)).alias("purchases"),
        F.count(F.when(F.col(type_col) == "error", 1)).alias("errors"),
        F.countDistinct(F.to_date(ts_col)).alias("active_days"),
        F.max(ts_col).alias("last_event"))
    return g.withColumn("recency_days", F.datediff(F.lit(str(as_of)[:10]).cast("date"), F.to_date("last_event")))


def score_linear(df: DataFrame, coefficients: dict[str, float], intercept: float, name: str = "score",
                 logistic: bool = True) -> DataFrame:
    """M-11: score a stored linear/logistic model as a JVM expression (no
    Python per row): ``sigmoid(intercept + sum(w_i * x_i))``."""
    z = F.lit(float(intercept))
    for col, w in coefficients.items():
        z = z + F.lit(float(w)) * F.col(col).cast("double")
    s = F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) if logistic else z
    return df.withColumn(name, s)


def score_with_model(df: DataFrame, predict, feature_cols: list[str], name: str = "score") -> DataFrame:
    """M-11 for models that are not expressions: ``predict(pandas.DataFrame)
    -> array`` runs per Arrow batch via ``mapInPandas``; the model travels
    with the function closure (broadcast once per executor)."""
    out_schema = df.schema.add(name, T.DoubleType())

    def run(batches):
        for pdf in batches:
            pdf[name] = predict(pdf[feature_cols]).astype("float64")
            yield pdf

    return df.mapInPandas(run, out_schema)
