"""Request-dataset queries over ``documents``/``labels``/``events``: M-01..M-12,
J-10 (new log rows per shard), F-15, F-16."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from suite import register
from suite.fixtures import batch_log, requests, with_views
from tidemark.operators import joblog as jl
from tidemark.operators import merge as mg
from tidemark.operators import requests as rq
from tidemark.sources import io
from tidemark.sources.tables import read_table

TEMPLATE = "Summarize the following %s text from %s:\n%s"
FIELDS = ["lang", "source", "text"]
MAX_OUT = 2048
ROWS_PER_BUCKET = 200            # M-03 buckets follow the row count, M-04 buckets the bytes
BYTES_PER_BUCKET = 400_000
MANY_BUCKETS = 20_000
MONTH = "202402"
PER_SHARD = 50
TOKEN_BUDGET = 20_000
BYTE_BUDGET = 80_000
RUN = "run-202402"
AS_OF = dt.datetime(2024, 2, 1)

_PROMPT_SQL = "printf('Summarize the following %s text from %s:\n%s', lang, source, text)"
_REQ_JSON_SQL = ("to_json({'recordId': CAST(doc_id AS VARCHAR), 'modelInput': {'prompt': " + _PROMPT_SQL +
                 f", 'max_tokens': {MAX_OUT}}}}})")
M01_SQL = (f"SELECT doc_id AS record_id, {_REQ_JSON_SQL} AS request, "
           f"CAST(ceil(length({_PROMPT_SQL}) / 4.0) AS BIGINT) AS prompt_tokens, "
           f"CAST(strlen({_REQ_JSON_SQL}) AS BIGINT) AS request_bytes FROM documents")


def _built(spark, d):
    return rq.build_requests(read_table(spark, d, "documents"), "doc_id", TEMPLATE, FIELDS, max_tokens=MAX_OUT)


register("m01_build_requests", M01_SQL)(_built)

register("m02_within_token_limit", f"SELECT record_id, prompt_tokens FROM ({M01_SQL}) WHERE prompt_tokens <= 4000")(
    lambda spark, d: rq.token_limit_split(_built(spark, d), 4000)[0].select("record_id", "prompt_tokens"))
register("m02_over_token_limit", f"SELECT record_id, prompt_tokens FROM ({M01_SQL}) "
         "WHERE NOT COALESCE(prompt_tokens <= 4000, false)")(
    lambda spark, d: rq.token_limit_split(_built(spark, d), 4000)[1].select("record_id", "prompt_tokens"))

def _bucket_sql(id_col: str, buckets: str) -> str:
    return (f"CAST(CAST(('0x' || substr(md5(CAST({id_col} AS VARCHAR)), 1, 8)) AS BIGINT) % ({buckets}) AS INT)")


_BY_ROWS = f"(SELECT greatest(1, CAST(ceil(COUNT(*) / {ROWS_PER_BUCKET}.0) AS BIGINT)) FROM documents)"
_BY_BYTES = (f"(SELECT greatest(1, CAST(ceil(COALESCE(SUM(request_bytes), 0) / {BYTES_PER_BUCKET}.0) AS BIGINT)) "
             f"FROM ({M01_SQL}))")


def _name_sql(b, s):
    return f"printf('%04d-%05d', {b}, {s})"


def _m03_sql(buckets: str, per_shard: int) -> str:
    return ("SELECT doc_id, shard_bucket, shard_seq, " + _name_sql("shard_bucket", "shard_seq") + " AS shard FROM ("
            "SELECT doc_id, shard_bucket, CAST(floor((row_number() OVER (PARTITION BY shard_bucket ORDER BY doc_id) - 1)"
            f" / {per_shard}) AS INT) AS shard_seq FROM (SELECT doc_id, " + _bucket_sql("doc_id", buckets) +
            " AS shard_bucket FROM documents))")


M03_SQL = _m03_sql(_BY_ROWS, PER_SHARD)


def _by_count(spark, d):
    ids = read_table(spark, d, "documents").select("doc_id")
    return rq.shard_by_count(ids, "doc_id", PER_SHARD, rq.bucket_count(ids, None, ROWS_PER_BUCKET))


register("m03_shard_by_count", M03_SQL)(_by_count)

# More buckets than four digits name, and one record per shard: every (bucket, sequence) keeps a name of its own.
register("m03_many_buckets", _m03_sql(str(MANY_BUCKETS), 1))(
    lambda spark, d: rq.shard_by_count(read_table(spark, d, "documents").select("doc_id"), "doc_id", 1, MANY_BUCKETS))

M04_SQL = (
    "WITH r AS (" + M01_SQL + "), b AS (SELECT *, " + _bucket_sql("record_id", "@BUCKETS@") + " AS shard_bucket FROM r), "
    "c AS (SELECT *, CAST(floor((SUM(prompt_tokens) OVER w - prompt_tokens) / " + str(TOKEN_BUDGET) +
    ") AS BIGINT) AS ti, CAST(floor((SUM(request_bytes) OVER w - request_bytes) / " + str(BYTE_BUDGET) +
    ") AS BIGINT) AS bi FROM b WINDOW w AS (PARTITION BY shard_bucket ORDER BY record_id ROWS BETWEEN "
    "UNBOUNDED PRECEDING AND CURRENT ROW)), "
    "s AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY shard_bucket ORDER BY ti, bi) - 1 AS INT) AS shard_seq "
    "FROM c) SELECT record_id, prompt_tokens, request_bytes, shard_bucket, shard_seq, "
    + _name_sql("shard_bucket", "shard_seq") + " AS shard FROM s")
M04_MANY_SQL = M04_SQL.replace("@BUCKETS@", str(MANY_BUCKETS))
M04_SQL = M04_SQL.replace("@BUCKETS@", _BY_BYTES)


def sharded(spark, d, buckets=None):
    """M-04 over all requests, the request text kept."""
    built = _built(spark, d)
    n = buckets or rq.bucket_count(built, per_bucket=BYTES_PER_BUCKET)
    return rq.shard_by_budget(built, "record_id", n, token_budget=TOKEN_BUDGET, byte_budget=BYTE_BUDGET)


def _by_budget(spark, d):
    return sharded(spark, d).drop("request")


register("m04_shard_by_budget", M04_SQL)(_by_budget)
register("m04_many_buckets", M04_MANY_SQL)(lambda spark, d: sharded(spark, d, MANY_BUCKETS).drop("request"))

register("m05_hash_prefix",
         "SELECT doc_id, lang, lpad(CAST(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 "
         f"AS VARCHAR), 2, '0') AS hash_prefix, '{RUN}' AS run_id FROM documents")(
    lambda spark, d: read_table(spark, d, "documents").select(
        "doc_id", "lang", rq.hash_prefix("doc_id").alias("hash_prefix"), F.lit(RUN).alias("run_id")))

M06_SQL = (f"SELECT shard AS shard_id, shard_bucket, shard_seq, 'in/{RUN}/{MONTH}/shard_' || shard || '.jsonl' AS input_file, "
           f"'out/{RUN}/{MONTH}/shard_' || shard || '.jsonl.out' AS output_file, '{RUN}' AS run_id, 'PENDING' AS status, "
           "COUNT(*) AS records, CAST(SUM(prompt_tokens) AS BIGINT) AS token_in, "
           "CAST(SUM(request_bytes) AS BIGINT) AS shard_bytes, CAST(NULL AS BIGINT) AS token_out, "
           f"CAST(NULL AS DOUBLE) AS batch_duration FROM ({M04_SQL}) GROUP BY shard, shard_bucket, shard_seq")


def _manifest(spark, d):
    return rq.shard_manifest(_by_budget(spark, d), RUN, f"in/{RUN}", f"out/{RUN}", MONTH)


register("m06_shard_manifest", M06_SQL)(_manifest)


def _m06_files(spark, d):
    """The manifest beside the files on storage: records of each listed file as written (NULL: no such file)."""
    from suite.loading import scratch
    base = scratch(spark, "m06")
    sh = sharded(spark, d)
    io.write_shards_jsonl(sh, base, MONTH)
    listed = rq.shard_manifest(sh, RUN, base, base, MONTH).select("shard_id", "input_file", "records")
    lines = (spark.read.text(f"{base}/{MONTH}").groupBy(F.regexp_extract(F.col("_metadata.file_path"), r"[^/]*$", 0).alias("f"))
             .agg(F.count(F.lit(1)).alias("records_written")))
    return (listed.join(lines, F.col("f") == F.regexp_extract("input_file", r"[^/]*$", 0), "full")
            .select("shard_id", F.col("f").alias("file"), "records", "records_written"))


register("m06_manifest_files", f"SELECT shard_id, 'shard_' || shard_id || '.jsonl' AS file, records, records AS records_written "
         f"FROM ({M06_SQL})")(_m06_files)

# The rerun layout: one folder per run, language segment and hash prefix.
M05_RUN_SQL = ("SELECT doc_id, lang, lpad(CAST(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 "
               f"AS VARCHAR), 2, '0') AS hash_prefix, '{RUN}' AS run_id FROM documents")


def _m05_layout(spark, d):
    from suite.loading import scratch
    path = scratch(spark, "m05")
    df = read_table(spark, d, "documents").select(
        "doc_id", "lang", F.lit(RUN).alias("run_id"), F.col("lang").alias("segment"), rq.hash_prefix("doc_id").alias("hash_prefix"))
    (df.repartition("run_id", "segment", "hash_prefix").write.partitionBy("run_id", "segment", "hash_prefix").parquet(path))
    schema = "doc_id long, lang string, run_id string, segment string, hash_prefix string"
    back = spark.read.schema(schema).parquet(path)
    return back.where(F.col("segment").eqNullSafe(F.col("lang"))).select("doc_id", "lang", "hash_prefix", "run_id")


register("m05_rerun_layout", M05_RUN_SQL)(_m05_layout)


def _m07(spark, d):
    active = jl.non_terminal(batch_log(spark, d)).agg(F.count(F.lit(1)).alias("active_jobs"))
    return rq.limit_check(_manifest(spark, d), active)


register("m07_limit_check", with_views(
    f"WITH m AS ({M06_SQL}), j AS (SELECT COUNT(*) AS active_jobs FROM batch_log WHERE batch_status IN "
    "('PENDING','PROCESSING')) SELECT run_id, COUNT(*) AS shards, MAX(shard_bytes) AS max_shard_bytes, "
    "MAX(j.active_jobs) AS active_jobs, MAX(shard_bytes) <= 52428800 AS bytes_ok, COUNT(*) <= 5000 AS files_ok, "
    "MAX(j.active_jobs) < 10 AS jobs_ok FROM m, j GROUP BY run_id", "batch_log"))(_m07)

register("m08_token_plan",
         f"SELECT CAST(SUM(records) AS BIGINT) AS records, CAST(SUM(token_in) AS BIGINT) AS tokens_in, "
         f"CAST(SUM(records) AS BIGINT) * {MAX_OUT} AS tokens_out, "
         f"CAST(SUM(token_in) AS BIGINT) + CAST(SUM(records) AS BIGINT) * {MAX_OUT} AS tokens_total, "
         f"(CAST(SUM(token_in) AS BIGINT) + CAST(SUM(records) AS BIGINT) * {MAX_OUT}) / 120.0 AS tokens_per_minute, "
         f"CAST(ceil((CAST(SUM(token_in) AS BIGINT) + CAST(SUM(records) AS BIGINT) * {MAX_OUT}) / 500000.0) "
         f"AS BIGINT) AS days_needed FROM ({M06_SQL})")(
    lambda spark, d: rq.token_plan(_manifest(spark, d), MAX_OUT, 120, 500_000))

register("m08_waves",
         f"SELECT shard_id, token_in + records * {MAX_OUT} AS shard_tokens, "
         f"CAST(floor((SUM(token_in + records * {MAX_OUT}) OVER (ORDER BY shard_bucket, shard_seq ROWS BETWEEN UNBOUNDED "
         f"PRECEDING AND CURRENT ROW) - (token_in + records * {MAX_OUT})) / 500000) AS INT) AS wave "
         f"FROM ({M06_SQL})")(
    lambda spark, d: rq.assign_waves(_manifest(spark, d), MAX_OUT, 500_000))

OUT_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                           T.StructField("toxic", T.IntegerType())])


def _outputs(spark, d):
    """Model outputs derived from labels: toxic rows come back truncated."""
    lab = read_table(spark, d, "labels")
    js = F.to_json(F.struct("doc_id", "quality", "toxic"))
    return lab.select("doc_id", F.when(F.col("toxic") == 1, F.expr("substring(to_json(struct(doc_id, quality, "
                                                                    "toxic)), 1, 20)")).otherwise(js).alias("output"))


_OUT_SQL = ("SELECT doc_id, CASE WHEN toxic = 1 THEN substring(CAST(to_json({'doc_id': doc_id, 'quality': quality, "
            "'toxic': toxic}) AS VARCHAR), 1, 20) ELSE CAST(to_json({'doc_id': doc_id, 'quality': quality, "
            "'toxic': toxic}) AS VARCHAR) END AS output FROM labels")

register("m09_validate_output",
         f"SELECT doc_id, json_valid(output) AND json_extract(j, '$.doc_id') IS NOT NULL AND "
         f"json_extract(j, '$.quality') IS NOT NULL AND json_extract(j, '$.toxic') IS NOT NULL AS is_valid, "
         f"CAST(json_extract_string(j, '$.quality') AS INT) AS quality FROM (SELECT *, CASE WHEN json_valid(output) "
         f"THEN output ELSE '{{}}' END AS j FROM ({_OUT_SQL}))")(
    lambda spark, d: rq.validate_output(_outputs(spark, d), "output", OUT_SCHEMA)
    .select("doc_id", "is_valid", rq.json_field("output", "$.quality").cast("int").alias("quality")))


def _m10(spark, d):
    rec = mg.reconcile_results(requests(spark, d), read_table(spark, d, "labels"), "doc_id")
    return rq.shards_to_rerun(_by_count(spark, d), rec, "doc_id")


register("m10_shards_to_rerun",
         f"SELECT s.shard, COUNT(*) AS bad_records FROM ({M03_SQL}) s WHERE NOT EXISTS "
         "(SELECT 1 FROM labels l WHERE l.doc_id = s.doc_id) GROUP BY s.shard")(_m10)


def _gold(spark, d):
    return rq.gold_features(read_table(spark, d, "events"), "user_id", "ts", "value", "event_type", AS_OF)


GOLD_SQL = ("SELECT user_id, COUNT(*) AS event_count, SUM(CAST(value AS DECIMAL(18,2))) AS value_sum, "
            "COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchases, "
            "COUNT(*) FILTER (WHERE event_type = 'error') AS errors, COUNT(DISTINCT CAST(ts AS DATE)) AS active_days, "
            "MAX(ts) AS last_event, date_diff('day', CAST(MAX(ts) AS DATE), DATE '2024-02-01') AS recency_days "
            "FROM events GROUP BY user_id")
register("m12_gold_features", GOLD_SQL)(_gold)

COEF = {"event_count": 0.01, "purchases": 0.05, "errors": -0.08, "recency_days": -0.1}
INTERCEPT = -1.5
register("m11_score_linear",
         "SELECT user_id, round(1.0 / (1.0 + exp(-(" + str(INTERCEPT) + " + " +
         " + ".join(f"{w} * CAST({c} AS DOUBLE)" for c, w in COEF.items()) + "))), 6) AS score FROM (" +
         GOLD_SQL + ")")(
    lambda spark, d: rq.score_linear(_gold(spark, d), COEF, INTERCEPT)
    .select("user_id", F.round("score", 6).alias("score")))


def _j10(spark, d):
    m = _manifest(spark, d)
    batches = m.select(F.concat(F.lit("batch-"), F.col("shard_id")).alias("batch_id"),
                       F.col("input_file").alias("jsonl_file_path"),
                       F.col("records").cast("int").alias("total_prompts"))
    return jl.new_log_rows(batches, AS_OF, model_id="model-a", job_name="monthly", job_run_id=RUN)


register("j10_new_log_rows",
         "SELECT 'batch-' || shard_id AS batch_id, input_file AS jsonl_file_path, 'PENDING' AS batch_status, "
         "CAST(records AS INT) AS total_prompts, 0 AS completed_prompts, 0 AS failed_prompts, "
         "TIMESTAMP '2024-02-01 00:00:00' AS created_at, TIMESTAMP '2024-02-01 00:00:00' AS updated_at, "
         "TIMESTAMP '2024-02-01 00:00:00' AS submitted_at, CAST(NULL AS TIMESTAMP) AS completed_at, "
         "'model-a' AS model_id, CAST(NULL AS VARCHAR) AS input_s3_uri, CAST(NULL AS VARCHAR) AS output_s3_uri, "
         "CAST(NULL AS VARCHAR) AS error_message, 0 AS retry_count, 3 AS max_retries, 'monthly' AS job_name, "
         f"'{RUN}' AS job_run_id, DATE '2024-02-01' AS created_date, '202402' AS yearmonth FROM ({M06_SQL})")(_j10)

register("f15_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")(
    lambda spark, d: read_table(spark, d, "events").select(
        "event_id", rq.json_field("props", "$.k").cast("int").alias("k")))

register("f16_token_estimate", with_views(
    "SELECT lang, COUNT(*) AS docs, CAST(SUM(est_tokens) AS BIGINT) AS tokens FROM requests GROUP BY lang",
    "requests"))(lambda spark, d: requests(spark, d).groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("est_tokens").cast("bigint").alias("tokens")))


WAVE_LIMITS = {"token_in": 3 * TOKEN_BUDGET, "shard_bytes": 5 * BYTE_BUDGET // 2, "files": 5}


def _limited_waves(spark, d):
    shards = _manifest(spark, d).select("shard_id", "shard_bucket", "shard_seq", "token_in", "shard_bytes", F.lit(1).alias("files"))
    return rq.assign_limited_waves(shards, ["shard_bucket", "shard_seq"], WAVE_LIMITS).select("shard_id", "wave")


_FITS = " AND ".join(f"w.{a} + m.{a} <= {WAVE_LIMITS[a]}" for a in WAVE_LIMITS)
register("m08_limited_waves", "WITH RECURSIVE m AS (SELECT shard_id, token_in, shard_bytes, 1 AS files, row_number() OVER (ORDER BY "
         f"shard_bucket, shard_seq) AS i FROM ({M06_SQL})), w AS (SELECT i, shard_id, 0 AS wave, token_in, shard_bytes, files FROM m "
         f"WHERE i = 1 UNION ALL SELECT m.i, m.shard_id, CASE WHEN {_FITS} THEN w.wave ELSE w.wave + 1 END, "
         + ", ".join(f"CASE WHEN {_FITS} THEN w.{a} ELSE 0 END + m.{a}" for a in WAVE_LIMITS)
         + " FROM w JOIN m ON m.i = w.i + 1) SELECT shard_id, CAST(wave AS INTEGER) AS wave FROM w")(_limited_waves)
