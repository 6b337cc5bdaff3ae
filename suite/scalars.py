"""Scalar-function queries: F-01..F-14, P-02, P-15, X-03 (formats as data)."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import register
from suite.fixtures import batch_log, typed_text, with_views
from tidemark.functions import hashing as hs
from tidemark.functions import text as tx
from tidemark.functions import timefn as tf
from tidemark.plans.loader import run_query
from tidemark.sources.tables import read_table

register("f01_parse_dates", with_views(
    "SELECT id, CAST(try_strptime(order_date, '%Y-%m-%d') AS DATE) AS order_date, "
    "try_strptime(order_ts, '%Y-%m-%d %H:%M:%S') AS order_ts FROM typed_text", "typed_text"))(
    lambda spark, d: typed_text(spark, d).select(
        "id", tf.parse_date("order_date").alias("order_date"),
        tf.parse_timestamp("order_ts").cast("timestamp_ntz").alias("order_ts")))

register("f02_date_arith", with_views(
    "SELECT batch_id, CAST(created_at AS DATE) AS created_date, CAST(created_at AS DATE) - INTERVAL 30 DAY "
    "AS minus_30, date_diff('day', CAST(created_at AS DATE), DATE '2001-08-02') AS age_days FROM batch_log",
    "batch_log"))(
    lambda spark, d: batch_log(spark, d).select(
        "batch_id", F.to_date("created_at").alias("created_date"),
        F.date_sub(F.to_date("created_at"), 30).alias("minus_30"),
        F.datediff(F.lit("2001-08-02").cast("date"), F.to_date("created_at")).alias("age_days")))

register("f03_clock_literal", with_views(
    "SELECT batch_id, TIMESTAMP '2001-08-02 00:00:00' AS checked_at, "
    "updated_at < TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 48 HOUR AS older_than_48h FROM batch_log",
    "batch_log"))(
    lambda spark, d: batch_log(spark, d).select(
        "batch_id", tf.ts_lit("2001-08-02 00:00:00").alias("checked_at"),
        (F.col("updated_at") < tf.hours_before("2001-08-02 00:00:00", 48)).alias("older_than_48h")))

register("f04_unix_hours", with_views(
    "SELECT batch_id, CAST(floor(epoch(completed_at)) - floor(epoch(submitted_at)) AS BIGINT) AS seconds, "
    "(CAST(floor(epoch(completed_at)) - floor(epoch(submitted_at)) AS DOUBLE) / 3600.0) AS hours "
    "FROM batch_log", "batch_log"))(
    lambda spark, d: batch_log(spark, d).select(
        "batch_id", (tf.epoch_seconds("completed_at") - tf.epoch_seconds("submitted_at")).alias("seconds"),
        tf.hours_between("submitted_at", "completed_at").alias("hours")))

register("f05_round_abs",
         "SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(l_extendedprice AS DECIMAL(18,2)) * "
         "(1 - CAST(l_discount AS DECIMAL(18,2))), 2) AS net, "
         "abs(l_quantity - 25) AS dist FROM lineitem")(
    lambda spark, d: read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(F.col("l_extendedprice").cast("decimal(18,2)")
                * (1 - F.col("l_discount").cast("decimal(18,2)")), 2).alias("net"),
        F.abs(F.col("l_quantity") - 25).alias("dist")))

register("f06_month_keys",
         "SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS ym_from_ts, "
         "CAST(year(o_orderdate) AS VARCHAR) || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS ym_from_parts "
         "FROM orders")(
    lambda spark, d: read_table(spark, d, "orders").select(
        "o_orderkey", tf.yearmonth_of("o_orderdate").alias("ym_from_ts"),
        tf.yearmonth_from_parts(F.year("o_orderdate"), F.month("o_orderdate")).alias("ym_from_parts")))

register("f07_day_path",
         "SELECT event_id, printf('store/events/year=%04d/month=%02d/day=%02d', year(ts), month(ts), day(ts)) "
         "AS day_path FROM events")(
    lambda spark, d: read_table(spark, d, "events").select(
        "event_id", tf.day_path("store/events", F.to_date("ts")).alias("day_path")))

register("f08_bool_words", with_views(
    "SELECT id, CASE WHEN lower(trim(is_active)) IN ('true','1','yes','y','t') THEN true "
    "WHEN lower(trim(is_active)) IN ('false','0','no','n','f') THEN false END AS is_active FROM typed_text",
    "typed_text"))(
    lambda spark, d: typed_text(spark, d).select("id", tx.bool_from_words("is_active").alias("is_active")))

register("f09_try_cast", with_views(
    "SELECT id, TRY_CAST(amount AS DECIMAL(18,2)) AS amount, TRY_CAST(customer_id AS BIGINT) AS customer_id "
    "FROM typed_text", "typed_text"))(
    lambda spark, d: typed_text(spark, d).select(
        "id", F.col("amount").try_cast("decimal(18,2)").alias("amount"),
        F.col("customer_id").try_cast("bigint").alias("customer_id")))


def _enc(c):
    s = f"CAST({c} AS VARCHAR)"
    return f"COALESCE(CAST(length({s}) AS VARCHAR) || ':' || {s}, '~')"


register("f10_row_hash", with_views(
    "SELECT batch_id, sha256(concat_ws('|', " + ", ".join(_enc(c) for c in
                                                      ["batch_status", "error_message", "total_prompts"]) +
    ")) AS row_hash, md5(batch_id) AS id_md5 FROM batch_log", "batch_log"))(
    lambda spark, d: batch_log(spark, d).select(
        "batch_id", hs.row_hash(["batch_status", "error_message", "total_prompts"]).alias("row_hash"),
        F.md5("batch_id").alias("id_md5")))

register("f11_coalesce_length", with_views(
    "SELECT batch_id, COALESCE(error_message, 'none') AS error_text, length(jsonl_file_path) AS path_length "
    "FROM batch_log", "batch_log"))(
    lambda spark, d: batch_log(spark, d).select(
        "batch_id", F.coalesce("error_message", F.lit("none")).alias("error_text"),
        F.length("jsonl_file_path").alias("path_length")))

register("f12_regex_names",
         "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_name || ' #' || p_brand, "
         "'[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS safe_name FROM part")(
    lambda spark, d: read_table(spark, d, "part").select(
        "p_partkey", tx.underscore_name(F.concat("p_name", F.lit(" #"), "p_brand")).alias("safe_name")))

register("f13_path_parts", with_views(
    "SELECT batch_id, string_split(jsonl_file_path, '/')[-1] AS file_name, "
    "regexp_replace(string_split(jsonl_file_path, '/')[-1], '\\.jsonl$', '') AS file_stem, "
    "'store://out/' || regexp_replace(jsonl_file_path, '^/+', '') AS output_uri FROM batch_log", "batch_log"))(
    lambda spark, d: batch_log(spark, d).select(
        "batch_id", tx.file_name("jsonl_file_path").alias("file_name"),
        tx.file_stem("jsonl_file_path").alias("file_stem"),
        tx.join_uri("store://out", "jsonl_file_path").alias("output_uri")))

register("f14_truncate",
         "SELECT doc_id, substring(text, 1, 100) AS preview FROM documents")(
    lambda spark, d: read_table(spark, d, "documents").select(
        "doc_id", tx.truncate("text", 100).alias("preview")))

register("p02_row_hash_all_columns",
         "SELECT c_custkey, sha256(concat_ws('|', " + ", ".join(
             _enc(c) for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]) +
         ")) AS row_hash FROM customer")(
    lambda spark, d: hs.hash_columns(read_table(spark, d, "customer")).select("c_custkey", "row_hash"))

register("p15_parameterised_sql",
         "SELECT o_orderpriority, COUNT(*) AS orders FROM orders WHERE o_orderstatus = 'F' "
         "GROUP BY o_orderpriority")(
    lambda spark, d: run_query(
        read_table(spark, d, "orders"),
        "SELECT o_orderpriority, COUNT(*) AS orders FROM {view} WHERE o_orderstatus = :status "
        "GROUP BY o_orderpriority", {"status": "F"}))

register("a25_table_fingerprint")(
    lambda spark, d: hs.table_fingerprint(read_table(spark, d, "lineitem")))
