"""Scan, catalog, batch-ingest and load-bookkeeping queries: S-01, S-03, S-21,
P-01, A-28..A-30, Q-12, plus J-09, L-01, X-01 and X-02."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from suite import register
from suite.fixtures import silver, with_views
from suite.joblog import L, SNAPSHOT_APPLY_SQL, _applied
from suite.loading import _layout, scratch
from tidemark.operators import repair as rp
from tidemark.operators import requests as rq
from tidemark.plans import bronze, loader, repair as rplan
from tidemark.sources import io
from tidemark.sources.tables import read_table

# ------------------------------------------------------------------ S-01, S-03

register("s01_parquet_scan",
         "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'")(
    lambda spark, d: read_table(spark, d, "lineitem")
    .where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    .select("l_orderkey", "l_linenumber", "l_quantity"))


@register("s03_catalog_scan",
          "SELECT o_orderpriority, COUNT(*) AS orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) "
          "AS total "
          "FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def s03(spark, d):
    read_table(spark, d, "orders").createOrReplaceTempView("orders_catalog")
    assert io.read_catalog(spark, table="orders_catalog").columns[0] == "o_orderkey"
    return io.read_catalog(spark, query=(
        "SELECT o_orderpriority, COUNT(*) AS orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) "
        "AS DECIMAL(18,2)) AS total FROM orders_catalog WHERE o_orderstatus = :status GROUP BY o_orderpriority"),
        args={"status": "F"})


# ------------------------------------------------------------------ S-21

@register("s21_batch_ingest",
          "SELECT 'customer' AS table_name, 'success' AS status, COUNT(*) AS rows FROM customer "
          "UNION ALL SELECT 'orders_1998', 'success', COUNT(*) FROM orders WHERE year(o_orderdate) = 1998 "
          "UNION ALL SELECT 'missing', 'failed', 0")
def s21(spark, d):
    base = scratch(spark, "s21")
    read_table(spark, d, "customer").write.option("header", "true").csv(f"{base}/in/customer")
    specs = [loader.IngestSpec(f"{base}/in/customer", "csv", f"{base}/out/customer"),
             loader.IngestSpec(f"{d}/orders.parquet", "parquet", f"{base}/out/orders_1998",
                               query="SELECT * FROM {view} WHERE year(o_orderdate) = 1998"),
             loader.IngestSpec(f"{base}/in/absent", "json", f"{base}/out/missing")]
    return loader.batch_ingest(spark, specs).select("table_name", "status", "rows")


# ------------------------------------------------------------------ P-01

register("p01_load_metadata",
         "SELECT o_orderkey, o_orderstatus, TIMESTAMP '2024-02-01 06:00:00' AS _ingested_at, "
         "'orders.parquet' AS source_file_name, 'warehouse/orders' AS _source_root, '3' AS _pipeline_version "
         "FROM orders")(
    lambda spark, d: bronze.add_load_metadata(
        read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), dt.datetime(2024, 2, 1, 6, 0),
        "warehouse/orders", "3")
    .withColumn("source_file_name", F.regexp_extract("_source_file", r"([^/]+)$", 1)).drop("_source_file"))


# ------------------------------------------------------------------ A-28, A-29

def _full_load(spark, d):
    from suite.drift import FORMATS, MAPPING, PART, write_drifting_source
    return bronze.full_load(spark, write_drifting_source(spark, d), PART, MAPPING, scratch(spark, "bronze"),
                            dt.datetime(2024, 2, 1), "1", FORMATS)


register("a28_load_summary",
         "SELECT COUNT(DISTINCT year(o_orderdate)) AS partitions_ok, CAST(0 AS BIGINT) AS partitions_failed, "
         "COUNT(*) AS total_rows, 'amount,biz_date,customer_id,is_active,transaction_date' AS drifted_columns "
         "FROM orders")(
    lambda spark, d: _full_load(spark, d)["summary"]
    .withColumn("drifted_columns", F.array_join("drifted_columns", ",")))

register("a29_partition_status",
         "SELECT CAST(year(o_orderdate) AS VARCHAR) AS report_date, COUNT(*) AS record_count, 'loaded' AS status, "
         "CAST(NULL AS VARCHAR) AS error FROM orders GROUP BY 1")(
    lambda spark, d: (lambda out: bronze.partition_status(out["partitions"], out["failed"], "report_date"))(
        _full_load(spark, d)))


# ------------------------------------------------------------------ A-30

@register("a30_load_log", with_views(
    "SELECT 'run-0115' AS job_run_id, DATE '2024-01-16' AS run_date, 'year=2024/month=01/day=15' "
    "AS partition_loaded, 1 AS tables_processed, COUNT(*) AS rows_loaded, "
    "TIMESTAMP '2024-01-16 06:00:00' AS run_timestamp FROM daily_events WHERE event_date = DATE '2024-01-15'",
    "daily_events"))
def a30(spark, d):
    base = scratch(spark, "a30")
    cfg = loader.TableLoad(source=_layout(spark, d, "events"), target=f"{base}/events", mode="append",
                           name="events")
    as_of = dt.datetime(2024, 1, 16, 6, 0)
    res = loader.load_daily(spark, [cfg], as_of).collect()   # one row per table
    loader.log_execution(spark, f"{base}/_load_log", "run-0115", as_of.date(), res[0]["partition_loaded"],
                         len(res), as_of, sum(r["rows"] for r in res))
    return spark.read.parquet(f"{base}/_load_log")


# ------------------------------------------------------------------ Q-12

BACKFILL_MONTH = (1995, 6)
_AGGS_SQL = ("COUNT(*) AS line_count, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS sum_qty, "
             "SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS sum_price")


def _rollup_aggs():
    return [F.count(F.lit(1)).alias("line_count"),
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("sum_qty"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("sum_price")]


@register("q12_backfill_month", with_views(
    "SELECT l_returnflag, l_linestatus, business_date, " + _AGGS_SQL + ", strftime(business_date, '%Y-%m') "
    "AS business_month FROM silver GROUP BY l_returnflag, l_linestatus, business_date", "silver"))
def q12(spark, d):
    """The daily rollup table lacks one month; backfill it from bronze."""
    y, m = BACKFILL_MONTH
    bronze_df = silver(spark, d)
    keys = ["l_returnflag", "l_linestatus"]
    month = F.date_format("business_date", "yyyy-MM")
    full = (bronze_df.groupBy(*keys, "business_date").agg(*_rollup_aggs()).withColumn("business_month", month))
    path = scratch(spark, "q12")
    full.where(month != f"{y}-{m:02d}").write.partitionBy("business_month").parquet(path)
    rplan.backfill_month(spark, bronze_df.withColumn("business_month", month), path, "business_date", y, m,
                         keys + ["business_month"], _rollup_aggs(), ["business_month"])
    return spark.read.parquet(path)


# ------------------------------------------------------------------ J-09

register("j09_poll_error_path", L(
    "SELECT * FROM (" + SNAPSHOT_APPLY_SQL + ") WHERE poll_outcome IN ('retry', 'gave_up')", "status_snapshot"))(
    lambda spark, d: _applied(spark, d).where(F.col("poll_outcome").isin("retry", "gave_up")))


# ------------------------------------------------------------------ L-01

register("l01_sort",
         "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders "
         "ORDER BY o_orderdate, o_totalprice DESC, o_orderkey")(
    lambda spark, d: read_table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    .orderBy("o_orderdate", F.col("o_totalprice").desc(), "o_orderkey"))


# ------------------------------------------------------------------ X-01, X-02

_WORD = re.compile(r"[^ \t\n\r\f]+")

register("x01_token_count_udf",
         r"SELECT doc_id, CAST(COALESCE(len(regexp_extract_all(text, '[^ \t\n\r\f]+')), 0) AS BIGINT) AS tokens "
         "FROM documents")(
    lambda spark, d: read_table(spark, d, "documents").select("doc_id", rq.count_matches("text", _WORD.pattern).alias("tokens")))

register("x02_caller_aggregates", with_views(
    "SELECT l_returnflag, business_date, COUNT(DISTINCT l_partkey) AS parts, MIN(l_quantity) AS min_qty, "
    "CAST(SUM(CAST(l_tax AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS tax_sum, "
    "COUNT(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM silver "
    "WHERE business_date BETWEEN DATE '1998-09-01' AND DATE '1998-09-30' GROUP BY l_returnflag, business_date",
    "silver"))(
    lambda spark, d: rp.rollup(
        silver(spark, d), ["l_returnflag"], "business_date", "1998-09-01", "1998-09-30",
        [F.countDistinct("l_partkey").alias("parts"), F.min("l_quantity").alias("min_qty"),
         F.sum(F.col("l_tax").cast("decimal(18,4)")).cast("decimal(28,4)").alias("tax_sum"),
         F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("discounted")]))
