"""Shared fixture views derived from the driver tables.

Each view exists twice: as a Spark DataFrame builder and as SQL text that
DuckDB runs over the same parquet files. Both derive every row from the
whole driver tables, so the work grows with the scale factor.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import read_table

# Fixed clock of the fixtures (the log's data ends on 2001-08-01).
AS_OF = dt.datetime(2001, 8, 2, 0, 0, 0)
AS_OF_SQL = "TIMESTAMP '2001-08-02 00:00:00'"
# The events table covers 2024-01-01 .. 2024-01-30.
EVENTS_LAST_DAY = dt.date(2024, 1, 30)

def _status_expr(key):
    k = key % 10
    return (F.when(k == 0, "PENDING").when(k == 1, "PROCESSING").when(k == 2, "FAILED")
            .when(k == 3, "EXPIRED").when(k == 4, "CANCELLED").otherwise("COMPLETED"))


_prepared: dict = {}


def prepare_log(spark: SparkSession, d: str, path: str) -> None:
    """Persist the log, partitioned by month as a kept log is; queries of this session then read it (the bench does so, to
    time the operators and not the fixture)."""
    batch_log(spark, d).write.partitionBy("yearmonth").parquet(path)
    _prepared[d, spark.sparkContext.applicationId] = path


def batch_log(spark: SparkSession, d: str) -> DataFrame:
    """Batch log built from orders (one batch per order) and lineitem (prompts)."""
    kept = _prepared.get((d, spark.sparkContext.applicationId))
    if kept is not None:
        df = spark.read.parquet(kept)
        return df.withColumn("yearmonth", F.col("yearmonth").cast("string"))
    orders = read_table(spark, d, "orders")
    li = (read_table(spark, d, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("n"),
               F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("bad")))
    key = F.col("o_orderkey")
    b = (orders.join(li, orders.o_orderkey == li.l_orderkey, "left")
         .select(orders["*"],
                 F.coalesce(F.col("n"), F.lit(0)).alias("n"),
                 F.coalesce(F.col("bad"), F.lit(0)).alias("bad"),
                 _status_expr(key).alias("batch_status"),
                 F.timestamp_add("HOUR", (key % 72).cast("int"), F.col("o_orderdate"))
                 .alias("updated_at")))
    st = F.col("batch_status")
    bid = F.concat(F.lit("b"), key.cast("string"))
    return b.select(
        bid.alias("batch_id"),
        F.concat(F.lit("in/part-"), (key % 100).cast("string"), F.lit(".jsonl")).alias("jsonl_file_path"),
        st,
        F.col("n").cast("int").alias("total_prompts"),
        F.when(st == "COMPLETED", F.col("n") - F.col("bad")).otherwise(0).cast("int").alias("completed_prompts"),
        F.when(st.isin("COMPLETED", "FAILED"), F.col("bad")).otherwise(0).cast("int").alias("failed_prompts"),
        F.col("o_orderdate").alias("created_at"),
        "updated_at",
        F.col("o_orderdate").alias("submitted_at"),
        F.when(st.isin("PENDING", "PROCESSING"), F.lit(None)).otherwise(F.col("updated_at")).alias("completed_at"),
        F.col("o_orderpriority").alias("model_id"),
        F.concat(F.lit("store://in/"), bid, F.lit(".jsonl")).alias("input_s3_uri"),
        F.when(st == "COMPLETED", F.concat(F.lit("store://out/"), bid)).alias("output_s3_uri"),
        F.when(st == "FAILED", F.concat(F.lit("err-"), (key % 7).cast("string"))).alias("error_message"),
        (key % 4).cast("int").alias("retry_count"),
        F.lit(3).alias("max_retries"),
        F.date_format("o_orderdate", "yyyyMM").alias("yearmonth"),
    )


BATCH_LOG_SQL = """
li AS (SELECT l_orderkey, COUNT(*) AS n,
         SUM(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS bad
       FROM lineitem GROUP BY l_orderkey),
b AS (SELECT o.*, COALESCE(li.n,0) AS n, COALESCE(li.bad,0) AS bad,
        CASE o_orderkey % 10 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'FAILED'
          WHEN 3 THEN 'EXPIRED' WHEN 4 THEN 'CANCELLED' ELSE 'COMPLETED' END AS batch_status,
        o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 72 AS INT) AS updated_at
      FROM orders o LEFT JOIN li ON o.o_orderkey = li.l_orderkey),
batch_log AS (SELECT CONCAT('b', CAST(o_orderkey AS VARCHAR)) AS batch_id,
  CONCAT('in/part-', CAST(o_orderkey % 100 AS VARCHAR), '.jsonl') AS jsonl_file_path, batch_status,
  CAST(n AS INT) AS total_prompts,
  CAST(CASE WHEN batch_status='COMPLETED' THEN n-bad ELSE 0 END AS INT) AS completed_prompts,
  CAST(CASE WHEN batch_status IN ('COMPLETED','FAILED') THEN bad ELSE 0 END AS INT) AS failed_prompts,
  o_orderdate AS created_at, updated_at, o_orderdate AS submitted_at,
  CASE WHEN batch_status IN ('PENDING','PROCESSING') THEN NULL ELSE updated_at END AS completed_at,
  o_orderpriority AS model_id,
  CONCAT('store://in/b', CAST(o_orderkey AS VARCHAR), '.jsonl') AS input_s3_uri,
  CASE WHEN batch_status='COMPLETED' THEN CONCAT('store://out/b', CAST(o_orderkey AS VARCHAR)) END AS output_s3_uri,
  CASE WHEN batch_status='FAILED' THEN CONCAT('err-', CAST(o_orderkey % 7 AS VARCHAR)) ELSE NULL END AS error_message,
  CAST(o_orderkey % 4 AS INT) AS retry_count, 3 AS max_retries,
  strftime(o_orderdate, '%Y%m') AS yearmonth
FROM b)"""


# Source states of the polled service, in the order the fixture assigns them
# by key; the last slot is a poll error (no state).
SNAPSHOT_STATES = ["InProgress", "Stopping", "Completed", "Failed", "Stopped",
                   "Submitted", "Validating"]


def status_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """One poll of every non-terminal batch: (batch_id, source_status, poll_error).

    Keys with ``key % 8 = 7`` got no state: half of them an error, the other
    half a state the mapping does not know.
    """
    log = batch_log(spark, d).where(F.col("batch_status").isin("PENDING", "PROCESSING"))
    key = F.expr("CAST(substring(batch_id, 2) AS BIGINT)")
    r = key % 8
    state = F.when(r == 0, SNAPSHOT_STATES[0])
    for i, name in enumerate(SNAPSHOT_STATES[1:], start=1):
        state = state.when(r == i, name)
    state = state.when(key % 16 != 7, "Scheduled")
    err = F.when(key % 16 == 7, F.lit("ThrottlingException: rate exceeded"))
    return log.select("batch_id", state.alias("source_status"), err.alias("poll_error"))


STATUS_SNAPSHOT_SQL = """
status_snapshot AS (SELECT batch_id,
  CASE CAST(substring(batch_id, 2) AS BIGINT) % 8
    WHEN 0 THEN 'InProgress' WHEN 1 THEN 'Stopping' WHEN 2 THEN 'Completed' WHEN 3 THEN 'Failed'
    WHEN 4 THEN 'Stopped' WHEN 5 THEN 'Submitted' WHEN 6 THEN 'Validating'
    ELSE CASE WHEN CAST(substring(batch_id, 2) AS BIGINT) % 16 != 7 THEN 'Scheduled' END END AS source_status,
  CASE WHEN CAST(substring(batch_id, 2) AS BIGINT) % 16 = 7 THEN 'ThrottlingException: rate exceeded' END AS poll_error
  FROM batch_log WHERE batch_status IN ('PENDING','PROCESSING'))"""


# Silver slice with duplicate keys: lineitem keyed by (l_orderkey, l_linenumber).
SILVER_KEYS = ["l_orderkey", "l_linenumber"]
SILVER_ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]  # all descending


def silver(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").withColumn("business_date", F.to_date("l_shipdate"))


SILVER_SQL = "silver AS (SELECT *, CAST(l_shipdate AS DATE) AS business_date FROM lineitem)"


def daily_events(spark: SparkSession, d: str) -> DataFrame:
    ev = read_table(spark, d, "events")
    return ev.select("*", F.to_date("ts").alias("event_date"), F.year("ts").alias("year"),
                     F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"))


DAILY_EVENTS_SQL = """daily_events AS (SELECT *, CAST(ts AS DATE) AS event_date,
  CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day
  FROM events)"""


def late_events(spark: SparkSession, d: str) -> DataFrame:
    """A re-delivery of the last three days: purchases carry a corrected value."""
    ev = daily_events(spark, d)
    last = F.lit(EVENTS_LAST_DAY.isoformat()).cast("date")
    return (ev.where(F.col("event_date") >= F.date_sub(last, 2))
            .withColumn("value", F.when(F.col("event_type") == "purchase", F.col("value") + 1.0)
                        .otherwise(F.col("value"))))


LATE_EVENTS_SQL = """late_events AS (SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_type = 'purchase' THEN value + 1.0 ELSE value END AS value, props,
  event_date, year, month, day
  FROM daily_events WHERE event_date >= DATE '2024-01-28')"""


NEW_CUSTOMER_OFFSET = 1_000_000_000


def customer_v2(spark: SparkSession, d: str) -> DataFrame:
    """Next version of customer: BUILDING rows changed, negative balances
    removed, every supplier added as a new customer."""
    c = read_table(spark, d, "customer")
    kept = (c.where(F.col("c_acctbal") >= 0)
            .withColumn("c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING",
                                            F.col("c_acctbal") + 100.0).otherwise(F.col("c_acctbal"))))
    s = read_table(spark, d, "supplier").select(
        (F.col("s_suppkey") + NEW_CUSTOMER_OFFSET).alias("c_custkey"),
        F.regexp_replace("s_name", "Supplier", "Customer").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"),
        F.lit("SUPPLIER").alias("c_mktsegment"))
    return kept.unionByName(s)


CUSTOMER_V2_SQL = """customer_v2 AS (
  SELECT c_custkey, c_name, c_nationkey,
         CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100.0 ELSE c_acctbal END AS c_acctbal,
         c_mktsegment
  FROM customer WHERE c_acctbal >= 0
  UNION ALL
  SELECT s_suppkey + 1000000000, regexp_replace(s_name, 'Supplier', 'Customer'), s_nationkey,
         s_acctbal, 'SUPPLIER' FROM supplier)"""


def typed_text(spark: SparkSession, d: str) -> DataFrame:
    """Orders as text, as a CSV extract would deliver them; some values malformed."""
    o = read_table(spark, d, "orders")
    pr = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(pr == "5-LOW", F.date_format("o_orderdate", "dd/MM/yyyy"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
        F.when(pr == "4-NOT SPECIFIED", F.lit("n/a"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("order_ts"),
        F.when(pr == "3-MEDIUM", F.concat(F.lit("$"), F.col("o_totalprice").cast("string")))
         .otherwise(F.format_string("%.2f", F.col("o_totalprice"))).alias("amount"),
        F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "no")
         .otherwise("maybe").alias("is_active"),
        F.col("o_custkey").cast("string").alias("customer_id"),
    )


TYPED_TEXT_SQL = """typed_text AS (SELECT CAST(o_orderkey AS VARCHAR) AS id,
  CASE WHEN o_orderpriority = '5-LOW' THEN strftime(o_orderdate, '%d/%m/%Y')
       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'n/a'
       ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS order_ts,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN CONCAT('$', CAST(o_totalprice AS VARCHAR))
       ELSE printf('%.2f', o_totalprice) END AS amount,
  CASE o_orderstatus WHEN 'F' THEN ' Yes' WHEN 'O' THEN 'no' ELSE 'maybe' END AS is_active,
  CAST(o_custkey AS VARCHAR) AS customer_id
  FROM orders)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Request rows: documents with a token estimate of ceil(chars / 4)."""
    doc = read_table(spark, d, "documents")
    return doc.select("doc_id", "text", "lang", "source",
                      F.ceil(F.length("text") / F.lit(4.0)).cast("bigint").alias("est_tokens"))


REQUESTS_SQL = """requests AS (SELECT doc_id, text, lang, source,
  CAST(ceil(length(text) / 4.0) AS BIGINT) AS est_tokens FROM documents)"""


# name -> (sql, dependencies)
VIEW_SQL = {
    "batch_log": (BATCH_LOG_SQL, []),
    "status_snapshot": (STATUS_SNAPSHOT_SQL, ["batch_log"]),
    "silver": (SILVER_SQL, []),
    "daily_events": (DAILY_EVENTS_SQL, []),
    "late_events": (LATE_EVENTS_SQL, ["daily_events"]),
    "customer_v2": (CUSTOMER_V2_SQL, []),
    "typed_text": (TYPED_TEXT_SQL, []),
    "requests": (REQUESTS_SQL, []),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with a WITH clause defining the named fixture views."""
    ordered: list[str] = []

    def visit(n):
        for dep in VIEW_SQL[n][1]:
            visit(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    parts = [VIEW_SQL[n][0].strip() for n in ordered]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
