"""Drift queries: S-05, T-01..T-03, T-08, T-09, A-21, A-22, Q-13 over a
drifting ``report_date=`` layout that Spark writes from ``orders``."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from suite import register
from tidemark.operators import drift as dr
from tidemark.operators import quality as qa
from tidemark.operators import repair as rp
from tidemark.session import checkpoint_dir
from tidemark.sources import io
from tidemark.sources.tables import read_table

PART = "report_date"
MAPPING = {
    "biz_date": T.DateType(),
    "amount": T.DecimalType(18, 2),
    "transaction_date": T.TimestampNTZType(),
    "customer_id": T.StringType(),
    "is_active": T.BooleanType(),
}
FORMATS = {"biz_date": "yyyy-MM-dd", "transaction_date": "yyyy-MM-dd HH:mm:ss"}

_written: dict = {}


def variant(spark, d: str, kind: str):
    """All orders in one of three schema variants: the types of five columns differ, and ``mixed`` has one column more."""
    o = read_table(spark, d, "orders")
    st = F.col("o_orderstatus")
    common = [F.col("o_orderkey").alias("id"), F.year("o_orderdate").cast("string").alias(PART)]
    if kind == "text":
        return o.select(
            *common, F.date_format("o_orderdate", "yyyy-MM-dd").alias("biz_date"),
            F.col("o_totalprice").alias("amount"),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("transaction_date"),
            F.col("o_custkey").alias("customer_id"),
            F.when(st == "F", "yes").when(st == "O", "No").otherwise("maybe").alias("is_active"))
    if kind == "typed":
        return o.select(
            *common, F.to_date("o_orderdate").alias("biz_date"),
            F.col("o_totalprice").cast("decimal(10,0)").alias("amount"),
            F.col("o_orderdate").alias("transaction_date"),
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.when(st == "F", True).when(st == "O", False).alias("is_active"))
    return o.select(
        *common, F.col("o_orderdate").alias("biz_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("transaction_date"),
        F.col("o_custkey").cast("int").alias("customer_id"),
        F.when(st == "F", 1).when(st == "O", 0).alias("is_active"),
        F.col("o_orderpriority").alias("channel"))


def write_drifting_source(spark, d: str) -> str:
    """Write orders as yearly ``report_date=`` partitions in three schema
    variants (types of five columns change, one column appears later)."""
    key = (d, spark.sparkContext.applicationId)
    if key in _written and io.path_exists(spark, _written[key]):
        return _written[key]
    tag = hashlib.sha1(d.encode()).hexdigest()[:8]
    base = os.path.join(checkpoint_dir(spark), "fixtures", f"drift-{tag}-{uuid.uuid4().hex[:8]}")
    year = F.col(PART).cast("int")
    a, b, c = (variant(spark, d, k).where(w) for k, w in (
        ("text", year <= 1996), ("typed", (year >= 1997) & (year <= 1998)), ("mixed", year >= 1999)))
    for part in (a, b, c):
        part.write.mode("append").partitionBy(PART).parquet(base)
    _written[key] = base
    return base


ALIGNED_SQL = """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS biz_date,
  CASE WHEN year(o_orderdate) BETWEEN 1997 AND 1998
       THEN CAST(CAST(o_totalprice AS DECIMAL(10,0)) AS DECIMAL(18,2))
       ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
  CASE WHEN year(o_orderdate) >= 1999 AND o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END
    AS transaction_date,
  CAST(o_custkey AS VARCHAR) AS customer_id,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS is_active,
  CASE WHEN year(o_orderdate) >= 1999 THEN o_orderpriority END AS channel,
  CAST(year(o_orderdate) AS VARCHAR) AS report_date
FROM orders"""


def aligned(spark, d):
    base = write_drifting_source(spark, d)
    return dr.load_aligned(spark, base, PART, MAPPING, FORMATS)


register("t08_align_partitions", ALIGNED_SQL)(aligned)

register("s05_partition_values",
         "SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS report_date FROM orders ORDER BY 1")(
    lambda spark, d: dr.partition_values(spark, write_drifting_source(spark, d), PART))


def _schemas(spark, d):
    return dr.partition_schemas(spark, write_drifting_source(spark, d), PART)


# The types that the fixture writes, per column and range of years.
_TYPES = [("id", "bigint", 0, 9999), ("biz_date", "string", 0, 1996), ("biz_date", "date", 1997, 1998),
          ("biz_date", "timestamp_ntz", 1999, 9999), ("amount", "double", 0, 1996), ("amount", "decimal(10,0)", 1997, 1998),
          ("amount", "decimal(18,2)", 1999, 9999), ("transaction_date", "string", 0, 1996),
          ("transaction_date", "timestamp_ntz", 1997, 1998), ("transaction_date", "string", 1999, 9999),
          ("customer_id", "bigint", 0, 1996), ("customer_id", "string", 1997, 1998), ("customer_id", "int", 1999, 9999),
          ("is_active", "string", 0, 1996), ("is_active", "boolean", 1997, 1998), ("is_active", "int", 1999, 9999),
          ("channel", "string", 1999, 9999)]
T01_SQL = ("WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), t(c, t, a, b) AS (VALUES " +
           ", ".join(f"('{c}', '{t}', {a}, {b})" for c, t, a, b in _TYPES) +
           ") SELECT CAST(y AS VARCHAR) AS report_date, c AS column_name, t AS data_type, NOT (c = 'is_active' AND t = 'string') AS nullable, "
           "CAST(NULL AS VARCHAR) AS error FROM y, t WHERE y BETWEEN a AND b")
_T02_SQL = ("SELECT column_name, data_type, COUNT(*) AS partitions, MIN(report_date) AS first_partition, "
            "MAX(report_date) AS last_partition FROM ({src}) GROUP BY 1, 2")
# every k-th partition, the first and the last (L-04)
_SAMPLED = (f"SELECT t.* FROM ({T01_SQL}) t JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, COUNT(*) OVER () AS n FROM "
            f"(SELECT DISTINCT report_date AS v FROM ({T01_SQL}))) p ON t.report_date = p.v "
            "WHERE i % greatest(1, n // 3) = 0 OR i = n - 1")

register("t01_partition_schemas", T01_SQL)(lambda spark, d: _schemas(spark, d).drop("partition_dir"))
register("t02_drift_map", _T02_SQL.format(src=T01_SQL))(lambda spark, d: dr.drift_map(_schemas(spark, d), PART))
# T-02 with sampling: footers of every k-th partition only (first and last kept, L-04)
register("t02_drift_map_sampled", _T02_SQL.format(src=_SAMPLED))(lambda spark, d: dr.drift_map(
    dr.partition_schemas(spark, write_drifting_source(spark, d), PART, sample_size=3), PART))
register("t03_drift_report",
         f"WITH x AS ({T01_SQL}), m AS (SELECT column_name, COUNT(DISTINCT data_type) AS type_count FROM x GROUP BY 1 "
         "HAVING COUNT(DISTINCT data_type) > 1), r AS (SELECT x.*, row_number() OVER (PARTITION BY column_name, data_type "
         "ORDER BY report_date) AS rn FROM x) SELECT column_name, data_type, COUNT(*) AS partitions, "
         "string_agg(report_date, ',' ORDER BY report_date) FILTER (WHERE rn <= 3) AS example_partitions, any_value(type_count) AS type_count "
         "FROM r JOIN m USING (column_name) GROUP BY 1, 2")(lambda spark, d: dr.drift_report(
             _schemas(spark, d), PART, 3).withColumn("example_partitions", F.array_join("example_partitions", ",")))
register("t09_validate_target", "SELECT * FROM (VALUES ('biz_date', 'date', 'date', 'PASS'), "
         "('amount', 'decimal(18,2)', 'decimal(18,2)', 'PASS'), ('transaction_date', 'timestamp_ntz', 'timestamp_ntz', 'PASS'), "
         "('customer_id', 'string', 'string', 'PASS'), ('is_active', 'boolean', 'boolean', 'PASS')) "
         "v(column_name, expected_type, actual_type, status) WHERE EXISTS (SELECT 1 FROM orders)")(
    lambda spark, d: dr.validate_target(aligned(spark, d), MAPPING))


def write_hostile_source(spark, d: str) -> str:
    """Orders as ``report_date=MM`` partitions (zero-padded): month 03 holds files of two schemas, month 05 a file that is no
    Parquet beside a good one."""
    base = os.path.join(checkpoint_dir(spark), "fixtures", f"hostile-{uuid.uuid4().hex[:8]}")
    o = read_table(spark, d, "orders").withColumn(PART, F.date_format("o_orderdate", "MM"))
    as_text = (F.col(PART) == "03") & (F.col("o_orderkey") % 2 == 0)
    cols = [F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col(PART)]
    o.where(~as_text).select(*cols, F.col("o_totalprice").cast("decimal(18,2)").alias("amount")).write.partitionBy(PART).parquet(base)
    (o.where(as_text).select(*cols, F.col("o_totalprice").cast("string").alias("amount")).write.mode("append")
     .partitionBy(PART).parquet(base))
    o.limit(1).select(F.lit("this is no parquet file").alias("value")).coalesce(1).write.text(f"{base}-bad")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (bad,) = [st.getPath() for st in fs.listStatus(path(f"{base}-bad")) if st.getPath().getName().startswith("part-")]
    fs.rename(bad, path(f"{base}/{PART}=05/bad.parquet"))
    return base


HOSTILE = {"amount": T.DecimalType(18, 2), "customer_id": T.StringType()}
HOSTILE_SQL = ("SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, "
               "strftime(o_orderdate, '%m') AS report_date FROM orders")


@register("t08_mixed_partition_and_bad_file", HOSTILE_SQL)
def t08_hostile(spark, d):
    return dr.load_aligned(spark, write_hostile_source(spark, d), PART, HOSTILE)


@register("t10_load_beside_bad_file", f"SELECT report_date, COUNT(*) AS record_count, report_date = '05' AS has_bad_file "
          f"FROM ({HOSTILE_SQL}) GROUP BY 1")
def t10_hostile(spark, d):
    import datetime as dt
    from suite.loading import scratch
    from tidemark.plans import bronze
    target = scratch(spark, "t10-hostile")
    out = bronze.full_load(spark, write_hostile_source(spark, d), PART, HOSTILE, target, dt.datetime(2024, 2, 1))
    loaded = dr.list_partition_files(spark, target, PART).select(PART).distinct()
    counts = out["partitions"].withColumn(PART, F.lpad(F.col(PART).cast("string"), 2, "0"))
    bad = out["failed"].select(PART, F.lit(True).alias("bad")).distinct()
    return (loaded.join(counts, PART, "left").join(bad, PART, "left")
            .select(PART, "record_count", F.coalesce("bad", F.lit(False)).alias("has_bad_file")))


@register("t11_leading_zero_partitions", f"SELECT report_date, COUNT(*) AS record_count FROM ({HOSTILE_SQL}) GROUP BY 1")
def t11_hostile(spark, d):
    """A second incremental run finds nothing to load, so each partition's rows are there once."""
    import datetime as dt
    from suite.loading import scratch
    from tidemark.plans import bronze
    src, target = write_hostile_source(spark, d), scratch(spark, "t11-hostile")
    for day in (1, 2):
        bronze.incremental_load(spark, src, PART, HOSTILE, target, dt.datetime(2024, 2, day))
    return (spark.read.parquet(target).groupBy(F.lpad(F.col(PART).cast("string"), 2, "0").alias(PART))
            .agg(F.count(F.lit(1)).alias("record_count")))


@register("t11_after_rewrites", f"SELECT report_date, COUNT(*) AS record_count, CAST(0 AS BIGINT) AS loaded_again FROM ({HOSTILE_SQL}) "
          "GROUP BY 1")
def t11_after_rewrites(spark, d):
    """Folders keep their spelling through compaction, upsert and replacement, so no partition is loaded a second time."""
    import datetime as dt
    from suite.loading import scratch
    from tidemark.plans import bronze
    from tidemark.sources import io
    src, target, store = write_hostile_source(spark, d), scratch(spark, "t11-rewrites"), scratch(spark, "t11-store")
    load = lambda day: bronze.incremental_load(spark, src, PART, HOSTILE, target, dt.datetime(2024, 2, day), store=store)
    load(1)
    io.compact(spark, target, F.lit(True), [PART], ["id"])
    again = load(2).count()
    with io.staged(io.read_merged(spark, target).where("id % 10 = 0")) as some:
        io.write_upsert(spark, target, some, ["id"], [PART])
    again += load(3).count()
    with io.staged(io.read_merged(spark, target).where(F.col(PART) == 7)) as month:
        io.write_replace_where(spark, target, month, F.col(PART) == 7, [PART])
    again += load(4).count()
    rows = dr.read_file_group(spark, target, [target], PART)
    return rows.groupBy(PART).agg(F.count(F.lit(1)).alias("record_count")).withColumn("loaded_again", F.lit(again).cast("long"))


@register("t10_known_files", f"SELECT report_date, COUNT(*) AS record_count FROM ({HOSTILE_SQL}) GROUP BY 1")
def t10_known_files(spark, d):
    """A load whose file schemas all come from the store of an earlier run."""
    from suite.loading import scratch
    src, store = write_hostile_source(spark, d), scratch(spark, "t10-store")
    dr.file_schemas(spark, src, PART, store=store)
    return (dr.load_aligned(spark, src, PART, HOSTILE, store=store).groupBy(PART)
            .agg(F.count(F.lit(1)).alias("record_count")))


register("a21_rows_per_report_date",
         "SELECT CAST(year(o_orderdate) AS VARCHAR) AS report_date, COUNT(*) AS record_count FROM orders "
         "GROUP BY 1 ORDER BY 1")(lambda spark, d: rp.partition_counts(aligned(spark, d), PART))

_COLS = ["biz_date", "amount", "transaction_date", "customer_id", "is_active", "channel"]
register("a22_null_profile", "WITH a AS (" + ALIGNED_SQL + ") " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE {c} IS NULL) * CAST(100 AS DOUBLE) / COUNT(*) "
    f"ELSE 0.0 END AS null_pct FROM a" for c in _COLS))(
    lambda spark, d: qa.null_profile(aligned(spark, d), _COLS))

register("q13_null_parity", "WITH a AS (" + ALIGNED_SQL + "), s AS (SELECT o_orderkey AS id, o_orderdate AS "
         "biz_date, o_totalprice AS amount, o_orderdate AS transaction_date, o_custkey AS customer_id, "
         "o_orderstatus AS is_active FROM orders) " + " UNION ALL ".join(
             f"SELECT '{c}' AS column_name, (SELECT COUNT(*) FILTER (WHERE {c} IS NULL) FROM s) AS source_nulls, "
             f"(SELECT COUNT(*) FILTER (WHERE {c} IS NULL) FROM a) AS target_nulls, "
             f"(SELECT COUNT(*) FILTER (WHERE {c} IS NULL) FROM s) = (SELECT COUNT(*) FILTER (WHERE {c} IS NULL) "
             f"FROM a) AS equal" for c in _COLS[:-1]))(
    lambda spark, d: qa.null_parity(
        read_table(spark, d, "orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("biz_date"),
            F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("transaction_date"),
            F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("is_active")),
        aligned(spark, d), _COLS[:-1]))
