"""Type categories, schema checks, partition status, catalog reads, the load
log and the caller's token counter."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import drift as dr
from tidemark.operators import quality as qa
from tidemark.operators import requests as rq
from tidemark.plans import bronze, loader
from tidemark.sources import io


def test_type_category_expr_matches_python_rule(spark):
    types = [T.StringType(), T.VarcharType(5), T.DateType(), T.TimestampType(), T.TimestampNTZType(),
             T.ByteType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.DecimalType(10, 2),
             T.BooleanType(), T.ArrayType(T.FloatType()), T.BinaryType()]
    df = spark.createDataFrame([(t.simpleString(),) for t in types], "t string")
    got = [r.c for r in df.select(dr.type_category_expr("t").alias("c")).collect()]
    assert got == [dr.type_category(t) for t in types]


def test_schema_check_and_type_preservation(spark):
    cur = spark.createDataFrame([(1, "a", 1.5)], "k int, v string, x double")
    new = cur.withColumn("x", F.col("x").cast("decimal(18,2)")).drop("v").withColumn("w", F.lit(1))
    rows = {r.column_name: r.status for r in qa.schema_check(spark, cur.schema, new.schema).collect()}
    assert rows == {"k": "PASS", "v": "MISSING", "x": "FAIL", "w": "EXTRA"}
    kept = {r.column_name: r.preserved for r in qa.type_preservation(cur, new).collect()}
    assert kept == {"k": True, "v": False, "x": False}


def test_partition_status_compares_values_as_strings(spark):
    parts = spark.createDataFrame([(2001, 5), (2002, 7)], "report_date int, record_count long")
    failed = spark.createDataFrame([("2003", "IOError: bad footer"), ("2003", "IOError: other"),
                                    ("2001", "stale")], "report_date string, error string")
    got = sorted(tuple(r) for r in bronze.partition_status(parts, failed, "report_date").collect())
    assert got == [("2001", 5, "loaded", None), ("2002", 7, "loaded", None),
                   ("2003", 0, "failed", "IOError: bad footer")]


def test_read_catalog_binds_parameters(spark):
    spark.createDataFrame([(1, "x"), (2, "y'; DROP")], "k int, s string").createOrReplaceTempView("cat_t")
    assert io.read_catalog(spark, table="cat_t").count() == 2
    q = io.read_catalog(spark, query="SELECT k FROM cat_t WHERE s = :s", args={"s": "y'; DROP"})
    assert [r.k for r in q.collect()] == [2]
    with pytest.raises(ValueError):
        io.read_catalog(spark)


def test_log_execution_appends_rows(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log")
    for i in range(2):
        loader.log_execution(spark, path, f"r{i}", dt.date(2024, 1, 2), "year=2024/month=01/day=01", 3,
                             dt.datetime(2024, 1, 2, 6, i), rows_loaded=10 * i)
    got = sorted((r.job_run_id, r.rows_loaded) for r in spark.read.parquet(path).collect())
    assert got == [("r0", 0), ("r1", 10)]


def test_token_count_udf_whole_text(spark):
    long_text = " ".join(["w"] * 20000)
    df = spark.createDataFrame([(long_text,), ("\ta  b\n",), ("",), (None,)], "t string")
    cnt = rq.token_count_udf(lambda s: len(s.split()))
    assert [r.n for r in df.select(cnt("t").alias("n")).collect()] == [20000, 2, 0, 0]
