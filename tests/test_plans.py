"""Plan checks and the remaining laws: pruning reaches the scan,
job counts do not grow with the change set, repeated keys never pair up,
and a drifting source loads to the same rows as its clean twin."""

import contextlib
import datetime as dt
import decimal
import io as _io
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import drift as dr
from tidemark.operators import joblog as jl
from tidemark.operators import merge as mg
from tidemark.sources import io

from tests.test_joblog import AS_OF, _log


def _plan(df) -> str:
    buf = _io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_day_read_prunes_partitions_and_columns(spark, tmp_dir):
    base = os.path.join(tmp_dir, "ev")
    spark.range(0, 300).select(
        F.col("id").alias("event_id"), (F.col("id") * 2).alias("value"), F.lit("x").alias("wide"),
        F.lit(2024).alias("year"), F.lit(1).alias("month"), (F.col("id") % 3 + 1).cast("int").alias("day")) \
        .write.partitionBy("year", "month", "day").parquet(base)
    df = io.read_day(spark, base, dt.date(2024, 1, 2)).select("event_id")
    plan = _plan(df)
    assert "InMemoryFileIndex(1 paths)" in plan   # only the day's own folder is listed
    assert "ReadSchema: struct<event_id:bigint>" in plan
    assert df.count() == 100


def _jobs(spark, fn):
    sc = spark.sparkContext
    group = f"g{os.urandom(4).hex()}"
    sc.setJobGroup(group, "count jobs")
    try:
        fn()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_job_count_independent_of_updated_rows(spark):
    log = _log(spark, [{"batch_id": f"b{i}", "batch_status": "PENDING"} for i in range(200)])

    def run(n):
        upd = spark.createDataFrame([(f"b{i}", "COMPLETED") for i in range(n)], "batch_id string, new_status string")
        return lambda: jl.update_status(log, upd, AS_OF).write.format("noop").mode("overwrite").save()

    assert _jobs(spark, run(1)) == _jobs(spark, run(150))


def test_change_feed_and_compare_never_pair_repeated_keys(spark):
    old = spark.range(0, 2000).select(F.lit(7).cast("long").alias("k"), F.lit("a").alias("v"))
    new = spark.range(0, 2000).select(F.lit(7).cast("long").alias("k"), F.lit("b").alias("v"))
    feed = mg.change_feed(old, new, ["k"])
    # a full outer join on k would produce 2000 * 2000 rows here
    assert feed.count() == 4000
    assert {r._change_type for r in feed.select("_change_type").distinct().collect()} == \
        {"update_preimage", "update_postimage"}
    assert mg.change_feed(old, old, ["k"]).count() == 0
    # repeated ids cannot be told apart: refused, as in an upsert source
    with pytest.raises(Exception, match="duplicate id in column compare"):
        mg.column_compare(old, new, "k", ["v"]).collect()


def test_change_feed_and_updates_have_lean_plans(spark):
    old = spark.range(0, 100).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    new = spark.range(50, 150).select(F.col("id").alias("k"), F.lit("b").alias("v"))
    feed = mg.change_feed(old, new, ["k"])
    feed.collect()
    plan = feed._jdf.queryExecution().executedPlan().toString()
    plan = plan[:plan.index("== Initial Plan ==")]
    # whole rows are dealt out once, by all their columns, and that dealing serves both halves; the join is by key alone, of rows
    # that changed, and one side of it has a row per key
    assert "ReusedExchange" in plan and "SortAggregate" not in plan and "Window" not in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "FullOuter" not in plan
    plan = mg.column_compare(old, new, "k", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "FullOuter" not in plan


def test_drifting_source_loads_like_its_clean_twin(spark, tmp_dir):
    mapping = {"biz_date": T.DateType(), "amount": T.DecimalType(18, 2), "customer_id": T.StringType()}
    rows = [(1, dt.date(2024, 1, 5), decimal.Decimal("1.25"), "7"), (2, dt.date(2024, 2, 1), decimal.Decimal("10.00"),
                                                                       "8"), (3, None, None, None)]
    clean = spark.createDataFrame(rows, "id int, biz_date date, amount decimal(18,2), customer_id string")
    drifting = os.path.join(tmp_dir, "drift")
    clean.where("id = 1").select("id", F.date_format("biz_date", "yyyy-MM-dd").alias("biz_date"),
                                 F.col("amount").cast("double").alias("amount"),
                                 F.col("customer_id").cast("bigint").alias("customer_id")) \
        .write.parquet(os.path.join(drifting, "p=a"))
    clean.where("id <> 1").write.parquet(os.path.join(drifting, "p=b"))
    clean_path = os.path.join(tmp_dir, "clean")
    clean.withColumn("p", F.when(F.col("id") == 1, "a").otherwise("b")).write.partitionBy("p").parquet(clean_path)
    a = dr.load_aligned(spark, drifting, "p", mapping, {"biz_date": "yyyy-MM-dd"})
    b = dr.load_aligned(spark, clean_path, "p", mapping)
    cols = ["id", "biz_date", "amount", "customer_id", "p"]
    assert sorted(a.select(*cols).collect()) == sorted(b.select(*cols).collect())


def test_row_index_is_consecutive_across_ranges_without_python(spark):
    from tidemark.operators import repair as rp
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("v"))
    idx = rp.with_row_index(df, ["v"], "i", partitions=7)
    assert "Python" not in _plan(idx)
    got = sorted((r.v, r.i) for r in idx.collect())
    assert got == [(v, v) for v in range(1000)]
