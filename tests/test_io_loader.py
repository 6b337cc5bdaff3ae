"""Persistence (replace-where, upsert writes, backup/restore, compaction),
daily loading, request sharding and gates on hand-made data."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality as qa
from tidemark.operators import requests as rq
from tidemark.plans import loader
from tidemark.plans import repair as rplan
from tidemark.sources import io

DAY = ["year", "month", "day"]


def _events(spark, days, start_id=0, value=1.0):
    rows = []
    i = start_id
    for d in days:
        for _ in range(3):
            rows.append((i, d.year, d.month, d.day, value))
            i += 1
    return spark.createDataFrame(rows, "event_id long, year int, month int, day int, value double")


def _rows(df, cols=("event_id", "value")):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_replace_where_emptied_partition_and_restore(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    _events(spark, days).write.partitionBy(*DAY).parquet(path)
    before = _rows(spark.read.parquet(path))
    pred = F.make_date(*DAY) == F.lit("2024-01-02").cast("date")
    bpath, n = io.create_backup(spark, spark.read.parquet(path), pred, path, "b1")
    assert n == 3
    io.write_replace_where(spark, path, spark.read.parquet(path).limit(0), pred, DAY)
    after = spark.read.parquet(path)
    assert after.count() == 6 and not os.path.exists(os.path.join(path, "year=2024/month=1/day=2"))
    io.restore_backup(spark, path, bpath, pred, DAY)
    assert _rows(spark.read.parquet(path)) == before


def test_replace_where_rejects_rows_outside_predicate(spark):
    t = spark.createDataFrame([(1, 1)], "a int, b int")
    new = spark.createDataFrame([(2, 5)], "a int, b int")
    with pytest.raises(Exception, match="outside the replace predicate"):
        io.replace_where(t, new, F.col("b") < 3).collect()


def test_write_upsert_touches_only_needed_partitions(spark, tmp_dir):
    path = os.path.join(tmp_dir, "u")
    _events(spark, [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]).write.partitionBy(*DAY).parquet(path)
    untouched = sorted(os.listdir(os.path.join(path, "year=2024/month=1/day=1")))
    src = spark.createDataFrame([(3, 2024, 1, 2, 9.0), (100, 2024, 1, 3, 7.0)],
                                "event_id long, year int, month int, day int, value double")
    io.write_upsert(spark, path, src, ["event_id"], DAY)
    got = dict(_rows(spark.read.parquet(path)))
    assert got[3] == 9.0 and got[100] == 7.0 and len(got) == 7
    assert sorted(os.listdir(os.path.join(path, "year=2024/month=1/day=1"))) == untouched


def test_loader_skips_missing_day_and_isolates_failures(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    _events(spark, [dt.date(2024, 1, 1)]).write.partitionBy(*DAY).parquet(src)
    good = loader.TableLoad(source=src, target=os.path.join(tmp_dir, "tgt"), mode="append", name="good")
    bad = loader.TableLoad(source=src, target=os.path.join(tmp_dir, "tgt2"), mode="nonsense", name="bad")
    res = {r.table_name: r for r in loader.load_day(spark, [bad, good], dt.date(2024, 1, 1)).collect()}
    assert res["good"].status == "ok" and res["good"].rows == 3
    assert res["bad"].status == "failed" and "unknown mode" in res["bad"].error
    skipped = loader.load_day(spark, [good], dt.date(2024, 1, 9)).collect()[0]
    assert skipped.status == "skipped"


def test_lookback_newest_day_wins(spark, tmp_dir):
    src = os.path.join(tmp_dir, "late")
    spark.createDataFrame([(1, 2024, 1, 1, 1.0), (1, 2024, 1, 2, 2.0), (2, 2024, 1, 2, 5.0)],
                          "event_id long, year int, month int, day int, value double") \
        .write.partitionBy(*DAY).parquet(src)
    tgt = os.path.join(tmp_dir, "tgt")
    cfg = loader.TableLoad(source=src, target=tgt, mode="upsert", merge_keys=["event_id"], name="t")
    loader.load_with_lookback(spark, [cfg], dt.datetime(2024, 1, 3, 6), 2)
    got = {r.event_id: r.value for r in spark.read.parquet(tgt).collect()}
    assert got == {1: 2.0, 2: 5.0}
    # running the same lookback twice changes nothing
    loader.load_with_lookback(spark, [cfg], dt.datetime(2024, 1, 3, 6), 2)
    assert {r.event_id: r.value for r in spark.read.parquet(tgt).collect()} == got


def test_safe_replace_gate_blocks_and_keeps_backup(spark, tmp_dir):
    path = os.path.join(tmp_dir, "s")
    _events(spark, [dt.date(2024, 1, 1)]).write.partitionBy(*DAY).parquet(path)
    pred = F.make_date(*DAY) == F.lit("2024-01-01").cast("date")
    tiny = spark.read.parquet(path).limit(1)
    with pytest.raises(rplan.ReplaceFailed) as e:
        rplan.safe_replace(spark, path, tiny, pred, DAY, ["event_id"], tolerance_pct=20)
    assert os.path.exists(e.value.backup_path.replace("file:", ""))
    assert spark.read.parquet(path).count() == 3      # target untouched


def test_gate_checks_and_nulls(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (None, "2024-01-01"), (2, None)], "k int, d string") \
        .withColumn("d", F.to_date("d"))
    checks = {r.check: r.passed for r in qa.silver_gate(df, ["k"], "d", "2024-01-01", 1, 10).collect()}
    assert checks == {"no_duplicates": True, "no_null_keys": False, "correct_date": False, "count_in_range": True}
    with pytest.raises(qa.GateFailed):
        qa.raise_on_failure(qa.silver_gate(df, ["k"], "d", "2024-01-01", 1, 10))
    prof = {r.column_name: r.null_count for r in qa.null_profile(df).collect()}
    assert prof == {"k": 1, "d": 1}
    allnull = spark.createDataFrame([(None,), (None,)], "x string")
    assert qa.null_profile(allnull).collect()[0].null_pct == 100.0
    empty = spark.createDataFrame([], "x string")
    r = qa.row_count_change(empty, df, 20).collect()[0]
    assert r.pct_change is None and r.passed is True   # empty current skips (D-13)


def test_shards_cover_all_ids_once_and_respect_caps(spark):
    df = spark.range(2000).select(F.col("id").alias("rid"),
                                  ((F.col("id") * 37) % 500 + 1).alias("prompt_tokens"),
                                  ((F.col("id") * 11) % 900 + 100).alias("request_bytes"))
    sh = rq.shard_by_budget(df, "rid", 4, token_budget=5000, byte_budget=20000)
    assert sh.count() == 2000 and sh.select("rid").distinct().count() == 2000
    agg = sh.groupBy("shard").agg(F.sum("prompt_tokens").alias("t"), F.max("prompt_tokens").alias("mt"),
                                  F.sum("request_bytes").alias("b"), F.max("request_bytes").alias("mb")).collect()
    assert all(r.t < 5000 + r.mt and r.b < 20000 + r.mb for r in agg)
    cnt = rq.shard_by_count(df, "rid", 100, 4)
    sizes = [r["count"] for r in cnt.groupBy("shard").count().collect()]
    assert max(sizes) <= 100 and sum(sizes) == 2000


def test_two_level_cumsum_equals_global(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("b"), F.col("id").alias("o"), F.lit(1).alias("v"))
    got = {(r.b, r.o): r.cum for r in rq.two_level_cumsum(df, "b", "o", "v").collect()}
    ordered = sorted(got)
    assert [got[k] for k in ordered] == list(range(1, 101))


def test_token_udf_and_validate_output(spark):
    df = spark.createDataFrame([("a b c",), (None,), ('{"x": 1}',), ('{"x": ',)], "t string")
    cnt = rq.token_count_udf(lambda s: len(s.split()))
    assert [r.n for r in df.select(cnt("t").alias("n")).collect()] == [3, 0, 2, 1]
    from pyspark.sql import types as T
    v = rq.validate_output(df, "t", T.StructType([T.StructField("x", T.IntegerType())]))
    assert [r.is_valid for r in v.collect()] == [False, False, True, False]


def test_manifest_and_interchange(spark, tmp_dir):
    df = spark.createDataFrame([(1, "x", None)], "`Customer-ID` int, `Nhóm_B` string, `B_T-1` string")
    io.write_interchange(df, os.path.join(tmp_dir, "j"), "json")
    back = spark.read.json(os.path.join(tmp_dir, "j"))
    assert set(back.columns) == {"Customer-ID", "Nhóm_B", "B_T-1"}       # NULL field kept
    m = io.extraction_manifest(df, "sys", "db", "t", "v1", dt.datetime(2024, 1, 1)).collect()[0]
    assert m.row_count == 1 and "Nhóm_B" in m.data_types_mapping


def test_bucket_count_sizes_from_bytes_or_rows(spark):
    df = spark.createDataFrame([(i, 100) for i in range(50)], "rid int, request_bytes long")
    assert rq.bucket_count(df, per_bucket=1000) == 5
    assert rq.bucket_count(df, per_bucket=1001) == 5
    assert rq.bucket_count(df, None, 7) == 8
    assert rq.bucket_count(df.limit(0), per_bucket=10) == 1


def test_csv_layout_is_the_callers_choice(spark, tmp_dir):
    import glob
    df = spark.range(0, 500, numPartitions=4)
    io.export_csv(df, f"{tmp_dir}/one", single_file=True)
    assert len(glob.glob(f"{tmp_dir}/one/part-*.csv")) == 1
    io.export_csv(df, f"{tmp_dir}/many")
    assert len(glob.glob(f"{tmp_dir}/many/part-*.csv")) == 4
    assert spark.read.option("header", "true").csv(f"{tmp_dir}/many").count() == 500


def test_shard_names_never_cut_numbers(spark):
    ids = spark.range(0, 3000).select(F.col("id").alias("rid"))
    sh = rq.shard_by_count(ids, "rid", 1, 200_000)
    assert sh.select("shard").distinct().count() == sh.select("shard_bucket", "shard_seq").distinct().count() == 3000
    m = sh.withColumn("prompt_tokens", F.lit(1).cast("long")).withColumn("request_bytes", F.lit(1).cast("long"))
    man = rq.shard_manifest(m, "r", "in", "out", "202402")
    w = rq.assign_waves(man, 0, 500)
    # the running sum follows (bucket, sequence), not the name as text
    waves = [r.wave for r in man.join(w, "shard_id").orderBy("shard_bucket", "shard_seq").collect()]
    assert waves == [i // 500 for i in range(3000)]


# ------------------------------------------------ awkward partitions and columns

def test_compaction_keeps_rows_outside_its_predicate(spark, tmp_dir):
    path = os.path.join(tmp_dir, "k")
    days = [dt.date(2024, 1, d) for d in range(1, 31)]
    _events(spark, days).write.partitionBy("year", "month").parquet(path)
    before = _rows(spark.read.parquet(path), ("event_id", "day"))
    assert io.compact(spark, path, F.col("day") <= 10, ["year", "month"], ["event_id"]) == 90
    assert _rows(spark.read.parquet(path), ("event_id", "day")) == before
    pred = F.make_date(*DAY).between(F.lit("2024-01-01").cast("date"), F.lit("2024-01-10").cast("date"))
    new = spark.read.parquet(path).where(pred).withColumn("value", F.lit(2.0))
    rplan.safe_replace(spark, path, new, pred, ["year", "month"], ["event_id"], compact_keys=["event_id"])
    got = spark.read.parquet(path)
    assert got.count() == 90 and got.where("value = 2.0").count() == 30


def test_upsert_moved_key_and_null_partition(spark, tmp_dir):
    path = os.path.join(tmp_dir, "a")
    spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, p int").write.partitionBy("p").parquet(path)
    io.write_upsert(spark, path, spark.createDataFrame([(1, "NEW", 2)], "k int, v string, p int"), ["k"], ["p"])
    assert _rows(spark.read.parquet(path), ("k", "v", "p")) == [(1, "NEW", 2), (2, "b", 2)]
    path = os.path.join(tmp_dir, "b")
    spark.createDataFrame([(1, "a", None), (2, "b", 2), (4, "d", None)], "k int, v string, p int").write.partitionBy("p").parquet(path)
    io.write_upsert(spark, path, spark.createDataFrame([(3, "c", None)], "k int, v string, p int"), ["k"], ["p"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4]
    new = spark.createDataFrame([(1, "Z", None)], "k int, v string, p int")
    io.write_replace_where(spark, path, new, F.col("k") == 1, ["p"])
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == {1: "Z", 2: "b", 3: "c", 4: "d"}


def test_padded_and_escaped_folders(spark, tmp_dir):
    path = os.path.join(tmp_dir, "c")
    spark.createDataFrame([(1, "01"), (2, "02"), (3, "03")], "k int, month string").write.partitionBy("month").parquet(path)
    io.write_replace_where(spark, path, spark.read.parquet(path).limit(0), F.col("month") == 1, ["month"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [2, 3]
    io.write_upsert(spark, path, spark.createDataFrame([(2, 2)], "k int, month int"), ["k"], ["month"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [2, 3]
    path = os.path.join(tmp_dir, "esc")
    spark.createDataFrame([(1, "x y/z"), (2, "100%")], "k int, p string").write.partitionBy("p").parquet(path)
    io.write_replace_where(spark, path, spark.read.parquet(path).limit(0), F.col("p") == "x y/z", ["p"])
    assert [(r.k, r.p) for r in spark.read.parquet(path).collect()] == [(2, "100%")]


def test_new_columns_survive_every_writer(spark, tmp_dir):
    path = os.path.join(tmp_dir, "d")
    spark.createDataFrame([(1, 1)], "k int, p int").write.partitionBy("p").parquet(path)
    io.append(spark.createDataFrame([(2, 2, "x")], "k int, p int, extra string"), path, ["p"])
    io.write_upsert(spark, path, spark.createDataFrame([(1, 1, "y", 7)], "k int, p int, extra string, more int"), ["k"], ["p"])
    got = {r.k: (r.extra, r.more) for r in io.read_merged(spark, path).collect()}
    assert got == {1: ("y", 7), 2: ("x", None)}
    bpath, _ = io.create_backup(spark, io.read_merged(spark, path), F.col("p") == 2, path, "d1")
    io.write_replace_where(spark, path, io.read_merged(spark, path).limit(0), F.col("p") == 2, ["p"])
    io.restore_backup(spark, path, bpath, F.col("p") == 2, ["p"])
    assert {r.k: (r.extra, r.more) for r in io.read_merged(spark, path).collect()} == got
    with pytest.raises(ValueError, match="lacks the target's columns: extra"):
        io.write_upsert(spark, path, spark.createDataFrame([(1, 1, 7)], "k int, p int, more int"), ["k"], ["p"])


def test_read_day_has_the_days_own_columns(spark, tmp_dir):
    base = os.path.join(tmp_dir, "e")
    _events(spark, [dt.date(2024, 1, 1)]).write.partitionBy(*DAY).parquet(base)
    (_events(spark, [dt.date(2024, 1, 2)]).withColumn("extra", F.lit("n")).withColumn("month", F.lit("01"))
     .withColumn("day", F.lit("02")).write.mode("append").partitionBy(*DAY).parquet(base))
    assert {r.extra for r in io.read_day(spark, base, dt.date(2024, 1, 2)).collect()} == {"n"}
    both = io.read_days(spark, base, dt.date(2024, 1, 1), dt.date(2024, 1, 5))
    assert both.count() == 6 and "extra" in both.columns
    assert io.read_day(spark, base, dt.date(2024, 1, 3)) is None


def test_failed_publish_leaves_the_table_alone(spark, tmp_dir):
    path = os.path.join(tmp_dir, "f")
    _events(spark, [dt.date(2024, 1, 1)]).write.partitionBy(*DAY).parquet(path)
    dup = spark.createDataFrame([(0, 2024, 1, 1, 9.0), (0, 2024, 1, 1, 8.0)], "event_id long, year int, month int, day int, value double")
    with pytest.raises(Exception, match="duplicate key"):
        io.write_upsert(spark, path, dup, ["event_id"], DAY)
    assert spark.read.parquet(path).count() == 3 and not [f for f in os.listdir(path) if f.startswith("_staged")]


def test_staged_copies_and_backups_count_their_rows(spark, tmp_dir):
    from tidemark.session import checkpoint_dir
    rows = spark.range(100, numPartitions=3).withColumn("p", F.lit(1))
    folder = os.path.join(checkpoint_dir(spark), "staging")
    held = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    for df, n in ((rows, 100), (rows.where("id > 97"), 2), (rows.where("id > 200"), 0), (rows.limit(0), 0)):
        with io.staged_and_counted(df) as (copy, counted):
            assert (counted, copy.count()) == (n, n)
    assert set(os.listdir(folder)) == held
    for name, pred, n in (("all", F.lit(True), 100), ("some", F.col("id") < 5, 5), ("none", F.col("id") < 0, 0)):
        path, counted = io.create_backup(spark, rows, pred, os.path.join(tmp_dir, "b"), name)
        assert (counted, spark.read.parquet(path).count()) == (n, n)


def test_a_repeated_key_is_refused_by_versioned_upserts_too(spark, tmp_dir):
    """Also where the target holds a newer row, against which both rows of the key would be left out."""
    path = os.path.join(tmp_dir, "dv")
    spark.createDataFrame([(1, 1, 5)], "k int, p int, v int").write.partitionBy("p").parquet(path)
    dup = spark.createDataFrame([(1, 1, 3), (1, 1, 9)], "k int, p int, v int")
    with pytest.raises(Exception, match="duplicate key"):
        io.write_upsert(spark, path, dup, ["k"], ["p"], version=["v"])
    with pytest.raises(Exception, match="duplicate key"):
        io.write_upsert(spark, os.path.join(tmp_dir, "new"), dup, ["k"], ["p"])
    assert [r.v for r in spark.read.parquet(path).collect()] == [5]


def test_range_load_twice_and_missing_source(spark, tmp_dir):
    src, tgt = os.path.join(tmp_dir, "rs"), os.path.join(tmp_dir, "rt")
    _events(spark, [dt.date(2024, 1, 1)]).write.partitionBy(*DAY).parquet(src)
    cfg = loader.TableLoad(source=src, target=tgt, mode="append", name="t")
    for _ in range(2):
        assert loader.load_range(spark, [cfg], dt.date(2024, 1, 1), dt.date(2024, 1, 3)).collect()[0].status == "ok"
    assert spark.read.parquet(tgt).count() == 3
    gone = loader.TableLoad(source=os.path.join(tmp_dir, "none"), target=tgt, mode="append", name="g")
    assert loader.load_range(spark, [gone], dt.date(2024, 1, 1), dt.date(2024, 1, 3)).collect()[0].status == "skipped"


def test_append_once_replay(spark, tmp_dir):
    path = os.path.join(tmp_dir, "o")
    batch = _events(spark, [dt.date(2024, 1, 1), dt.date(2024, 1, 2)])
    for _ in range(2):
        assert io.append_once(spark, batch, path, DAY, "s-000000001") == 6
    io.append_once(spark, batch.limit(1), path, DAY, "s-000000002")
    assert spark.read.parquet(path).count() == 7


def test_write_upsert_within_source_partitions(spark, tmp_dir):
    path = os.path.join(tmp_dir, "u2")
    _events(spark, [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]).write.partitionBy(*DAY).parquet(path)
    untouched = sorted(os.listdir(os.path.join(path, "year=2024/month=1/day=1")))
    src = spark.createDataFrame([(4, 2024, 1, 2, 9.0), (100, 2024, 1, 3, 7.0)],
                                "event_id long, year int, month int, day int, value double")
    io.write_upsert(spark, path, src, ["event_id"], DAY, within_source_partitions=True)
    got = dict(_rows(spark.read.parquet(path)))
    assert got[4] == 9.0 and got[100] == 7.0 and len(got) == 7
    assert sorted(os.listdir(os.path.join(path, "year=2024/month=1/day=1"))) == untouched


def test_write_shards_one_named_file_per_shard(spark, tmp_dir):
    df = spark.range(0, 600, numPartitions=6).select(
        (F.col("id") % 5).cast("string").alias("shard"), F.to_json(F.struct("id")).alias("request"))
    for _ in range(2):  # a second run replaces the month
        assert io.write_shards_jsonl(df, f"{tmp_dir}/shards", "202402") == 5
    files = sorted(f for f in os.listdir(f"{tmp_dir}/shards/202402") if not f.startswith("."))
    assert files == [f"shard_{i}.jsonl" for i in range(5)]
    for f in files:
        with open(f"{tmp_dir}/shards/202402/{f}") as fh:
            assert sum(1 for _ in fh) == 120


def test_stream_load_append_then_upsert(spark, tmp_dir):
    from pyspark.sql import types as T
    from tidemark.streaming.daily_stream import stream_load
    src = os.path.join(tmp_dir, "stream_src")
    _events(spark, [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]).write.partitionBy(*DAY).parquet(src)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()),
                           T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()),
                           T.StructField("day", T.IntegerType())])
    tgt = os.path.join(tmp_dir, "stream_tgt")
    name_a = f"t-{os.urandom(3).hex()}"
    stream_load(spark, src, schema, tgt, mode="append", name=name_a)
    assert spark.read.parquet(tgt).count() == 6
    # a new day arrives: the checkpoint makes the next run process only the new files
    _events(spark, [dt.date(2024, 1, 3)], start_id=2, value=5.0).write.mode("append").partitionBy(*DAY).parquet(src)
    stream_load(spark, src, schema, tgt, mode="append", name=name_a)
    assert spark.read.parquet(tgt).count() == 9
    up = os.path.join(tmp_dir, "stream_up")
    name = f"u-{os.urandom(3).hex()}"
    stream_load(spark, src, schema, up, mode="upsert", merge_keys=["event_id"],
                order_by=[F.col("day").desc()], name=name)
    got = dict(_rows(spark.read.parquet(up)))
    assert len(got) == 6 and got[2] == got[3] == got[4] == 5.0 and got[5] == 1.0


def test_compact_sizes_files_from_bytes(spark, tmp_dir):
    import glob
    path = os.path.join(tmp_dir, "c")
    df = spark.range(0, 20000, numPartitions=8).select(
        F.col("id").alias("event_id"), F.sha2(F.col("id").cast("string"), 256).alias("pad"),
        F.lit(2024).alias("year"), F.lit(1).alias("month"), (F.col("id") % 2 + 1).cast("int").alias("day"))
    df.write.partitionBy(*DAY).parquet(path)
    day1 = F.col("day") == 1
    n = io.compact(spark, path, day1, DAY, ["event_id"], target_file_bytes=128 * 1024)
    assert n == 10000
    files1 = glob.glob(f"{path}/year=2024/month=1/day=1/*.parquet")
    assert 2 <= len(files1) < 8          # split by size, fewer than before
    assert len(glob.glob(f"{path}/year=2024/month=1/day=2/*.parquet")) == 8   # untouched
    assert spark.read.parquet(path).count() == 20000


def _files_by_key(path, key):
    """(least, largest) key of each file, in that order; every file must be sorted."""
    import glob

    import pyarrow.parquet as pq
    out = []
    for f in glob.glob(f"{path}/**/*.parquet", recursive=True):
        k = pq.ParquetFile(f).read(columns=[key])[key].to_pylist()
        assert k == sorted(k)
        out.append((k[0], k[-1], len(k)))
    return sorted(out)


def test_compact_sorts_no_more_in_a_task_than_fits(spark, tmp_dir):
    """400 MB of rows in one folder, which take 2 MB on disk: several sorted files, whose ranges do not overlap."""
    path = os.path.join(tmp_dir, "w")
    spark.range(0, 50_000, numPartitions=8).select(
        ((F.col("id") * 7919) % 50_021).alias("k"), F.repeat(F.lit("x"), 8000).alias("wide"), F.lit(1).alias("p")).write.partitionBy("p").parquet(path)
    assert io.compact(spark, path, F.lit(True), ["p"], ["k"]) == 50_000
    files = _files_by_key(path, "k")
    assert 2 <= len(files) < 8 and all(a[1] < b[0] for a, b in zip(files, files[1:]))
    assert max(n for *_, n in files) < 0.75 * 50_000
    got = spark.read.parquet(path).agg(F.countDistinct("k"), F.sum(F.length("wide"))).first()
    assert tuple(got) == (50_000, 400_000_000)


def test_compact_deals_out_rows_of_one_key(spark, tmp_dir):
    """Rows that are equal in the partition and all keys, NULL ones too, do not meet in one task."""
    import glob

    import pyarrow.parquet as pq
    path = os.path.join(tmp_dir, "h")
    df = spark.range(0, 6000, numPartitions=4).select(
        "id", F.lit(None).cast("long").alias("k"), F.when(F.col("id") % 2 == 0, F.lit("a")).alias("p"))
    df.write.partitionBy("p").parquet(path)
    assert io.compact(spark, path, F.lit(True), ["p"], ["k"], sorted_bytes=100_000) == 6000
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{path}/p=*/*.parquet")]
    assert len(sizes) >= 4 and max(sizes) < 3000
    assert sorted(os.listdir(path))[-2:] == ["p=__HIVE_DEFAULT_PARTITION__", "p=a"]
    got = _rows(spark.read.parquet(path), ("id", "k", "p"))
    assert sorted(got) == [(i, None, None if i % 2 else "a") for i in range(6000)]
