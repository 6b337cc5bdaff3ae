"""Swapping folders under storage errors, folder spelling, conditional upserts, backups and shard files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import drift as dr
from tidemark.operators import merge as mg
from tidemark.operators import repair as rp
from tidemark.plans import bronze, loader
from tidemark.sources import io
from tidemark.sources import publish as pb
from tidemark.streaming.daily_stream import stream_load

DAY = ["year", "month", "day"]


class StorageError(Exception):
    """Not an OSError, as an error of the storage arrives from the JVM."""


class Faulty:
    """Counts the storage's changes and fails at one of them, before or after it is made."""

    def __init__(self, monkeypatch, at=None, after=False):
        self.calls, self.at, self.after = 0, at, after
        for name in ("move_path", "delete_path", "_write_text"):
            monkeypatch.setattr(pb, name, self.wrap(getattr(pb, name)))

    def wrap(self, fn):
        def call(*args):
            self.calls += 1
            if self.calls == self.at and not self.after:
                raise StorageError(fn.__name__)
            out = fn(*args)
            if self.calls == self.at:
                raise StorageError(fn.__name__)
            return out
        return call


def _tree(root):
    """Relative path -> content of the files that readers see."""
    out = {}
    for folder, _, files in os.walk(root):
        rel = os.path.relpath(folder, root)
        if any(p.startswith("_") for p in rel.split(os.sep)):
            continue
        for f in files:
            if not f.startswith((".", "_")):
                with open(os.path.join(folder, f)) as fh:
                    out[os.path.normpath(os.path.join(rel, f))] = fh.read()
    return out


def _fill(root, files):
    for name, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "w") as fh:
            fh.write(text)


OLD = {"p=1/q=01/a": "1", "p=1/q=02/b": "2", "p=2/q=01/c": "3", "p=3/q=x/d": "keep"}
NEW = {"p=1/q=01/n": "10", "p=4/q=01/m": "40"}


def _swap(spark, root):
    staged = f"{root}/_staged-x"
    _fill(staged, NEW)
    pb.swap(spark, root, staged, ["p=1/q=01", "p=1/q=02", "p=2/q=01"], [("p=1/q=01", "p=1/q=01"), ("p=4/q=01", "p=4/q=01")])


def test_every_storage_error_leaves_the_old_or_the_new_rows(spark, tmp_dir, monkeypatch):
    with monkeypatch.context() as m:
        count = Faulty(m)
        root = f"{tmp_dir}/plain"
        _fill(root, OLD)
        _swap(spark, root)
        steps = count.calls
    after = {**NEW, "p=3/q=x/d": "keep"}
    assert _tree(root) == after and steps >= 9
    assert sorted(os.listdir(root)) == ["p=1", "p=3", "p=4"]  # emptied parents and the swap's own folders are gone
    seen = set()
    for at in range(1, steps + 1):
        for late in (False, True):
            root = f"{tmp_dir}/t{at}-{late}"
            _fill(root, OLD)
            with monkeypatch.context() as m:
                Faulty(m, at, late)
                with pytest.raises(Exception):  # noqa: B017
                    _swap(spark, root)
            every = {open(os.path.join(d, f)).read() for d, _, fs in os.walk(root) for f in fs if not f.startswith((".", "_"))}
            assert {"10", "40", "keep"} <= every
            pb.recover(spark, root)
            got = _tree(root)
            assert got in (OLD, after), (at, late)
            seen.add(got == after)
            assert pb.recover(spark, root) == 0
    assert seen == {True, False}


def test_an_error_during_recovery_is_recovered_from(spark, tmp_dir, monkeypatch):
    root = f"{tmp_dir}/t"
    _fill(root, OLD)
    with monkeypatch.context() as m:
        Faulty(m, 4)
        with pytest.raises(pb.UnfinishedSwap):
            _swap(spark, root)
    for at in (1, 2, 2):
        with monkeypatch.context() as m:
            Faulty(m, at, after=True)
            with pytest.raises(StorageError):
                pb.recover(spark, root)
    pb.recover(spark, root)
    assert _tree(root) == {**NEW, "p=3/q=x/d": "keep"}


def _keys(spark, path):
    return sorted((r.k, r.v) for r in spark.read.parquet(path).collect())


@pytest.mark.parametrize("at", [1, 2, 3, 4, 6])
def test_writers_lose_nothing_and_finish_the_swap_later(spark, tmp_dir, monkeypatch, at):
    path = f"{tmp_dir}/t"
    spark.createDataFrame([(i, "old", i % 3) for i in range(9)], "k int, v string, p int").write.partitionBy("p").parquet(path)
    before = _keys(spark, path)
    with monkeypatch.context() as m:
        Faulty(m, at, after=at % 2 == 0)
        with pytest.raises(Exception):  # noqa: B017
            io.compact(spark, path, F.lit(True), ["p"], ["k"])
    src = spark.createDataFrame([(0, "new", 1), (20, "new", 5)], "k int, v string, p int")
    io.write_upsert(spark, path, src, ["k"], ["p"])  # begins by finishing the compaction
    want = sorted([(k, v) for k, v in before if k] + [(0, "new"), (20, "new")])
    assert _keys(spark, path) == want and not [f for f in os.listdir(path) if f.startswith(("_ready", "_aside"))]


@pytest.mark.parametrize("at", [2, 3, 4, 5, 6])
def test_append_once_replay_after_an_error(spark, tmp_dir, monkeypatch, at):
    path = f"{tmp_dir}/t"
    spark.createDataFrame([(1, "a", 1)], "k int, v string, p int").write.partitionBy("p").parquet(path)
    batch = spark.createDataFrame([(2, "b", 1), (3, "c", 2)], "k int, v string, p int")
    io.append_once(spark, batch, path, ["p"], "s-1")
    with monkeypatch.context() as m:
        Faulty(m, at)
        with pytest.raises(Exception):  # noqa: B017
            io.append_once(spark, batch, path, ["p"], "s-1")
    io.recover(spark, path)
    assert _keys(spark, path) == [(1, "a"), (2, "b"), (3, "c")]
    io.append_once(spark, batch, path, ["p"], "s-1")
    assert _keys(spark, path) == [(1, "a"), (2, "b"), (3, "c")]


@pytest.mark.parametrize("at", [1, 2, 3, 4, 5, 6, 7])
def test_shards_of_a_month_survive_an_error(spark, tmp_dir, monkeypatch, at):
    base = f"{tmp_dir}/shards"

    def shards(n):
        return spark.range(n).select((F.col("id") % 3).cast("string").alias("shard"), F.col("id").cast("string").alias("request"))

    def held():
        lines = [r.value for r in spark.read.text(f"{base}/202402").collect()]
        return len(lines), io.written_shards(spark, base, "202402").agg(F.sum("records")).first()[0]
    io.write_shards_jsonl(shards(30), base, "202402")
    with monkeypatch.context() as m:
        Faulty(m, at)
        with pytest.raises(Exception):  # noqa: B017
            io.write_shards_jsonl(shards(60), base, "202402")
    io.recover(spark, base)
    assert held() in ((30, 30), (60, 60))
    assert io.write_shards_jsonl(shards(90), base, "202402") == 3 and held() == (90, 90)
    assert sorted(r["file"] for r in io.written_shards(spark, base, "202402").collect()) == [f"shard_{i}.jsonl" for i in range(3)]


def test_a_backup_is_never_overwritten(spark, tmp_dir):
    df = spark.range(3)
    path, n = io.create_backup(spark, df, F.col("id") > 0, f"{tmp_dir}/t", "s")
    with pytest.raises(FileExistsError):
        io.create_backup(spark, df, F.lit(True), f"{tmp_dir}/t", "s")
    assert n == 2 and spark.read.parquet(path).count() == 2


# ------------------------------------------------------------------ spelling

def _folders(path, depth=1):
    return pb.leaf_folders(_folders.spark, path, depth)


def test_folder_spelling_survives_every_writer(spark, tmp_dir):
    _folders.spark = spark
    src, target = f"{tmp_dir}/src", f"{tmp_dir}/target"
    rows = [(i, f"{1 + i % 3:02d}") for i in range(9)]
    spark.createDataFrame(rows, "id long, report_date string").write.partitionBy("report_date").parquet(src)
    load = lambda: bronze.incremental_load(spark, src, "report_date", {"id": T.LongType()}, target, dt.datetime(2024, 1, 1))
    assert load().count() == 3
    want = ["report_date=01", "report_date=02", "report_date=03"]
    io.compact(spark, target, F.lit(True), ["report_date"], ["id"])
    assert _folders(target) == want and load().count() == 0
    one = spark.read.option("mergeSchema", "true").parquet(target).where("id = 4")
    one = spark.createDataFrame(one.collect(), one.schema)
    io.write_upsert(spark, target, one, ["id"], ["report_date"])
    assert _folders(target) == want and load().count() == 0
    io.write_replace_where(spark, target, one, F.col("report_date") == 2, ["report_date"])
    assert _folders(target) == want and load().count() == 0
    io.append(one, target, ["report_date"])
    io.append_once(spark, one, target, ["report_date"], "s-1")
    io.overwrite_partitions(one, target, ["report_date"])
    assert _folders(target) == want
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [0, 2, 3, 4, 5, 6, 8]
    moved = one.withColumn("report_date", F.lit(7))
    io.write_upsert(spark, target, moved, ["id"], ["report_date"])  # a new value is padded as the others are
    assert _folders(target) == ["report_date=01", "report_date=03", "report_date=07"]


def test_spelling_follows_the_folder_above(spark, tmp_dir):
    _folders.spark = spark
    path = f"{tmp_dir}/t"
    rows = [(1, "2023", "1"), (2, "2024", "01"), (3, "2024", "02"), (4, None, "1"), (5, "2025", "x y/z%")]
    for r in rows[:4]:
        spark.createDataFrame([r], "k int, y string, m string").write.mode("append").partitionBy("y", "m").parquet(path)
    before = _folders(path, 2)
    src = spark.createDataFrame([(10, 2023, 1), (11, 2024, 1), (4, None, 1), (12, 2024, 3)], "k int, y int, m int")
    io.write_upsert(spark, path, src, ["k"], ["y", "m"])
    assert _folders(path, 2) == sorted([*before, "y=2024/m=03"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 10, 11, 12]
    path = f"{tmp_dir}/odd"
    spark.createDataFrame(rows[4:], "k int, y string, m string").write.partitionBy("y", "m").parquet(path)
    before = _folders(path, 2)
    io.compact(spark, path, F.lit(True), ["y", "m"], ["k"])
    assert _folders(path, 2) == before


# -------------------------------------------------------- conditional upsert

def _day(spark, d, value, ids=(1, 2)):
    return spark.createDataFrame([(i, value, 2024, 1, d) for i in ids], "event_id long, value string, year int, month int, day int")


def test_older_days_never_replace_newer_rows(spark, tmp_dir):
    for order in ((28, 29, 30), (30, 29, 28), (29, 30, 28)):
        src, target = f"{tmp_dir}/src-{order[0]}-{order[1]}", f"{tmp_dir}/t-{order[0]}-{order[1]}"
        cfg = loader.TableLoad(source=src, target=target, mode="upsert", merge_keys=["event_id"], version=DAY)
        for d in order:
            _day(spark, d, f"day {d}", ids=(1, 2) if d != 29 else (1, 2, 3)).write.mode("append").partitionBy(*DAY).parquet(src)
            assert loader.load_day(spark, [cfg], dt.date(2024, 1, d)).collect()[0].status == "ok"
        got = sorted((r.event_id, r.value, r.day) for r in spark.read.parquet(target).collect())
        assert got == [(1, "day 30", 30), (2, "day 30", 30), (3, "day 29", 29)]


def test_stream_takes_days_newest_first(spark, tmp_dir):
    src, target, name = f"{tmp_dir}/src", f"{tmp_dir}/t", f"v-{os.urandom(3).hex()}"
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.StringType()),
                           *[T.StructField(c, T.IntegerType()) for c in DAY]])
    for d in (30, 29):
        _day(spark, d, f"day {d}", ids=(1, d)).write.mode("append").partitionBy(*DAY).parquet(src)
        stream_load(spark, src, schema, target, mode="upsert", merge_keys=["event_id"], name=name, max_files=1, version=DAY)
    assert sorted((r.event_id, r.value) for r in spark.read.parquet(target).collect()) == [(1, "day 30"), (29, "day 29"), (30, "day 30")]


def test_version_with_nulls_and_replays(spark):
    schema = "k int, v string, at int"
    target = spark.createDataFrame([(1, "t", 5), (2, "t", None), (3, "t", 5)], schema)
    source = spark.createDataFrame([(1, "s", 4), (2, "s", None), (3, "s", 5), (4, "s", None), (None, "s", 1)], schema)
    kept = mg.not_older(source, target, ["k"], ["at"])
    assert sorted(r.k or 0 for r in kept.collect()) == [0, 2, 3, 4]
    assert mg.not_older(source, target.drop("at"), ["k"], ["at"]).count() == 5


# --------------------------------------------------------------- change feed

def _feed(old, new, keys=("k",)):
    return sorted((tuple(r) for r in mg.change_feed(old, new, list(keys)).collect()), key=str)


def test_change_feed_with_added_and_dropped_columns(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 7), (4, "d", 8)], "k int, v string, x int")
    assert _feed(old, new) == sorted([(2, "b", None, "update_preimage"), (2, "b", 7, "update_postimage"), (3, "c", None, "delete"),
                                      (4, "d", 8, "insert")], key=str)
    dropped = mg.change_feed(new, old, ["k"])
    assert dropped.columns == ["k", "v", "x", "_change_type"]
    assert {(r.k, r._change_type) for r in dropped.collect()} == {(2, "update_preimage"), (2, "update_postimage"), (3, "insert"),
                                                                  (4, "delete")}
    assert mg.apply_change_feed(old, mg.change_feed(old, new, ["k"]), ["k"]).count() == 3


def test_change_feed_of_repeated_keys_is_a_multiset(spark):
    old = spark.createDataFrame([(1, "a")] * 5 + [(1, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "a")] * 3 + [(1, "c")] * 2 + [(None, "n")], "k int, v string")
    got = _feed(old, new)
    assert got == sorted([(1, "a", "update_preimage")] * 2 + [(1, "b", "update_preimage")] + [(1, "c", "update_postimage")] * 2, key=str)


def test_change_feed_of_a_hot_key_is_dealt_out(spark):
    """Rows of one key go over all tasks: no exchange is by the key alone before the rows that did not change are gone."""
    old = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    plan = mg.change_feed(old, old.where("v <> 5"), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(k" in plan
    first = plan[plan.rindex("hashpartitioning("):]
    assert first.split(")")[0].count("#") == 2


# ------------------------------------------------------------------- samples

def test_stride_sample_numbers_in_spark(spark):
    values = spark.range(100).select((F.col("id") % 25).cast("string").alias("p"))
    every = sorted({str(i) for i in range(25)})
    got = sorted(r.p for r in rp.stride_sample(values, "p", 6).collect())
    assert got == sorted({*every[::4], every[-1]})
    assert rp.stride_sample(values.where("p is null"), "p", 3).collect() == []
    assert dr.partition_values is not None
