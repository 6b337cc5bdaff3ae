"""Reuse of earlier results, and waves under several limits."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import requests as rq
from tidemark.plans import reuse

AT = dt.datetime(2024, 1, 1)


def test_only_changed_requests_are_processed(spark, tmp_dir):
    store, schema = f"{tmp_dir}/store", "k long, prompt string, model string, note string"
    first = spark.createDataFrame([(i, f"p{i}", "m", "x") for i in range(200)] + [(None, "n", "m", "x")], schema)
    run = lambda df: reuse.probe(spark, store, df, ["k"], ["prompt", "model"])
    assert run(first).where("result_location is null").count() == 201
    assert reuse.record(spark, store, first, ["k"], ["prompt", "model"], "r1", AT) == 201
    second = (first.withColumn("prompt", F.when(F.col("k") % 50 == 0, "changed").otherwise(F.col("prompt")))
              .withColumn("note", F.lit("not part of it")).union(spark.createDataFrame([(999, "new", None, None)], schema)))
    todo = run(second).where("result_location is null")
    todo = spark.createDataFrame(todo.drop("result_location").collect(), schema)  # the store is about to change
    assert sorted(r.k for r in todo.collect()) == [0, 50, 100, 150, 999]
    assert reuse.record(spark, store, todo, ["k"], ["prompt", "model"], "r2", AT) == 5
    third = {r.k: r.result_location for r in run(second).collect()}
    assert third[0] == third[999] == "r2" and third[1] == third[None] == "r1" and None not in third.values()
    assert run(first).where("result_location is null").count() == 4  # the old prompts are not known any more
    assert reuse.record(spark, store, todo.limit(0), ["k"], ["prompt", "model"], "r3", AT) == 0
    with pytest.raises(Exception, match="duplicate key"):
        reuse.record(spark, store, todo.union(todo), ["k"], ["prompt", "model"], "r4", AT)
    assert run(second).where("result_location is null").count() == 0


def _waves(rows, limits):
    out, wave, held = [], 0, [0] * len(limits)
    for r in rows:
        new = [a + (b or 0) for a, b in zip(held, r[1:], strict=True)]
        if any(x > y for x, y in zip(new, limits.values(), strict=True)):
            wave, new = wave + 1, [b or 0 for b in r[1:]]
        held = new
        out.append(wave)
    return out


@pytest.mark.parametrize(("seed", "limits"), [(1, {"t": 40, "b": 60, "n": 7}), (2, {"t": 20, "b": 30, "n": 100}), (3, {"t": 1000, "b": 31, "n": 3})])
def test_waves_hold_all_limits(spark, monkeypatch, seed, limits):
    monkeypatch.setattr(rq, "WAVE_RANGE", 7)
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 5, 9, 20]), rng.choice([0, 1, 30, None]), 1) for i in range(70)]
    df = spark.createDataFrame(rows, "i int, t int, b int, n int").repartition(3)
    got = rq.assign_limited_waves(df, ["i"], limits).orderBy("i").collect()
    assert [r.wave for r in got] == _waves(rows, limits) and got[0].asDict().keys() == {"i", "t", "b", "n", "wave"}


def test_waves_of_odd_shards(spark):
    schema = "i int, t int"
    assert rq.assign_limited_waves(spark.createDataFrame([], schema), ["i"], {"t": 5}).collect() == []
    zero = spark.createDataFrame([(i, 0) for i in range(9)], schema)
    assert {r.wave for r in rq.assign_limited_waves(zero, ["i"], {"t": 5}).collect()} == {0}
    with pytest.raises(Exception, match="over the limit of t"):
        rq.assign_limited_waves(spark.createDataFrame([(1, 6)], schema), ["i"], {"t": 5}).collect()
