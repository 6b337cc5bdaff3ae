"""Property-based laws on generated tables: the change feed
applied to the old table gives the new one; upsert twice equals once; the
slice dedup leaves exactly the distinct keys; compare counts add up."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import merge as mg
from tidemark.operators import repair as rp

SCHEMA = "k int, v string, x double"
_val = st.one_of(st.none(), st.sampled_from(["a", "b", "c|d", "", "~"]))
_num = st.one_of(st.none(), st.sampled_from([0.0, 1.5, -2.0]))


def _table(keys):
    return st.lists(st.tuples(_val, _num), min_size=len(keys), max_size=len(keys)).map(
        lambda vals: [(k, v, x) for k, (v, x) in zip(keys, vals)])


_keys = st.sets(st.integers(0, 30), max_size=12).map(sorted)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


@SETTINGS
@given(data=st.data())
def test_change_feed_law_generated(spark, data):
    old_rows = data.draw(_keys.flatmap(_table))
    new_rows = data.draw(_keys.flatmap(_table))
    old = spark.createDataFrame(old_rows, SCHEMA)
    new = spark.createDataFrame(new_rows, SCHEMA)
    feed = mg.change_feed(old, new, ["k"])
    assert _rows(mg.apply_change_feed(old, feed, ["k"])) == _rows(new)
    kinds = [r._change_type for r in feed.collect()]
    assert kinds.count("update_preimage") == kinds.count("update_postimage")


@SETTINGS
@given(data=st.data())
def test_upsert_twice_is_once_generated(spark, data):
    target = spark.createDataFrame(data.draw(_keys.flatmap(_table)), SCHEMA)
    source = spark.createDataFrame(data.draw(_keys.flatmap(_table)), SCHEMA)
    once = mg.upsert(target, source, ["k"])
    assert _rows(mg.upsert(once, source, ["k"])) == _rows(once)
    assert once.count() == target.select("k").union(source.select("k")).distinct().count()


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.integers(0, 100)), max_size=25))
def test_dedup_keeps_one_row_per_key_generated(spark, rows):
    df = spark.createDataFrame(rows, "k int, d int, seq int").withColumn(
        "day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    deduped, proof = rp.dedup_slice(df, "day", "2024-01-01", "2024-01-03", ["k"],
                                    [F.col("seq").desc(), F.col("d").desc()])
    p = proof.collect()[0]
    assert p["ok"] and p["rows_after"] == p["distinct_keys_before"]
    again, _ = rp.dedup_slice(deduped, "day", "2024-01-01", "2024-01-03", ["k"],
                              [F.col("seq").desc(), F.col("d").desc()])
    assert _rows(again) == _rows(deduped)


@SETTINGS
@given(data=st.data())
def test_column_compare_counts_add_up(spark, data):
    src = spark.createDataFrame(data.draw(_keys.flatmap(_table)), SCHEMA)
    dst = spark.createDataFrame(data.draw(_keys.flatmap(_table)), SCHEMA)
    both = src.join(dst, "k").count()
    for r in mg.column_compare(src, dst, "k", ["v", "x"]).collect():
        assert r.matches + r.mismatches == both
        assert r.missing_in_destination == src.join(dst, "k", "left_anti").count()
        assert r.missing_in_source == dst.join(src, "k", "left_anti").count()


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 9), _val), min_size=1, max_size=20), data=st.data())
def test_table_fingerprint_ignores_order_but_not_duplicates(spark, rows, data):
    from tidemark.functions.hashing import table_fingerprint
    shuffled = data.draw(st.permutations(rows))
    a = table_fingerprint(spark.createDataFrame(rows, "k int, v string")).collect()[0]
    b = table_fingerprint(spark.createDataFrame(shuffled, "k int, v string")).collect()[0]
    assert tuple(a) == tuple(b)
    doubled = table_fingerprint(spark.createDataFrame(rows + rows[:1], "k int, v string")).collect()[0]
    assert doubled["row_count"] == a["row_count"] + 1 and doubled["sum_checksum"] != a["sum_checksum"]
