"""Loading and persistence queries: S-02..S-25, I-01..I-05, Q-09, T-10, T-11,
N-01..N-08, A-24. Each query writes into a fresh folder under the session's
checkpoint directory (shared storage on a cluster) and returns what it reads
back, so the oracle compares persisted results."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from suite import register
from suite.fixtures import (SILVER_KEYS, batch_log, daily_events, late_events, silver, with_views)
from suite.repair import order, SLICE, SLICE_SQL
from tidemark.operators import names as nm
from tidemark.operators import repair as rp
from tidemark.plans import bronze, loader, repair as rplan
from tidemark.session import checkpoint_dir
from tidemark.sources import io
from tidemark.sources.tables import DRIVER_TABLES, read_table
from tidemark.streaming.daily_stream import stream_load

DAY = ["year", "month", "day"]
EV_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props", "year", "month", "day"]
EV_SQL = "event_id, ts, user_id, event_type, value, props, year, month, day"

_layouts: dict = {}


def scratch(spark, what: str) -> str:
    return os.path.join(checkpoint_dir(spark), "work", f"{what}-{uuid.uuid4().hex[:10]}")


def _layout(spark, d: str, which: str) -> str:
    """The events (or the late re-delivery) as a ``year=/month=/day=`` source."""
    key = (d, which, spark.sparkContext.applicationId)
    if key in _layouts and io.path_exists(spark, _layouts[key]):
        return _layouts[key]
    df = daily_events(spark, d) if which == "events" else late_events(spark, d)
    path = scratch(spark, f"layout-{which}")
    df.select(*EV_COLS).write.partitionBy(*DAY).parquet(path)
    _layouts[key] = path
    return path


def _copy_layout(spark, d: str, which: str = "events") -> str:
    """A private, writable copy of a layout (targets get mutated)."""
    path = scratch(spark, f"target-{which}")
    spark.read.parquet(_layout(spark, d, which)).write.partitionBy(*DAY).parquet(path)
    return path


def _ev_table(cfg_target, mode="append", keys=None):
    return loader.TableLoad(source="", target=cfg_target, mode=mode, merge_keys=keys or [], name="events")


def _read(spark, path):
    return spark.read.parquet(path).select(*EV_COLS)


EV = lambda extra: with_views(extra, "daily_events")
LATE = lambda extra: with_views(extra, "late_events")


# ------------------------------------------------------------------- I-01..I-05

@register("s06_read_day", EV(f"SELECT {EV_SQL} FROM daily_events WHERE event_date = DATE '2024-01-15'"))
def s06(spark, d):
    return io.read_day(spark, _layout(spark, d, "events"), dt.date(2024, 1, 15)).select(*EV_COLS)


@register("i01_daily_append", EV(f"SELECT {EV_SQL} FROM daily_events WHERE event_date <= DATE '2024-01-15'"))
def i01(spark, d):
    src = _layout(spark, d, "events")
    target = scratch(spark, "i01")
    spark.read.parquet(src).where(F.make_date(*DAY) < F.lit("2024-01-15").cast("date")) \
        .write.partitionBy(*DAY).parquet(target)
    cfg = loader.TableLoad(source=src, target=target, mode="append", name="events")
    res = loader.load_daily(spark, [cfg], dt.datetime(2024, 1, 16, 6, 0))
    assert res.collect()[0]["status"] == "ok"
    return _read(spark, target)


@register("i02_backfill_range", EV(
    f"SELECT {EV_SQL} FROM daily_events WHERE event_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'"))
def i02(spark, d):
    target = scratch(spark, "i02")
    cfg = loader.TableLoad(source=_layout(spark, d, "events"), target=target, mode="append", name="events")
    loader.load_range(spark, [cfg], dt.date(2024, 1, 5), dt.date(2024, 1, 12))
    return _read(spark, target)


UPSERT_SQL = with_views(f"SELECT {EV_SQL} FROM daily_events e WHERE NOT EXISTS (SELECT 1 FROM late_events l "
                        f"WHERE l.event_id = e.event_id) UNION ALL SELECT {EV_SQL} FROM late_events", "late_events")


@register("i03_lookback_upsert", UPSERT_SQL)
def i03(spark, d):
    target = _copy_layout(spark, d, "events")
    cfg = loader.TableLoad(source=_layout(spark, d, "late"), target=target, mode="upsert",
                           merge_keys=["event_id"], name="events")
    res = loader.load_with_lookback(spark, [cfg], dt.datetime(2024, 1, 31, 6, 0), lookback_days=3)
    assert res.collect()[0]["status"] == "ok", res.collect()
    return _read(spark, target)


@register("i04_intraday_append", with_views(
    f"SELECT {EV_SQL} FROM daily_events WHERE event_date <> DATE '2024-01-30' UNION ALL "
    f"SELECT {EV_SQL} FROM late_events WHERE event_date = DATE '2024-01-30'", "late_events"))
def i04(spark, d):
    target = _copy_layout(spark, d, "events")
    cfg = loader.TableLoad(source=_layout(spark, d, "late"), target=target, mode="append", name="events")
    res = loader.load_today(spark, [cfg], dt.datetime(2024, 1, 30, 14, 0))
    assert res.collect()[0]["status"] == "ok", res.collect()
    return _read(spark, target)


EV_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType())])


@register("i05_stream_upsert", UPSERT_SQL)
def i05(spark, d):
    target = _copy_layout(spark, d, "events")
    stream_load(spark, _layout(spark, d, "late"), EV_SCHEMA, target, mode="upsert", merge_keys=["event_id"],
                order_by=[F.col("ts").desc()], name=f"i05-{uuid.uuid4().hex[:8]}")
    return _read(spark, target)


def _days_apart(spark, d):
    """The last three days re-delivered one by one: each day also holds the keys of the days before, with that day's stamp."""
    path = scratch(spark, "days-apart")
    ev = spark.read.parquet(_layout(spark, d, "events")).where("year = 2024 AND month = 1 AND day >= 28")
    for day in (28, 29, 30):
        (ev.where(F.col("day") <= day).select(*EV_COLS[:4], F.lit(float(day)).alias("value"), "props", "year", "month",
                                              F.lit(day).alias("day")).write.mode("append").partitionBy(*DAY).parquet(path))
    return path


NEWEST_SQL = EV("SELECT event_id, CASE WHEN event_date >= DATE '2024-01-28' THEN 30.0 ELSE value END AS value, "
                "CASE WHEN event_date >= DATE '2024-01-28' THEN 30 ELSE day END AS day FROM daily_events")


@register("i03_days_newest_first", NEWEST_SQL)
def i03_newest_first(spark, d):
    """Days arrive newest first; the condition on the day keeps older ones from replacing newer rows."""
    target = _copy_layout(spark, d, "events")
    cfg = loader.TableLoad(source=_days_apart(spark, d), target=target, mode="upsert", merge_keys=["event_id"], version=DAY)
    for day in (30, 28, 29):
        assert loader.load_day(spark, [cfg], dt.date(2024, 1, day)).collect()[0]["status"] == "ok"
    return spark.read.parquet(target).select("event_id", "value", "day")


@register("i05_stream_newest_first", NEWEST_SQL)
def i05_newest_first(spark, d):
    """The same by a stream that sees each day in a run of its own, newest first."""
    target, src, name = _copy_layout(spark, d, "events"), scratch(spark, "i05-arrivals"), f"i05-{uuid.uuid4().hex[:8]}"
    days = spark.read.parquet(_days_apart(spark, d))
    for day in (30, 28, 29):
        days.where(F.col("day") == day).write.mode("append").partitionBy(*DAY).parquet(src)
        stream_load(spark, src, EV_SCHEMA, target, mode="upsert", merge_keys=["event_id"], name=name, version=DAY)
    return spark.read.parquet(target).select("event_id", "value", "day")


# ------------------------------------------------------------------- S-*

@register("s02_read_by_format", " UNION ALL ".join(
    f"SELECT '{f}' AS format, COUNT(*) AS rows FROM customer" for f in ("csv", "json", "orc", "parquet")))
def s02(spark, d):
    base = scratch(spark, "s02")
    c = read_table(spark, d, "customer")
    outs = []
    for fmt in ("csv", "json", "orc", "parquet"):
        c.write.format(fmt).option("header", "true").save(f"{base}/{fmt}")
        r = io.read_source(spark, f"{base}/{fmt}", fmt)
        outs.append(r.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(fmt).alias("format"), "rows"))
    return rp.union_all(outs)


@register("s04_jsonl_results",
          "SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE quality END AS quality, toxic = 1 AS is_corrupt "
          "FROM labels")
def s04(spark, d):
    path = scratch(spark, "s04")
    lab = read_table(spark, d, "labels")
    js = F.to_json(F.struct("doc_id", "quality", "toxic"))
    lab.select(F.when(F.col("toxic") == 1, F.substring(js, 1, 20)).otherwise(js).alias("value")).write.text(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                           T.StructField("toxic", T.IntegerType())])
    r = io.read_jsonl_results(spark, path, schema)
    # malformed lines keep their text; the id is recovered from it for the report
    rid = F.coalesce(F.col("doc_id"), F.regexp_extract("_corrupt_record", r'"doc_id":(\d+)', 1).cast("long"))
    return r.select(rid.alias("doc_id"), F.when(F.col("_corrupt_record").isNull(), F.col("quality"))
                    .alias("quality"), F.col("_corrupt_record").isNotNull().alias("is_corrupt"))


@register("s10_append_merge_schema",
          "SELECT c_custkey, c_name, c_acctbal, CAST(NULL AS INT) AS c_nationkey FROM customer UNION ALL "
          "SELECT s_suppkey + 1000000000, s_name, s_acctbal, s_nationkey FROM supplier")
def s10(spark, d):
    path = scratch(spark, "s10")
    io.append(read_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    io.append(read_table(spark, d, "supplier").select(
        (F.col("s_suppkey") + 1_000_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.col("s_acctbal").alias("c_acctbal"), F.col("s_nationkey").alias("c_nationkey")), path)
    return io.read_merged(spark, path)


@register("s11_overwrite", "SELECT * FROM orders WHERE year(o_orderdate) = 1998")
def s11(spark, d):
    path = scratch(spark, "s11")
    o = read_table(spark, d, "orders")
    io.overwrite(o, path, ["o_orderpriority"])
    io.overwrite(o.where(F.year("o_orderdate") == 1998), path, ["o_orderpriority"])
    return spark.read.parquet(path)


_S12_PRED = "event_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'"


@register("s12_replace_where", EV(
    f"SELECT {EV_SQL} FROM daily_events WHERE NOT ({_S12_PRED}) UNION ALL "
    f"SELECT event_id, ts, user_id, event_type, value * 2 AS value, props, year, month, day FROM daily_events "
    f"WHERE {_S12_PRED} AND event_type <> 'error'"))
def s12(spark, d):
    target = _copy_layout(spark, d, "events")
    pred = F.make_date(*DAY).between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date"))
    new = (spark.read.parquet(target).where(pred).where(F.col("event_type") != "error")
           .withColumn("value", F.col("value") * 2))
    io.write_replace_where(spark, target, new, pred, DAY)
    return _read(spark, target)


@register("s13_dynamic_overwrite", with_views(
    f"SELECT {EV_SQL} FROM daily_events WHERE event_date < DATE '2024-01-28' UNION ALL "
    f"SELECT {EV_SQL} FROM late_events", "late_events"))
def s13(spark, d):
    target = _copy_layout(spark, d, "events")
    io.overwrite_partitions(spark.read.parquet(_layout(spark, d, "late")).select(*EV_COLS), target, DAY)
    return _read(spark, target)


from suite.joblog import P13_SQL  # noqa: E402


@register("s14_export_csv", P13_SQL)
def s14(spark, d):
    """The export read back under its schema: values, NULLs and quoting survive."""
    from tidemark.operators import joblog as jl
    path = scratch(spark, "s14")
    rows = jl.results_export(batch_log(spark, d))
    io.export_csv(rows, path)
    return io.read_source(spark, path, "csv", schema=rows.schema)


@register("s15_backup", with_views(f"SELECT * FROM silver WHERE {SLICE_SQL}", "silver"))
def s15(spark, d):
    base = scratch(spark, "s15")
    bpath, n = io.create_backup(spark, silver(spark, d), rp.in_range("business_date", *SLICE), base, "fixed")
    return spark.read.parquet(bpath)


@register("s16_create_table", with_views(
    "SELECT yearmonth, COUNT(*) AS batches, CAST(SUM(total_prompts) AS BIGINT) AS prompts FROM batch_log "
    "GROUP BY yearmonth", "batch_log"))
def s16(spark, d):
    from tidemark.operators import joblog as jl
    name = f"batch_log_{uuid.uuid4().hex[:8]}"
    io.create_table(spark, name, jl.LOG_SCHEMA, partition_by=["yearmonth"], location=scratch(spark, "s16"),
                    properties={"tidemark.kind": "batch_log"})
    log = batch_log(spark, d)
    log = log.withColumn("created_date", F.to_date("created_at"))
    full = log.select(*[(F.col(f.name) if f.name in log.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in jl.LOG_SCHEMA.fields])
    full.write.insertInto(name)
    return spark.table(name).groupBy("yearmonth").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("total_prompts").cast("bigint").alias("prompts"))


@register("s17_export_modes", "SELECT doc_id, lang, COUNT(*) AS copies FROM "
          "(SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, lang FROM documents) GROUP BY doc_id, lang")
def s17(spark, d):
    path = scratch(spark, "s17")
    docs = read_table(spark, d, "documents").select("doc_id", "lang")
    io.export_table(docs, path, "replace", max_records_per_file=250)
    io.export_table(docs, path, "append", max_records_per_file=250)
    try:
        io.export_table(docs, path, "fail")
        raise AssertionError("fail mode wrote into an existing path")
    except AssertionError:
        raise
    except Exception:
        pass
    return spark.read.parquet(path).groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("copies"))


from suite.requests import M04_SQL, MONTH, sharded  # noqa: E402


@register("s18_write_shards", f"SELECT shard, COUNT(*) AS records, CAST(1 AS BIGINT) AS files FROM ({M04_SQL}) GROUP BY shard")
def s18(spark, d):
    path = scratch(spark, "s18")
    io.write_shards_jsonl(sharded(spark, d), path, MONTH)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"shard_([^/]+)[.]jsonl$", 1).alias("shard")
    return (spark.read.text(f"{path}/{MONTH}").select(name, F.col("_metadata.file_path").alias("f")).groupBy("shard")
            .agg(F.count(F.lit(1)).alias("records"), F.countDistinct("f").alias("files")))


@register("s18_shards_as_written", f"SELECT shard, 'shard_' || shard || '.jsonl' AS file, COUNT(*) AS records FROM ({M04_SQL}) GROUP BY shard")
def s18_written(spark, d):
    """The manifest that the writing tasks reported, after the month was written twice."""
    path = scratch(spark, "s18-twice")
    for rows in (sharded(spark, d).where("shard_bucket = 0"), sharded(spark, d)):
        io.write_shards_jsonl(rows, path, MONTH)
    return io.written_shards(spark, path, MONTH).select("shard", "file", "records")


@register("s19_interchange", " UNION ALL ".join(
    f"SELECT '{f}' AS format, 'B_T-1,Customer-ID,Nhóm_B,Địa_Chỉ' AS columns, COUNT(*) AS rows, "
    f"CAST(SUM(c_custkey) AS BIGINT) AS id_sum FROM customer" for f in ("json", "csv")))
def s19(spark, d):
    path = scratch(spark, "s19")
    odd = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("Customer-ID"), F.col("c_name").alias("Địa_Chỉ"),
        F.col("c_mktsegment").alias("Nhóm_B"), F.lit(None).cast("string").alias("B_T-1"))
    out = []
    for fmt in ("json", "csv"):
        io.write_interchange(odd, f"{path}/{fmt}", fmt)
        back = io.read_source(spark, f"{path}/{fmt}", fmt)
        out.append(back.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("`Customer-ID`").cast("long")).alias("id_sum"))
                   .select(F.lit(fmt).alias("format"), F.lit(",".join(sorted(back.columns))).alias("columns"), "rows", "id_sum"))
    return rp.union_all(out)


@register("s22_parquet_options", "SELECT l_returnflag, COUNT(*) AS lines FROM lineitem GROUP BY l_returnflag")
def s22(spark, d):
    path = scratch(spark, "s22")
    read_table(spark, d, "lineitem").write.options(**io.parquet_options("gzip", 64 * 1024 * 1024)).parquet(path)
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("lines"))


register("s23_manifest",
         "SELECT 'orders_db' AS source_system, 'sales' AS source_database, 'orders' AS source_table, "
         "'2024-02-01T00:00:00Z' AS extraction_timestamp, COUNT(*) AS row_count, 'v1' AS schema_version, "
         "'{\"o_orderkey\": \"bigint\", \"o_custkey\": \"bigint\", \"o_orderstatus\": \"string\", "
         "\"o_totalprice\": \"double\", \"o_orderdate\": \"timestamp_ntz\", \"o_orderpriority\": \"string\"}' "
         "AS data_types_mapping FROM orders")(
    lambda spark, d: io.extraction_manifest(read_table(spark, d, "orders"), "orders_db", "sales", "orders", "v1",
                                            dt.datetime(2024, 2, 1)))


@register("s24_restore", EV(f"SELECT {EV_SQL} FROM daily_events"))
def s24(spark, d):
    target = _copy_layout(spark, d, "events")
    pred = F.make_date(*DAY) == F.lit("2024-01-20").cast("date")
    bpath, _ = io.create_backup(spark, io.read_merged(spark, target), pred, target, "restore")
    io.write_replace_where(spark, target, spark.read.parquet(target).limit(0), pred, DAY)   # slice deleted
    io.restore_backup(spark, target, bpath, pred, DAY)
    return _read(spark, target)


@register("s25_compact", EV(f"SELECT {EV_SQL} FROM daily_events"))
def s25(spark, d):
    target = _copy_layout(spark, d, "events")
    pred = F.make_date(*DAY) <= F.lit("2024-01-07").cast("date")
    io.compact(spark, target, pred, DAY, ["user_id", "ts"])
    return _read(spark, target)


# --------------------------------------------- awkward partitions and columns

@register("s25_compact_part_of_partition", EV(f"SELECT {EV_SQL} FROM daily_events"))
def s25_part(spark, d):
    """Compaction of ten days of a table partitioned by month: the month's other days stay."""
    target = scratch(spark, "s25-part")
    spark.read.parquet(_layout(spark, d, "events")).write.partitionBy("year", "month").parquet(target)
    io.compact(spark, target, F.col("day") <= 10, ["year", "month"], ["user_id", "ts"])
    return _read(spark, target)


@register("j02_write_upsert_moved_key", EV(
    "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'moved' ELSE event_type END AS event_type, "
    "CASE WHEN user_id % 2 = 0 THEN 99 ELSE CAST(user_id % 7 AS INT) END AS part FROM daily_events"))
def j02_moved(spark, d):
    """Every second user's events move to partition 99; partitions 0 to 6 keep the others, or go where none is left."""
    target = scratch(spark, "j02-moved")
    ev = daily_events(spark, d).select("event_id", "event_type", "user_id")
    part = (F.col("user_id") % 7).cast("int")
    ev.select("event_id", "event_type", part.alias("part")).write.partitionBy("part").parquet(target)
    moved = ev.where(F.col("user_id") % 2 == 0).select("event_id", F.lit("moved").alias("event_type"), F.lit(99).alias("part"))
    io.write_upsert(spark, target, moved, ["event_id"], ["part"])
    return spark.read.parquet(target)


@register("j02_write_upsert_all_moved", EV("SELECT event_id, 'x y/z' AS part FROM daily_events"))
def j02_all_moved(spark, d):
    """All rows move, from odd folder names into another: the emptied partitions must be gone."""
    target = scratch(spark, "j02-all")
    ev = daily_events(spark, d).select("event_id", F.concat(F.lit("a b/"), F.col("event_type")).alias("part"))
    ev.write.partitionBy("part").parquet(target)
    io.write_upsert(spark, target, ev.withColumn("part", F.lit("x y/z")), ["event_id"], ["part"])
    return spark.read.parquet(target)


@register("s12_null_partition", EV(
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS part, "
    "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN -1.0 ELSE value END AS value FROM daily_events"))
def s12_null(spark, d):
    """Half the rows of the NULL partition are replaced; its other rows stay."""
    target = scratch(spark, "s12-null")
    ev = daily_events(spark, d).select(
        "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("part"), "value")
    ev.write.partitionBy("part").parquet(target)
    pred = F.col("part").isNull() & (F.col("event_id") % 2 == 0)
    io.write_replace_where(spark, target, ev.where(pred).withColumn("value", F.lit(-1.0)), pred, ["part"])
    return spark.read.parquet(target)


@register("i03_zero_padded_target", UPSERT_SQL)
def i03_padded(spark, d):
    """The lookback upsert into a target whose folders are spelled ``month=01/day=05``."""
    target = scratch(spark, "i03-padded")
    ev = spark.read.parquet(_layout(spark, d, "events"))
    padded = ev.withColumns({c: F.lpad(F.col(c).cast("string"), 2, "0") for c in ("month", "day")})
    padded.write.partitionBy(*DAY).parquet(target)
    cfg = loader.TableLoad(source=_layout(spark, d, "late"), target=target, mode="upsert", merge_keys=["event_id"], name="events")
    res = loader.load_with_lookback(spark, [cfg], dt.datetime(2024, 1, 31, 6, 0), lookback_days=3)
    assert res.collect()[0]["status"] == "ok", res.collect()
    return _read(spark, target)


@register("i01_schema_evolution", EV(
    "SELECT event_id, day, CASE WHEN day = 29 THEN 'first' WHEN day = 30 THEN 'second' END AS extra, "
    "CASE WHEN day = 30 THEN value + 1 ELSE value END AS value FROM daily_events"))
def evolve(spark, d):
    """A day with a new column is appended, the next is upserted, a slice is backed up, deleted and restored, and a day is
    compacted: the column and its values stay."""
    src, target = scratch(spark, "evolve-src"), scratch(spark, "evolve")
    ev = spark.read.parquet(_layout(spark, d, "events")).select("event_id", "value", *DAY)
    ev.where("day < 29").write.partitionBy(*DAY).parquet(target)
    ev.where("day = 29").withColumn("extra", F.lit("first")).write.partitionBy(*DAY).parquet(src)
    ev.where("day = 30").withColumn("extra", F.lit("old")).write.mode("append").partitionBy(*DAY).parquet(src)
    # day 31's file lacks the column: the source as a whole has two schemas
    ev.where("day = 31").write.mode("append").partitionBy(*DAY).parquet(src)
    cfg = loader.TableLoad(source=src, target=target, mode="append", name="events")
    for day in (29, 30, 31):
        loader.load_day(spark, [cfg], dt.date(2024, 1, day))
    late = (ev.where("day = 30").withColumn("value", F.col("value") + 1).withColumn("extra", F.lit("second")))
    io.write_upsert(spark, target, late, ["event_id"], DAY)
    pred = F.col("day").isin(28, 29)
    bpath, _ = io.create_backup(spark, io.read_merged(spark, target), pred, target, "evolve")
    io.write_replace_where(spark, target, io.read_merged(spark, target).limit(0), pred, DAY)
    io.restore_backup(spark, target, bpath, pred, DAY)
    io.compact(spark, target, F.col("day") == 29, DAY, ["event_id"])
    return io.read_merged(spark, target).select("event_id", "day", "extra", "value")


# ------------------------------------------------------------------- plans

@register("q09_safe_replace_dedup", with_views(
    "WITH sm AS (SELECT *, strftime(business_date, '%Y-%m') AS business_month FROM silver) "
    f"SELECT * FROM sm WHERE NOT ({SLICE_SQL}) UNION ALL SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() "
    "OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn "
    f"FROM sm WHERE {SLICE_SQL}) WHERE rn = 1", "silver"))
def q09(spark, d):
    path = scratch(spark, "q09")
    (silver(spark, d).withColumn("business_month", F.date_format("business_date", "yyyy-MM"))
     .write.partitionBy("business_month").parquet(path))
    rplan.dedup_and_replace(spark, path, "business_date", *SLICE, SILVER_KEYS, order(), ["business_month"])
    return spark.read.parquet(path)


@register("t11_incremental_load",
          "SELECT CAST(year(o_orderdate) AS VARCHAR) AS report_date, COUNT(*) AS record_count FROM orders "
          "WHERE year(o_orderdate) > 1998 GROUP BY 1")
def t11(spark, d):
    from suite.drift import FORMATS, MAPPING, PART, write_drifting_source
    src = write_drifting_source(spark, d)
    target = scratch(spark, "t11")
    from tidemark.operators import drift as dr
    first = dr.load_aligned(spark, src, PART, MAPPING, FORMATS).where(F.col(PART) <= "1998")
    io.append(bronze.add_load_metadata(first, dt.datetime(2024, 1, 1), src, "1"), target, [PART])
    return bronze.incremental_load(spark, src, PART, MAPPING, target, dt.datetime(2024, 2, 1), "1", FORMATS)


# ------------------------------------------------------------------- names

def _registry(spark, d):
    cols = {t: read_table(spark, d, t).columns for t in DRIVER_TABLES}
    return nm.register_mappings(None, nm.mapping_frames(spark, "warehouse", "main", cols, "2024-02-01"))


_REG_SQL = ("SELECT 'warehouse' AS source_database, 'main' AS source_schema, table_name AS source_table, "
            "column_name AS original_column_name, column_name AS avro_compatible_name, "
            "DATE '2024-02-01' AS created_date FROM information_schema.columns WHERE table_name IN (" +
            ", ".join(f"'{t}'" for t in DRIVER_TABLES) + ")")

_ROWS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS source_table, COUNT(*) AS source_rows FROM {t}" for t in DRIVER_TABLES)


def _source_rows(spark, d):
    return rp.union_by_name([read_table(spark, d, t).agg(F.count(F.lit(1)).alias("source_rows"))
                             .select(F.lit(t).alias("source_table"), "source_rows") for t in DRIVER_TABLES])


# The registry and its summary beside the rows of each registered table.
register("n04_mapping_registry", f"SELECT * FROM ({_REG_SQL}) JOIN ({_ROWS_SQL}) USING (source_table)")(
    lambda spark, d: _registry(spark, d).join(_source_rows(spark, d), "source_table"))
register("a24_mapping_summary",
         f"SELECT * FROM (SELECT source_table, COUNT(*) AS column_count, COUNT(*) FILTER (WHERE original_column_name <> "
         f"avro_compatible_name) AS transformed_count FROM ({_REG_SQL}) GROUP BY source_table) JOIN ({_ROWS_SQL}) "
         "USING (source_table)")(
    lambda spark, d: nm.mapping_summary(_registry(spark, d)).join(_source_rows(spark, d), "source_table"))


_N08 = [("Khách Hàng", o, s) for o, s in (
    ("Customer-ID", "Customer_ID"), ("Địa_Chỉ", "Dia_Chi"), ("Nhóm_B", "Nhom_B"), ("B_T-1", "B_T_1"), ("Normal_Column",) * 2)]
_N08 += [("orders", c, c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]


@register("n08_migrate_tables", "SELECT source_table, 'warehouse' AS source_database, 'main' AS source_schema, "
          "original_column_name, avro_compatible_name, DATE '2024-02-01' AS created_date, 'success' AS status, target_rows "
          "FROM (VALUES " + ", ".join(f"('{t}', '{o}', '{s}')" for t, o, s in _N08) +
          ") v(source_table, original_column_name, avro_compatible_name) JOIN (SELECT 'Khách Hàng' AS t, COUNT(*) AS target_rows "
          "FROM customer UNION ALL SELECT 'orders', COUNT(*) FROM orders) n ON n.t = v.source_table")
def n08(spark, d):
    from tidemark.plans.migrate import migrate_tables
    c = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("Customer-ID"), F.col("c_name").alias("Địa_Chỉ"),
        F.col("c_mktsegment").alias("Nhóm_B"), F.col("c_acctbal").alias("B_T-1"),
        F.col("c_nationkey").alias("Normal_Column"))
    status, registry = migrate_tables(spark, {"Khách Hàng": c, "orders": read_table(spark, d, "orders")},
                                      scratch(spark, "n08"), "warehouse", "main", dt.date(2024, 2, 1))
    rows = rp.union_by_name([spark.read.parquet(r["target"]).agg(F.count(F.lit(1)).alias("target_rows"))
                             .select(F.lit(r["table_name"]).alias("source_table"), "target_rows") for r in status.collect()])
    return (registry.join(status.select(F.col("table_name").alias("source_table"), "status"), "source_table")
            .join(rows, "source_table"))
