"""Repair queries over the ``silver`` fixture (lineitem keyed by
(l_orderkey, l_linenumber), which holds real duplicate keys): W-01, W-02,
A-18..A-21, A-27, L-02..L-04, U-01..U-05."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import register
from suite.fixtures import SILVER_KEYS, daily_events, silver, with_views
from tidemark.operators import repair as rp
from tidemark.sources.tables import read_table


def order():
    """Newest first; a total order inside a key (W-01 needs a full tie-break)."""
    return [F.col("l_shipdate").desc(), F.col("l_partkey").desc(), F.col("l_suppkey").desc()]


ORDER_SQL = "l_shipdate DESC, l_partkey DESC, l_suppkey DESC"
SLICE = ("1998-09-01", "1998-09-30")
SLICE_SQL = "business_date BETWEEN DATE '1998-09-01' AND DATE '1998-09-30'"


def S(sql, *extra):
    return with_views(sql, "silver", *extra)


DEDUP_ALL_SQL = ("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, "
                 f"l_linenumber ORDER BY {ORDER_SQL}) AS rn FROM silver) WHERE rn = 1")
DEDUP_SLICE_SQL = ("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, "
                   f"l_linenumber ORDER BY {ORDER_SQL}) AS rn FROM silver WHERE {SLICE_SQL}) WHERE rn = 1")


def _dedup_slice(spark, d):
    return rp.dedup_slice(silver(spark, d), "business_date", *SLICE, SILVER_KEYS, order())


register("w01_latest_per_key", S(DEDUP_ALL_SQL))(
    lambda spark, d: rp.latest_per_key(silver(spark, d), SILVER_KEYS, order()))

register("w02_dedup_slice", S(DEDUP_SLICE_SQL))(lambda spark, d: _dedup_slice(spark, d)[0])

register("w02_dedup_proof", S(
    f"SELECT COUNT(*) AS rows_before, COUNT(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys_before, "
    f"(SELECT COUNT(*) FROM ({DEDUP_SLICE_SQL})) AS rows_after, "
    f"(SELECT COUNT(*) FROM ({DEDUP_SLICE_SQL})) = COUNT(DISTINCT (l_orderkey, l_linenumber)) AS ok "
    f"FROM silver WHERE {SLICE_SQL}"))(lambda spark, d: _dedup_slice(spark, d)[1])

register("a18_duplicate_totals", S(
    "SELECT COUNT(*) AS total_records, COUNT(DISTINCT (l_orderkey, l_linenumber)) AS unique_records, "
    "COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_count FROM silver"))(
    lambda spark, d: rp.duplicate_totals(silver(spark, d), SILVER_KEYS))

register("a19_duplicate_detail", S(
    "SELECT l_orderkey, l_linenumber, COUNT(*) AS occurrence_count FROM silver "
    "GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1 "
    "ORDER BY occurrence_count DESC, l_orderkey, l_linenumber LIMIT 100"))(
    lambda spark, d: rp.duplicate_detail(silver(spark, d), SILVER_KEYS, 100))


def _coverage(spark, d):
    s = silver(spark, d)
    bronze = rp.date_coverage(s, "business_date", *SLICE, layer="bronze")
    dedup = rp.date_coverage(rp.latest_per_key(s, SILVER_KEYS, order()), "business_date", *SLICE, layer="silver")
    return bronze.unionByName(dedup)


def _cov_sql(src):
    return (f"SELECT COUNT(*) AS total_records, MIN(business_date) AS earliest_date, "
            f"MAX(business_date) AS latest_date, COUNT(DISTINCT business_date) AS distinct_days "
            f"FROM {src} WHERE {SLICE_SQL}")


register("a20_date_coverage", S(
    f"SELECT 'bronze' AS layer, * FROM ({_cov_sql('silver')}) UNION ALL "
    f"SELECT 'silver', * FROM ({_cov_sql('(' + DEDUP_ALL_SQL + ')')})"))(_coverage)

register("a21_partition_counts", with_views(
    "SELECT event_date, COUNT(*) AS record_count FROM daily_events GROUP BY event_date ORDER BY event_date",
    "daily_events"))(lambda spark, d: rp.partition_counts(daily_events(spark, d), "event_date"))


def _rollup(spark, d):
    aggs = [F.count(F.lit(1)).alias("line_count"),
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("sum_qty"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("sum_price"),
            F.max("l_discount").alias("max_discount")]
    return rp.rollup(silver(spark, d), ["l_returnflag", "l_linestatus"], "business_date", *SLICE, aggs)


register("a27_rollup", S(
    "SELECT l_returnflag, l_linestatus, business_date, COUNT(*) AS line_count, "
    "SUM(CAST(l_quantity AS DECIMAL(18,2))) AS sum_qty, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS sum_price, "
    f"MAX(l_discount) AS max_discount FROM silver WHERE {SLICE_SQL} "
    "GROUP BY l_returnflag, l_linestatus, business_date"))(_rollup)

CATS = ["purchase", "signup", "click", "view", "error"]
register("l02_custom_order", with_views(
    "SELECT event_type, COUNT(*) AS events FROM daily_events GROUP BY event_type ORDER BY CASE event_type "
    + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATS, 1)) + " ELSE 6 END", "daily_events"))(
    lambda spark, d: rp.sort_by_category(
        daily_events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("events")),
        "event_type", CATS))

register("l03_sample_rows", "SELECT doc_id, lang, n_chars FROM documents "
         "ORDER BY md5('s1' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 20")(
    lambda spark, d: rp.sample_rows(read_table(spark, d, "documents").select("doc_id", "lang", "n_chars"),
                                    20, ["doc_id"], "s1"))

register("l03_top_k", "SELECT c_custkey, c_name, c_acctbal FROM customer "
         "ORDER BY c_acctbal DESC, c_custkey LIMIT 10")(
    lambda spark, d: read_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    .orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(10))

register("l04_stride_sample", with_views(
    "WITH v AS (SELECT event_date, row_number() OVER (ORDER BY event_date) - 1 AS i, COUNT(*) OVER () AS n "
    "FROM (SELECT DISTINCT event_date FROM daily_events)) "
    "SELECT event_date FROM v WHERE i % greatest(1, n // 7) = 0 OR i = n - 1 ORDER BY event_date",
    "daily_events"))(lambda spark, d: rp.stride_sample(daily_events(spark, d), "event_date", 7))


def _u01(spark, d):
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("party_id"),
                                                F.col("c_name").alias("name"), "c_mktsegment")
    s = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("party_id"),
                                                F.col("s_name").alias("name"), "s_nationkey")
    return rp.union_by_name([c, s])


register("u01_union_by_name",
         "SELECT c_custkey AS party_id, c_name AS name, c_mktsegment, CAST(NULL AS INT) AS s_nationkey "
         "FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier")(_u01)

register("u02_union_all", "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL "
         "SELECT r_name, 'region' FROM region")(
    lambda spark, d: rp.union_all([
        read_table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")),
        read_table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind"))]))

register("u03_difference", "SELECT * FROM customer c WHERE NOT EXISTS "
         "(SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")(
    lambda spark, d: rp.difference(read_table(spark, d, "customer"),
                                   read_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")),
                                   ["c_custkey"]))

register("u04_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(
    lambda spark, d: rp.distinct_rows(read_table(spark, d, "lineitem").select("l_returnflag", "l_linestatus")))

register("u05_drop_duplicate_keys", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")(
    lambda spark, d: rp.drop_duplicate_keys(read_table(spark, d, "lineitem"), SILVER_KEYS)
    .select(*SILVER_KEYS))
