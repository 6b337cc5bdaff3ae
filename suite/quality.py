"""Quality-gate queries: Q-01, Q-03..Q-08, Q-10, Q-11, A-23, A-26, P-07..P-11, P-14."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import register
from suite.fixtures import SILVER_KEYS, daily_events, silver, typed_text, with_views
from suite.repair import DEDUP_ALL_SQL, order
from tidemark.operators import quality as qa
from tidemark.operators import repair as rp
from tidemark.sources.tables import read_table


def _slices(spark, d):
    """The whole table and its rows without repeated keys."""
    s = silver(spark, d)
    return s, rp.latest_per_key(s, SILVER_KEYS, order())


def _q01(spark, d):
    cur, new = _slices(spark, d)
    return qa.row_count_change(cur, new, 20.0)


register("q01_row_count_change", with_views(
    f"WITH c AS (SELECT COUNT(*) AS n FROM silver), x AS (SELECT COUNT(*) AS n FROM "
    f"({DEDUP_ALL_SQL})) SELECT c.n AS current_count, x.n AS new_count, "
    "CASE WHEN c.n > 0 THEN abs(x.n - c.n) * CAST(100 AS DOUBLE) / c.n END AS pct_change, "
    "COALESCE(CASE WHEN c.n > 0 THEN abs(x.n - c.n) * CAST(100 AS DOUBLE) / c.n END <= 20.0, true) AS passed "
    "FROM c, x", "silver"))(_q01)

_EV = ["event_id", "ts", "user_id", "event_type", "value", "props"]
register("q03_null_checks", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT 'no_nulls:{c}' AS check, COUNT(*) FILTER (WHERE {c} IS NULL) = 0 AS passed, "
    f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) AS value FROM events" for c in _EV) + ")")(
    lambda spark, d: qa.null_checks(read_table(spark, d, "events"), _EV))

register("q04_no_duplicate_keys", with_views(
    f"SELECT COUNT(*) AS total_records, COUNT(DISTINCT (l_orderkey, l_linenumber)) AS unique_records, "
    f"COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_count FROM ({DEDUP_ALL_SQL})",
    "silver"))(lambda spark, d: rp.duplicate_totals(_slices(spark, d)[1], SILVER_KEYS))

DAY_LOAD_SQL = "event_date BETWEEN DATE '2024-01-14' AND DATE '2024-01-15'"


def _day_load(spark, d):
    return daily_events(spark, d).where(F.col("event_date").between(
        F.lit("2024-01-14").cast("date"), F.lit("2024-01-15").cast("date")))


register("q05_off_date_rows", with_views(
    f"SELECT * FROM daily_events WHERE {DAY_LOAD_SQL} AND NOT COALESCE(event_date = DATE '2024-01-15', false)",
    "daily_events"))(lambda spark, d: qa.off_date_rows(_day_load(spark, d), "event_date", "2024-01-15"))

register("q06_row_count_in_range",
         "SELECT COUNT(*) AS row_count, COUNT(*) BETWEEN 1000 AND 1000000 AS passed FROM events")(
    lambda spark, d: qa.row_count_in_range(read_table(spark, d, "events"), 1000, 1_000_000))

register("q07_missing_days", with_views(
    "SELECT d AS event_date FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', "
    "INTERVAL 1 DAY)) AS DATE) AS d) WHERE d NOT IN (SELECT event_date FROM daily_events)", "daily_events"))(
    lambda spark, d: qa.missing_days(daily_events(spark, d), "event_date", "2023-12-25", "2024-02-05"))

register("q07_day_completeness", with_views(
    "SELECT 31 AS expected_days, COUNT(DISTINCT event_date) AS distinct_days, "
    "COUNT(DISTINCT event_date) = 31 AS complete FROM daily_events "
    "WHERE event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'", "daily_events"))(
    lambda spark, d: qa.day_completeness(daily_events(spark, d), "event_date", "2024-01-01", "2024-01-31"))

_GATE_DAY = "1998-09-15"


def _q08(spark, d):
    s = silver(spark, d).where(F.col("business_date") == F.lit(_GATE_DAY).cast("date"))
    dd = rp.latest_per_key(s, SILVER_KEYS, order())
    return qa.silver_gate(dd, SILVER_KEYS, "business_date", _GATE_DAY, 1, 10_000_000)


_G = ("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY "
      "l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM silver WHERE business_date = DATE '1998-09-15') "
      "WHERE rn = 1")
register("q08_silver_gate", with_views(
    f"WITH g AS ({_G}), a AS (SELECT COUNT(*) AS r, COUNT(DISTINCT (l_orderkey, l_linenumber)) AS k, "
    "COUNT(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS nk, "
    "COUNT(*) FILTER (WHERE NOT COALESCE(business_date = DATE '1998-09-15', false)) AS wd FROM g) "
    "SELECT 'no_duplicates' AS check, r = k AS passed, CAST(r - k AS DOUBLE) AS value FROM a UNION ALL "
    "SELECT 'no_null_keys', nk = 0, CAST(nk AS DOUBLE) FROM a UNION ALL "
    "SELECT 'correct_date', wd = 0, CAST(wd AS DOUBLE) FROM a UNION ALL "
    "SELECT 'count_in_range', r BETWEEN 1 AND 10000000, CAST(r AS DOUBLE) FROM a", "silver"))(_q08)


def _q08r(spark, d):
    cur, new = _slices(spark, d)
    return qa.replacement_gate(cur, new, SILVER_KEYS + ["business_date"], 20.0)


register("q08_replacement_gate", with_views(
    f"WITH c AS (SELECT COUNT(*) AS n FROM silver), x AS (SELECT COUNT(*) AS n FROM "
    f"({DEDUP_ALL_SQL})), nw AS ({DEDUP_ALL_SQL}) "
    "SELECT 'row_count_change' AS check, COALESCE(CASE WHEN c.n > 0 THEN abs(x.n - c.n) * CAST(100 AS DOUBLE) "
    "/ c.n END <= 20.0, true) AS passed, CASE WHEN c.n > 0 THEN abs(x.n - c.n) * CAST(100 AS DOUBLE) / c.n END "
    "AS value FROM c, x UNION ALL SELECT 'schema_equal', true, 1.0 UNION ALL " + " UNION ALL ".join(
        f"SELECT 'no_nulls:{k}', COUNT(*) FILTER (WHERE {k} IS NULL) = 0, "
        f"CAST(COUNT(*) FILTER (WHERE {k} IS NULL) AS DOUBLE) FROM nw"
        for k in SILVER_KEYS + ["business_date"]), "silver"))(_q08r)

register("q10_already_processed", with_views(
    "SELECT COUNT(*) > 0 AS processed FROM daily_events WHERE event_date = DATE '2024-01-15'", "daily_events"))(
    lambda spark, d: qa.already_processed(daily_events(spark, d), "event_date", "2024-01-15"))

_BOOL_WORDS = "('true','1','yes','y','t','false','0','no','n','f')"


def _q11(spark, d):
    t = typed_text(spark, d)
    rules = {
        "id_not_integer": F.col("id").try_cast("bigint").isNotNull(),
        "bad_order_date": F.try_to_date(F.col("order_date"), "yyyy-MM-dd").isNotNull(),
        "amount_not_decimal": F.col("amount").try_cast("decimal(18,2)").isNotNull(),
        "amount_out_of_range": F.col("amount").try_cast("decimal(18,2)").between(0, 1_000_000),
        "not_boolean": F.lower(F.trim("is_active")).isin("true", "1", "yes", "y", "t", "false", "0", "no", "n", "f"),
    }
    v = qa.validate_records(t, rules)
    return v.select("id", F.concat_ws(";", "reasons").alias("reasons"), "is_valid")


_R = [("id_not_integer", "TRY_CAST(id AS BIGINT) IS NOT NULL"),
      ("bad_order_date", "TRY_CAST(try_strptime(order_date, '%Y-%m-%d') AS DATE) IS NOT NULL"),
      ("amount_not_decimal", "TRY_CAST(amount AS DECIMAL(18,2)) IS NOT NULL"),
      ("amount_out_of_range", "TRY_CAST(amount AS DECIMAL(18,2)) BETWEEN 0 AND 1000000"),
      ("not_boolean", f"lower(trim(is_active)) IN {_BOOL_WORDS}")]
register("q11_validate_records", with_views(
    "SELECT id, concat_ws(';', " + ", ".join(f"CASE WHEN NOT COALESCE({e}, false) THEN '{n}' END" for n, e in _R)
    + ") AS reasons, " + " AND ".join(f"COALESCE({e}, false)" for _, e in _R) + " AS is_valid FROM typed_text",
    "typed_text"))(_q11)

register("a23_freshness", with_views(
    "SELECT table_name, latest_date, date_diff('day', latest_date, DATE '2024-02-01') AS days_behind FROM ("
    "SELECT 'orders' AS table_name, MAX(CAST(o_orderdate AS DATE)) AS latest_date FROM orders UNION ALL "
    "SELECT 'lineitem', MAX(CAST(l_shipdate AS DATE)) FROM lineitem UNION ALL "
    "SELECT 'events', MAX(event_date) FROM daily_events)", "daily_events"))(
    lambda spark, d: qa.freshness({
        "orders": read_table(spark, d, "orders").withColumnRenamed("o_orderdate", "day"),
        "lineitem": read_table(spark, d, "lineitem").withColumnRenamed("l_shipdate", "day"),
        "events": daily_events(spark, d).drop("day").withColumnRenamed("event_date", "day")},
        "day", "2024-02-01"))


def _a26(spark, d):
    cur, new = _slices(spark, d)
    return qa.decimal_sums({"bronze": cur, "silver": new}, "l_extendedprice")


register("a26_decimal_sums", with_views(
    f"SELECT 'bronze' AS side, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM silver "
    f"UNION ALL SELECT 'silver', SUM(CAST(l_extendedprice AS DECIMAL(18,2))) "
    f"FROM ({DEDUP_ALL_SQL})", "silver"))(_a26)

# P-07 .. P-11, P-14: predicates and projections as stand-alone queries.
register("p07_date_range", "SELECT * FROM lineitem WHERE CAST(l_shipdate AS DATE) "
         "BETWEEN DATE '1998-09-01' AND DATE '1998-09-30'")(
    lambda spark, d: read_table(spark, d, "lineitem").where(
        F.to_date("l_shipdate").between(F.lit("1998-09-01").cast("date"), F.lit("1998-09-30").cast("date"))))

register("p08_null_predicates", with_views(
    "SELECT COUNT(*) FILTER (WHERE completed_at IS NULL) AS open_rows, "
    "COUNT(*) FILTER (WHERE error_message IS NOT NULL) AS with_error FROM batch_log", "batch_log"))(
    lambda spark, d: __import__("suite.fixtures", fromlist=["batch_log"]).batch_log(spark, d).agg(
        F.count(F.when(F.col("completed_at").isNull(), 1)).alias("open_rows"),
        F.count(F.when(F.col("error_message").isNotNull(), 1)).alias("with_error")))

register("p09_case_buckets",
         "SELECT CASE WHEN value < 100 THEN 'low' WHEN value < 300 THEN 'mid' ELSE 'high' END AS bucket, "
         "COUNT(*) AS events, SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchases FROM events "
         "GROUP BY 1")(
    lambda spark, d: read_table(spark, d, "events").groupBy(
        F.when(F.col("value") < 100, "low").when(F.col("value") < 300, "mid").otherwise("high").alias("bucket"))
    .agg(F.count(F.lit(1)).alias("events"),
         F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).cast("bigint").alias("purchases")))

register("p10_having",
         "SELECT user_id, COUNT(*) AS events FROM events GROUP BY user_id HAVING COUNT(*) > 70")(
    lambda spark, d: read_table(spark, d, "events").groupBy("user_id")
    .agg(F.count(F.lit(1)).alias("events")).where(F.col("events") > 70))

register("p11_rename_drop",
         "SELECT c_custkey AS customer_id, c_name AS customer_name, c_acctbal FROM customer")(
    lambda spark, d: read_table(spark, d, "customer")
    .withColumnsRenamed({"c_custkey": "customer_id", "c_name": "customer_name"})
    .drop("c_nationkey", "c_mktsegment"))

register("p14_date_mismatch", with_views(
    "SELECT * FROM silver WHERE business_date BETWEEN DATE '1998-09-14' AND DATE '1998-09-15' "
    "AND NOT COALESCE(business_date = DATE '1998-09-15', false)", "silver"))(
    lambda spark, d: qa.off_date_rows(
        silver(spark, d).where(F.col("business_date").between(F.lit("1998-09-14").cast("date"),
                                                               F.lit("1998-09-15").cast("date"))),
        "business_date", "1998-09-15"))
