"""Quality gates and profiling (Q-01..Q-08, Q-10, Q-11, Q-13, A-22, A-23, A-26).

A gate is computed as **one** aggregation producing long rows
``(check, passed, value)``; :func:`raise_on_failure` is the only action and
the only place that raises. It stands in for a chain of separate
``count()`` jobs with a single scan.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.repair import key_struct


def _long(df_one_row: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """Turn one aggregated row into (check, passed, value) rows."""
    return df_one_row.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("check"), passed.alias("passed"), value.cast("double").alias("value"))
        for name, passed, value in checks])).alias("r")).select("r.*")


def row_count_change(current: DataFrame, new: DataFrame, tolerance_pct: float = 20.0) -> DataFrame:
    """Q-01: counts of both sides, percent change and pass flag; one row.

    An empty current side passes (nothing to compare with, D-13). The two
    counts are stacked and folded by one tiny aggregation (no cross join).
    """
    both = (current.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("current"))
            .unionByName(new.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("new"))))
    r = both.agg(F.max(F.when(F.col("side") == "current", F.col("n"))).alias("current_count"),
                 F.max(F.when(F.col("side") == "new", F.col("n"))).alias("new_count"))
    pct = F.when(F.col("current_count") > 0,
                 F.abs(F.col("new_count") - F.col("current_count")) * 100.0 / F.col("current_count"))
    return r.withColumn("pct_change", pct).withColumn(
        "passed", F.coalesce(F.col("pct_change") <= F.lit(float(tolerance_pct)), F.lit(True)))


def schema_diff(expected: T.StructType, actual: T.StructType) -> list[tuple[str, str, str, str]]:
    """Q-02: (column, expected type, actual type, status) ignoring nullability.

    Plan-time only: compares two schemas, touches no data.
    """
    e = {f.name: f.dataType for f in expected.fields}
    a = {f.name: f.dataType for f in actual.fields}
    out = []
    for name in list(e) + [n for n in a if n not in e]:
        et, at = e.get(name), a.get(name)
        status = ("MISSING" if at is None else "EXTRA" if et is None
                  else "PASS" if et == at else "FAIL")
        out.append((name, et.simpleString() if et else None, at.simpleString() if at else None, status))
    return out


def schemas_equal(expected: T.StructType, actual: T.StructType) -> bool:
    return all(s == "PASS" for *_, s in schema_diff(expected, actual))


def schema_check(spark: SparkSession, expected: T.StructType, actual: T.StructType) -> DataFrame:
    """Q-02 as data: one row per column (column_name, expected_type,
    actual_type, status)."""
    return spark.createDataFrame(schema_diff(expected, actual),
                                 "column_name string, expected_type string, actual_type string, status string")


def type_preservation(source: DataFrame, target: DataFrame) -> DataFrame:
    """Q-14: per source column, its type on both sides and whether the
    target kept it (exact type, nullability ignored)."""
    tt = {f.name: f.dataType for f in target.schema.fields}
    rows = [(f.name, f.dataType.simpleString(), tt[f.name].simpleString() if f.name in tt else None,
             f.name in tt and tt[f.name] == f.dataType) for f in source.schema.fields]
    return source.sparkSession.createDataFrame(
        rows, "column_name string, source_type string, target_type string, preserved boolean")


def null_checks(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q-03: one pass; per column ``no_nulls:<col>`` with the null count."""
    agg = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    return _long(agg, [(f"no_nulls:{c}", F.col(c) == 0, F.col(c)) for c in cols])


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A-22: null count and percent per column, from one aggregation,
    unpivoted with ``stack``."""
    cols = cols or df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__total"),
                 *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"__n{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', __n{i}" for i, c in enumerate(cols))
    st = agg.selectExpr("__total", f"stack({len(cols)}, {pairs}) AS (column_name, null_count)")
    return st.select("column_name", F.col("null_count").cast("bigint").alias("null_count"),
                     F.when(F.col("__total") > 0, F.col("null_count") * 100.0 / F.col("__total"))
                     .otherwise(F.lit(0.0)).alias("null_pct"))


def null_parity(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Q-13: null counts per column on both sides and whether they agree."""
    l_ = null_profile(left, cols).select("column_name", F.col("null_count").alias("source_nulls"))
    r = null_profile(right, cols).select("column_name", F.col("null_count").alias("target_nulls"))
    return l_.join(r, "column_name", "full").withColumn(
        "equal", F.col("source_nulls").eqNullSafe(F.col("target_nulls")))


def silver_gate(df: DataFrame, keys: list[str], date_col: str, expected_date,
                min_rows: int, max_rows: int, critical: list[str] | None = None) -> DataFrame:
    """Q-08 (with Q-03..Q-06): the whole silver gate in one aggregation.

    Checks: no_duplicates (rows == distinct keys), no_null_keys, correct_date
    (a NULL date fails too), count_in_range. Returns (check, passed, value).
    """
    critical = critical or keys
    exp = F.lit(str(expected_date)).cast("date")
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in critical])
    agg = df.agg(F.count(F.lit(1)).alias("rows"),
                 F.countDistinct(key_struct(keys)).alias("keys"),
                 F.count(F.when(any_null, 1)).alias("null_keys"),
                 F.count(F.when(~F.coalesce(F.col(date_col) == exp, F.lit(False)), 1)).alias("wrong_date"))
    return _long(agg, [
        ("no_duplicates", F.col("rows") == F.col("keys"), F.col("rows") - F.col("keys")),
        ("no_null_keys", F.col("null_keys") == 0, F.col("null_keys")),
        ("correct_date", F.col("wrong_date") == 0, F.col("wrong_date")),
        ("count_in_range", F.col("rows").between(min_rows, max_rows), F.col("rows")),
    ])


def replacement_gate(current: DataFrame, new: DataFrame, critical: list[str],
                     tolerance_pct: float = 20.0) -> DataFrame:
    """Q-08 (replacement form): count change within tolerance, schema equal
    (nullability ignored), no NULLs in critical columns; (check, passed, value)."""
    change = row_count_change(current, new, tolerance_pct)
    parts = [_long(change, [("row_count_change", F.col("passed"), F.col("pct_change"))])]
    same = schemas_equal(current.schema, new.schema)
    parts.append(_long(new.sparkSession.range(1),
                       [("schema_equal", F.lit(same), F.lit(1.0 if same else 0.0))]))
    parts.append(null_checks(new, critical))
    return reduce(lambda a, b: a.unionByName(b), parts)


class GateFailed(ValueError):
    pass


def raise_on_failure(checks: DataFrame) -> list[str]:
    """Run a gate (one small action) and raise if any check failed."""
    rows = checks.collect()
    failed = [r["check"] for r in rows if not r["passed"]]
    if failed:
        raise GateFailed(f"gate not passed: {", ".join(failed)}")
    return [r["check"] for r in rows]


def row_count_in_range(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Q-06: one row (row_count, passed)."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "passed", F.col("row_count").between(lo, hi))


def off_date_rows(df: DataFrame, date_col: str, expected_date) -> DataFrame:
    """P-14 / Q-05: rows whose business date is not the expected one (NULL too)."""
    exp = F.lit(str(expected_date)).cast("date")
    return df.where(~F.coalesce(F.col(date_col) == exp, F.lit(False)))


def missing_days(df: DataFrame, date_col: str, start, end) -> DataFrame:
    """Q-07: calendar days of [start, end] with no row; the calendar is
    generated by ``sequence`` on an executor, the present days by a
    distributed distinct."""
    spark = df.sparkSession
    cal = spark.range(1).select(F.explode(F.sequence(F.lit(str(start)).cast("date"),
                                                     F.lit(str(end)).cast("date"))).alias(date_col))
    present = df.select(F.col(date_col).cast("date").alias(date_col)).distinct()
    return cal.join(present, date_col, "left_anti")


def day_completeness(df: DataFrame, date_col: str, start, end) -> DataFrame:
    """Q-07: one row: expected days, distinct days present, complete flag."""
    s = dt.date.fromisoformat(str(start))
    e = dt.date.fromisoformat(str(end))
    expected = (e - s).days + 1
    lo, hi = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    return (df.where(F.col(date_col).between(lo, hi))
            .agg(F.countDistinct(date_col).alias("distinct_days"))
            .select(F.lit(expected).alias("expected_days"), "distinct_days",
                    (F.col("distinct_days") == expected).alias("complete")))


def already_processed(df: DataFrame, date_col: str, day) -> DataFrame:
    """Q-10 as data: one row (processed) -- any row on ``day``."""
    return df.where(F.col(date_col) == F.lit(str(day)).cast("date")).agg(
        (F.count(F.lit(1)) > 0).alias("processed"))


def is_partition_processed(spark: SparkSession, table: str, date_col: str, day) -> bool:
    """Q-10: True when the table has a row on ``day``; only a missing table
    counts as 'no' -- any other error propagates."""
    if not spark.catalog.tableExists(table):
        return False
    return not spark.table(table).where(F.col(date_col) == F.lit(str(day)).cast("date")).isEmpty()


def validate_records(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Q-11: add ``reasons`` (names of failed rules, in rule order) and
    ``is_valid``. A rule is a boolean Column; NULL counts as failed."""
    reasons = F.filter(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]),
                       lambda x: x.isNotNull())
    return df.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Q-11: (valid rows, quarantined rows with reasons)."""
    v = validate_records(df, rules)
    return v.where("is_valid").drop("reasons", "is_valid"), v.where(~F.col("is_valid")).drop("is_valid")


def freshness(tables: dict[str, DataFrame], date_col: str, as_of) -> DataFrame:
    """A-23: per table the latest date and its lag in days behind ``as_of``
    (one level of MAX, D-21)."""
    parts = [df.agg(F.max(F.col(date_col).cast("date")).alias("latest_date"))
             .select(F.lit(name).alias("table_name"), "latest_date") for name, df in tables.items()]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    return u.withColumn("days_behind", F.datediff(F.lit(str(as_of)[:10]).cast("date"), F.col("latest_date")))


def decimal_sums(tables: dict[str, DataFrame], col: str, precision: int = 18, scale: int = 2) -> DataFrame:
    """A-26: exact DECIMAL sum of one column per side."""
    parts = [df.agg(F.sum(F.col(col).cast(f"decimal({precision},{scale})")).alias("total"))
             .select(F.lit(name).alias("side"), "total") for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
