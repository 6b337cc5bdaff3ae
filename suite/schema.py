"""Type queries: T-04 (categories of the driver tables' columns), T-05/T-06
(conversion of one schema group), T-07 (one partition read raw), T-12
(relational source types -> Spark types), X-03 (a caller's own target
schema and formats), Q-02 and Q-14 (schema checks between two sides)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from suite import register
from suite.drift import FORMATS, MAPPING, PART, variant, write_drifting_source
from suite.loading import scratch
from tidemark.operators import drift as dr
from tidemark.operators import quality as qa
from tidemark.operators.repair import union_by_name
from tidemark.sources import io
from tidemark.sources.tables import DRIVER_TABLES, read_table

_IN_TABLES = "table_name IN (" + ", ".join(f"'{t}'" for t in DRIVER_TABLES) + ")"


def _metadata(spark, d):
    return io.column_metadata({t: read_table(spark, d, t) for t in DRIVER_TABLES})


# Non-null values of every column: the metadata queries report them beside the types, from one pass over each table.
_VALUES_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name, CAST(non_null AS BIGINT) AS non_null FROM "
    f"(UNPIVOT (SELECT COUNT(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE non_null)" for t in DRIVER_TABLES)


def _values(spark, d):
    out = []
    for t in DRIVER_TABLES:
        df = read_table(spark, d, t)
        n = df.agg(*[F.count(c).alias(c) for c in df.columns])
        out.append(n.unpivot([], df.columns, "column_name", "non_null").withColumn("table_name", F.lit(t)))
    return union_by_name(out)


def _with_values(sql: str) -> str:
    return f"SELECT m.*, v.non_null FROM ({sql}) m JOIN ({_VALUES_SQL}) v USING (table_name, column_name)"


def _beside_values(spark, d, meta):
    return meta.join(_values(spark, d), ["table_name", "column_name"])


register("s07_column_metadata", _with_values(
    f"SELECT table_name, column_name, CAST(ordinal_position AS INT) AS ordinal_position FROM information_schema.columns "
    f"WHERE {_IN_TABLES}"))(
    lambda spark, d: _beside_values(spark, d, _metadata(spark, d).select("table_name", "column_name", "ordinal_position")))


@register("s08_table_work_list", " UNION ALL ".join(
    f"SELECT 'src_{t}' AS table_name, COUNT(*) AS rows FROM {t}" for t in ("customer", "orders")))
def s08(spark, d):
    """The work list from the catalog, each table then counted through the catalog."""
    for t in ("orders", "customer"):
        read_table(spark, d, t).createOrReplaceTempView(f"src_{t}")
    names = [r["table_name"] for r in io.table_work_list(spark).where(F.col("table_name").startswith("src_")).collect()]
    return union_by_name([io.read_catalog(spark, n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows")
                          for n in names])


register("t04_type_categories", _with_values(
         "SELECT table_name, column_name, CASE WHEN data_type = 'VARCHAR' THEN 'string' "
         "WHEN data_type = 'DATE' THEN 'date' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' "
         "WHEN data_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 'integer' "
         "WHEN data_type IN ('FLOAT', 'DOUBLE') OR data_type LIKE 'DECIMAL%' THEN 'decimal' "
         "WHEN data_type = 'BOOLEAN' THEN 'boolean' ELSE 'other' END AS category "
         f"FROM information_schema.columns WHERE {_IN_TABLES}"))(
    lambda spark, d: _beside_values(spark, d, _metadata(spark, d).select(
        "table_name", "column_name", dr.type_category_expr("data_type").alias("category"))))

# The relational type name a SQL-server-like source reports for
# each Spark type of the driver tables (the inverse direction of T-12).
SOURCE_NAMES = {"bigint": "BIGINT", "int": "INT", "smallint": "SMALLINT", "string": "NVARCHAR",
                "double": "FLOAT", "float": "REAL", "date": "DATE", "timestamp": "DATETIME2",
                "timestamp_ntz": "DATETIME2", "boolean": "BIT"}


@register("t12_source_types", _with_values(
          "SELECT table_name, column_name, CASE WHEN data_type = 'BIGINT' THEN 'BIGINT' "
          "WHEN data_type = 'INTEGER' THEN 'INT' WHEN data_type = 'VARCHAR' THEN 'NVARCHAR' "
          "WHEN data_type = 'DOUBLE' THEN 'FLOAT' WHEN data_type = 'FLOAT' THEN 'REAL' "
          "WHEN data_type = 'DATE' THEN 'DATE' WHEN data_type LIKE 'TIMESTAMP%' THEN 'DATETIME2' "
          "WHEN data_type = 'BOOLEAN' THEN 'BIT' WHEN data_type LIKE 'DECIMAL%' THEN 'DECIMAL' "
          "ELSE 'SQL_VARIANT' END AS source_type, "
          "CASE WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'int' "
          "WHEN data_type = 'DOUBLE' THEN 'double' WHEN data_type = 'FLOAT' THEN 'float' "
          "WHEN data_type = 'DATE' THEN 'date' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' "
          "WHEN data_type = 'BOOLEAN' THEN 'boolean' WHEN data_type LIKE 'DECIMAL%' THEN "
          "'decimal(' || numeric_precision || ',' || numeric_scale || ')' ELSE 'string' END AS spark_type "
          f"FROM information_schema.columns WHERE {_IN_TABLES}"))
def t12(spark, d):
    m = _metadata(spark, d)
    t = F.col("data_type")
    name = F.when(t.startswith("decimal"), F.lit("DECIMAL"))
    for k, v in SOURCE_NAMES.items():
        name = name.when(t == k, F.lit(v))
    dec = F.regexp_extract(t, r"^decimal\((\d+),(\d+)\)$", 1)
    src = m.select("table_name", "column_name", name.otherwise(F.lit("SQL_VARIANT")).alias("data_type"),
                   F.when(dec != "", dec.cast("int")).alias("numeric_precision"),
                   F.when(dec != "", F.regexp_extract(t, r"^decimal\((\d+),(\d+)\)$", 2).cast("int"))
                   .alias("numeric_scale"))
    return _beside_values(spark, d, dr.mapping_types_sql(src).select(
        "table_name", "column_name", F.col("data_type").alias("source_type"), "spark_type"))


def _group(spark, d, which):
    """Files of one schema variant of the drifting source."""
    base = write_drifting_source(spark, d)
    files = dr.list_partition_files(spark, base, PART).where(which(F.col(PART).cast("int"))).select("path")
    return dr.read_file_group(spark, base, [r[0] for r in files.collect()], PART)   # one path per file, as the file index


register("t05_convert_strings",
         "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS biz_date, CAST(o_totalprice AS DECIMAL(18,2)) "
         "AS amount, o_orderdate AS transaction_date, CAST(o_custkey AS VARCHAR) AS customer_id, "
         "CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS is_active, "
         "CAST(year(o_orderdate) AS VARCHAR) AS report_date FROM orders")(
    lambda spark, d: dr.standardize(variant(spark, d, "text"), MAPPING, FORMATS, flag_failures=False))

register("t06_apply_mapping",
         "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS biz_date, CAST(o_totalprice AS DECIMAL(18,2)) "
         "AS amount, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS transaction_date, "
         "CAST(o_custkey AS VARCHAR) AS customer_id, "
         "CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS is_active, o_orderpriority AS channel, "
         "CAST(year(o_orderdate) AS VARCHAR) AS report_date, "
         "CASE WHEN o_orderpriority = '5-LOW' THEN 'transaction_date' ELSE '' END AS cast_failed "
         "FROM orders")(
    lambda spark, d: dr.standardize(variant(spark, d, "mixed"),
                                    {**MAPPING, "not_in_data": T.LongType()}, FORMATS, flag_failures=True)
    .withColumn("cast_failed", F.array_join("_cast_failed", ",")).drop("_cast_failed"))

register("t07_read_partition",
         "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS biz_date, CAST(o_totalprice AS DECIMAL(10,0)) "
         "AS amount, o_orderdate AS transaction_date, CAST(o_custkey AS VARCHAR) AS customer_id, "
         "CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS is_active, '1997' AS report_date "
         "FROM orders WHERE year(o_orderdate) = 1997")(
    lambda spark, d: _group(spark, d, lambda y: y == 1997))

# A caller's own target schema and formats (X-03): everything as text but
# the date and the amount, the customer id widened to BIGINT.
X03_MAPPING = {"biz_date": T.DateType(), "amount": T.DoubleType(), "transaction_date": T.StringType(),
               "customer_id": T.LongType(), "is_active": T.StringType()}

register("x03_caller_schema",
         "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS biz_date, "
         "CASE WHEN year(o_orderdate) BETWEEN 1997 AND 1998 THEN CAST(CAST(o_totalprice AS DECIMAL(10,0)) AS DOUBLE) "
         "WHEN year(o_orderdate) >= 1999 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) "
         "ELSE o_totalprice END AS amount, "
         "CASE WHEN year(o_orderdate) >= 1999 AND o_orderpriority = '5-LOW' THEN strftime(o_orderdate, "
         "'%Y/%m/%d %H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS transaction_date, "
         "o_custkey AS customer_id, "
         "CASE WHEN year(o_orderdate) <= 1996 THEN CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'No' "
         "ELSE 'maybe' END WHEN year(o_orderdate) <= 1998 THEN CASE o_orderstatus WHEN 'F' THEN 'true' "
         "WHEN 'O' THEN 'false' END ELSE CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0' END END "
         "AS is_active, CASE WHEN year(o_orderdate) >= 1999 THEN o_orderpriority END AS channel, "
         "CAST(year(o_orderdate) AS VARCHAR) AS report_date FROM orders")(
    lambda spark, d: dr.load_aligned(spark, write_drifting_source(spark, d), PART, X03_MAPPING,
                                     {"biz_date": "yyyy-MM-dd"}))


_Q02_SQL = ("SELECT * FROM (VALUES ('l_quantity', 'double', 'decimal(18,2)', 'FAIL'), ('l_tax', 'double', NULL, 'MISSING'), "
            "('l_comment', NULL, 'string', 'EXTRA')) v(column_name, expected_type, actual_type, status)")


@register("q02_schema_check", "SELECT q.*, CASE WHEN q.status = 'MISSING' THEN CAST(0 AS BIGINT) ELSE n END AS values_checked "
          f"FROM ({_Q02_SQL}) q, (SELECT COUNT(l_quantity) AS n FROM lineitem)")
def q02(spark, d):
    """Expected: the lineitem table; actual: the table with one type changed, one column dropped and one added. The columns
    that differ, with the values that the actual table holds in them."""
    cur = read_table(spark, d, "lineitem")
    new = (cur.withColumn("l_quantity", F.col("l_quantity").cast("decimal(18,2)")).drop("l_tax")
           .withColumn("l_comment", F.lit("")))
    check = qa.schema_check(spark, cur.schema, new.schema).where(F.col("status") != "PASS")
    held = new.agg(*[F.count(c).alias(c) for c in new.columns]).unpivot([], new.columns, "column_name", "n")
    return (check.join(held, "column_name", "left")
            .select("column_name", "expected_type", "actual_type", "status", F.coalesce("n", F.lit(0).cast("long")).alias("values_checked")))


@register("q14_type_preservation", "SELECT * FROM (VALUES ('o_orderkey', 'bigint', 'int', false), "
          "('o_custkey', 'bigint', 'int', false), ('o_orderstatus', 'string', 'string', true), "
          "('o_totalprice', 'double', 'double', true), ('o_orderdate', 'timestamp_ntz', 'timestamp', false), "
          "('o_orderpriority', 'string', 'string', true)) v(column_name, source_type, target_type, preserved) "
          "WHERE EXISTS (SELECT 1 FROM orders)")
def q14(spark, d):
    """Source vs the persisted target of a load (CSV round trip loses types)."""
    src = read_table(spark, d, "orders")
    path = scratch(spark, "q14")
    io.export_csv(src, path)
    return qa.type_preservation(src, io.read_source(spark, path, "csv", {"inferSchema": "true"}))
