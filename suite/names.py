"""Name-mapping queries: N-01..N-03, N-05..N-07 and S-20 over ``customer``
re-exposed under column names that restricted formats reject, and N-01 on
name data (``pages.url``)."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from suite import register
from suite.loading import scratch
from tidemark.operators import names as nm
from tidemark.sources.tables import read_table

# The odd source names of the fixture, in column order. Two of
# them collide after the rule ("Customer-ID", "Customer ID").
ODD = [("c_custkey", "Customer-ID"), ("c_nationkey", "Customer ID"), ("c_name", "Địa_Chỉ"),
       ("c_mktsegment", "Nhóm_B"), ("c_acctbal", "B_T-1"), ("c_phone_like", "2024 Sales"), ("c_tag", "???")]
# Safe names the rule gives (N-01 with the accent fold, N-02 collision suffix).
SAFE = ["Customer_ID", "Customer_ID_1", "Dia_Chi", "Nhom_B", "B_T_1", "_2024_Sales",
        f"col_{zlib.crc32('???'.encode('utf-8')) % 10000}"]


def odd_customer(spark, d):
    c = read_table(spark, d, "customer")
    src = {"c_phone_like": F.col("c_acctbal") * 2, "c_tag": F.col("c_custkey") % 7}
    return c.select(*[(src[s] if s in src else F.col(s)).alias(o) for s, o in ODD])


def _odd_sql(names):
    exprs = {"c_phone_like": "c_acctbal * 2", "c_tag": "c_custkey % 7"}
    return "SELECT " + ", ".join(f'{exprs.get(s, s)} AS "{n}"' for (s, _), n in zip(ODD, names)) + " FROM customer"


register("n01_safe_name_data",
         "WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g'), "
         "'_+', '_', 'g'), '^_+|_+$', '', 'g') AS v FROM pages) "
         "SELECT page_id, CASE WHEN regexp_matches(v, '^[0-9]') THEN '_' || v ELSE v END AS safe_url FROM s")(
    lambda spark, d: read_table(spark, d, "pages").select("page_id", nm.safe_name_expr("url").alias("safe_url")))


@register("n03_rename_forward", _odd_sql(SAFE))
def n03(spark, d):
    df = odd_customer(spark, d)
    forward, _ = nm.name_mapping(df.columns)
    return nm.rename_forward(df, forward)


@register("n07_original_view", _odd_sql([o for _, o in ODD]))
def n07(spark, d):
    """N-05 mapped projection into an N-06 table, read through the N-07 view."""
    df = odd_customer(spark, d)
    forward, reverse = nm.name_mapping(df.columns)
    meta = [{"name": f.name, "type": {"bigint": "BIGINT", "int": "INT", "double": "FLOAT"}
             .get(f.dataType.simpleString(), "NVARCHAR"), "length": 25 if f.dataType.simpleString() == "string"
             else None, "nullable": True} for f in df.schema.fields]
    table = f"customer_safe_{spark.sparkContext.applicationId.replace('-', '_')}"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(nm.create_table_ddl(table, meta, forward) + f" LOCATION '{scratch(spark, 'n07')}'")
    nm.mapped_select(df, forward).write.insertInto(table)
    spark.sql(nm.view_sql(f"vw_{table}", table, forward))
    return spark.table(f"vw_{table}")


@register("s20_restricted_interchange", _odd_sql([o for _, o in ODD]))
def s20(spark, d):
    """Write safe names plus the mapping next to the data; a reader restores
    the original names from the stored mapping alone."""
    base = scratch(spark, "s20")
    df = odd_customer(spark, d)
    forward, _ = nm.name_mapping(df.columns)
    nm.rename_forward(df, forward).write.orc(f"{base}/data")
    nm.mapping_frame(spark, "warehouse", "main", "customer", df.columns, "2024-02-01") \
        .coalesce(1).write.parquet(f"{base}/_mapping")
    stored = {r["avro_compatible_name"]: r["original_column_name"]
              for r in spark.read.parquet(f"{base}/_mapping").collect()}
    return nm.rename_back(spark.read.orc(f"{base}/data"), stored)
