"""Drift alignment and name mapping on hand-made drifting partitions."""

import datetime as dt
import decimal
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import drift as dr
from tidemark.operators import names as nm
from tidemark.plans import bronze

MAPPING = {"biz_date": T.DateType(), "amount": T.DecimalType(18, 2), "customer_id": T.StringType(),
           "is_active": T.BooleanType()}


def _write_drifting(spark, base):
    spark.createDataFrame([("2024-01-05", 1.25, 7, " YES "), ("bad-date", 2.5, 8, "n")],
                          "biz_date string, amount double, customer_id bigint, is_active string") \
        .write.parquet(os.path.join(base, "report_date=2024-01-01"))
    spark.createDataFrame([(dt.date(2024, 2, 1), decimal.Decimal("10"), "c9", True)],
                          "biz_date date, amount decimal(10,0), customer_id string, is_active boolean") \
        .write.parquet(os.path.join(base, "report_date=2024-02-01"))
    spark.createDataFrame([(dt.datetime(2024, 3, 1, 5), decimal.Decimal("3.14"), 5, 1, "web")],
                          "biz_date timestamp_ntz, amount decimal(18,2), customer_id int, is_active int, "
                          "channel string") \
        .write.parquet(os.path.join(base, "report_date=2024-03-01"))
    # an emptied partition directory must not break discovery
    os.makedirs(os.path.join(base, "report_date=2024-04-01"), exist_ok=True)


def test_drift_detection_and_alignment(spark, tmp_dir):
    base = os.path.join(tmp_dir, "src")
    _write_drifting(spark, base)
    parts = [r.report_date for r in dr.partition_values(spark, base, "report_date").collect()]
    assert parts == ["2024-01-01", "2024-02-01", "2024-03-01"]
    schemas = dr.partition_schemas(spark, base, "report_date")
    report = {(r.column_name, r.data_type) for r in dr.drift_report(schemas, "report_date").collect()}
    assert ("amount", "decimal(10,0)") in report and ("amount", "double") in report
    assert ("channel", "string") not in report   # one type only -> no drift
    out = dr.load_aligned(spark, base, "report_date", MAPPING, {"biz_date": "yyyy-MM-dd"}, flag_failures=True)
    assert {f.name: f.dataType for f in out.schema.fields}["amount"] == T.DecimalType(18, 2)
    rows = {(r.report_date, r.customer_id): r for r in out.collect()}
    r1 = rows[("2024-01-01", "7")]
    assert r1.biz_date == dt.date(2024, 1, 5) and r1.amount == decimal.Decimal("1.25") and r1.is_active is True
    r2 = rows[("2024-01-01", "8")]
    assert r2.biz_date is None and "biz_date" in r2._cast_failed and r2.is_active is False
    r3 = rows[("2024-03-01", "5")]
    assert r3.biz_date == dt.date(2024, 3, 1) and r3.is_active is True and r3.channel == "web"
    assert rows[("2024-02-01", "c9")].channel is None
    v = {r.column_name: r.status for r in dr.validate_target(out, MAPPING).collect()}
    assert set(v.values()) == {"PASS"}


def test_same_category_still_converts(spark):
    # D-7: int -> bigint and decimal(10,0) -> decimal(18,2) are real conversions
    e = dr.convert_expr(F.col("x"), T.IntegerType(), T.LongType())
    df = spark.createDataFrame([(1,)], "x int").select(e.alias("x"))
    assert df.schema["x"].dataType == T.LongType()


def test_full_and_incremental_load(spark, tmp_dir):
    base = os.path.join(tmp_dir, "src2")
    _write_drifting(spark, base)
    tgt = os.path.join(tmp_dir, "bronze")
    out = bronze.full_load(spark, base, "report_date", MAPPING, tgt, dt.datetime(2024, 5, 1))
    s = out["summary"].collect()[0]
    assert (s.partitions_ok, s.partitions_failed, s.total_rows) == (3, 0, 4)
    assert "amount" in s.drifted_columns
    # incremental: nothing new -> empty; then a new partition arrives
    assert bronze.incremental_load(spark, base, "report_date", MAPPING, tgt, dt.datetime(2024, 5, 2)).count() == 0
    spark.createDataFrame([("2024-05-01", 9.99, 1, "t")], "biz_date string, amount double, customer_id bigint, "
                          "is_active string").write.parquet(os.path.join(base, "report_date=2024-05-01"))
    added = bronze.incremental_load(spark, base, "report_date", MAPPING, tgt, dt.datetime(2024, 5, 2)).collect()
    assert [(r.report_date, r.record_count) for r in added] == [("2024-05-01", 1)]


def test_safe_names_documented_examples():
    # The documented mapping examples
    expected = {"Nhóm_B": "Nhom_B", "B_T-1": "B_T_1", "Ngày_Tạo": "Ngay_Tao", "Địa_Chỉ": "Dia_Chi",
                "Customer-ID": "Customer_ID", "Normal_Column": "Normal_Column"}
    fwd, rev = nm.name_mapping(list(expected))
    assert fwd == expected
    assert nm.safe_name("1st col") == "_1st_col"
    assert nm.safe_name("***").startswith("col_") and nm.safe_name("***") == nm.safe_name("***")


def test_name_collisions_and_round_trip(spark):
    cols = ["a-b", "a_b", "A b", "x"]
    fwd, rev = nm.name_mapping(cols)
    assert fwd == {"a-b": "a_b", "a_b": "a_b_1", "A b": "A_b_2", "x": "x"}
    df = spark.createDataFrame([(1, 2, 3, 4)], [f"`{c}`" if False else c for c in cols])
    back = nm.rename_back(nm.rename_forward(df, fwd), rev)
    assert back.columns == cols and back.collect() == df.collect()
    sel = nm.mapped_select(df, fwd)
    assert sel.columns == ["a_b", "a_b_1", "A_b_2", "x"]


def test_registry_create_if_absent(spark):
    r1 = nm.mapping_frame(spark, "db", "dbo", "t", ["Nhóm_B", "id"], "2024-01-01")
    r2 = nm.mapping_frame(spark, "db", "dbo", "t", ["Nhóm_B", "new col"], "2024-02-01")
    reg = nm.register_mappings(nm.register_mappings(None, r1), r2)
    got = {r.original_column_name: (r.avro_compatible_name, str(r.created_date)) for r in reg.collect()}
    assert got == {"Nhóm_B": ("Nhom_B", "2024-01-01"), "id": ("id", "2024-01-01"),
                   "new col": ("new_col", "2024-02-01")}
    summ = nm.mapping_summary(reg).collect()[0]
    assert (summ.column_count, summ.transformed_count) == (3, 2)


def test_type_mapping_and_ddl():
    assert dr.source_type_to_spark("DECIMAL(19,4)") == T.DecimalType(19, 4)
    assert dr.source_type_to_spark("money") == T.DecimalType(19, 4)
    assert dr.source_type_to_spark("NVARCHAR") == T.StringType()
    assert dr.source_type_to_spark("bit") == T.BooleanType()
    ddl = nm.create_table_ddl("t", [{"name": "Địa_Chỉ", "type": "nvarchar", "length": -1, "nullable": True},
                                    {"name": "id", "type": "int", "nullable": False}],
                              {"Địa_Chỉ": "Dia_Chi", "id": "id"})
    assert "`Dia_Chi` STRING COMMENT 'source type nvarchar'" in ddl and "`id` INT NOT NULL" in ddl


def test_scans_are_given_folders_and_known_files_are_not_reopened(spark, tmp_path):
    from pyspark.sql import functions as F
    base, store = f"{tmp_path}/src", f"{tmp_path}/store"

    def put(part, rows, schema, mode="append"):
        spark.createDataFrame(rows, schema).withColumn("p", F.lit(part)).repartition(3).write.mode(mode).partitionBy("p").parquet(base)
    for part in ("01", "02", "03"):
        put(part, [(i, i) for i in range(9)], "id int, v int")
    put("03", [(i, str(i)) for i in range(9)], "id int, v string")
    put("04", [(i, str(i)) for i in range(9)], "id int, v string")
    (tmp_path / "src/p=01/bad.parquet").write_text("no parquet")
    schemas = dr.file_schemas(spark, base, "p", store=store)
    groups = dr.schema_groups(schemas)
    folders = sorted(x.rsplit("/", 1)[1] for g in groups for x in g if not x.endswith(".parquet"))
    files = [x for g in groups for x in g if x.endswith(".parquet")]
    assert folders == ["p=02", "p=04"] and len(groups) == 2 and {f.split("/")[-2] for f in files} == {"p=01", "p=03"}
    got = dr.load_aligned(spark, base, "p", {"v": T.LongType()}, store=store)
    assert got.count() == 45 and got.where("v is null").count() == 0
    known = spark.read.parquet(store)
    before = known.select("path").distinct().count()
    put("05", [(1, 1)], "id int, v int")
    again = dr.file_schemas(spark, base, "p", store=store)
    assert again.select("path").distinct().count() == before + 1
    rows = spark.read.parquet(store).groupBy("path", "column_name").count().where("count > 1")
    assert rows.count() == 0  # no file was read a second time
