"""Schema drift across partitions and type alignment (S-05, T-01..T-12).

Stock Spark cannot read files that disagree on a column's type in one scan
(``CANNOT_MERGE_SCHEMAS``), so the load works per *schema group*: files with
identical schemas are read by one scan (with ``basePath`` so the partition
column is kept), each group is aligned to the target types with ``try_*``
expressions (ANSI mode raises on bad casts), and the groups are unioned by
name. A file whose footer cannot be read is listed and left out; the rest of
its partition loads.

Scale notes:
* File listing uses the ``binaryFile`` source with only ``path`` selected --
  file contents are never read.
* Footer schemas are read on the executors (``mapInPandas`` + pyarrow), one
  task per batch of files; a cluster with 10^5 partitions does not loop on
  the driver.
* The number of scans equals the number of distinct schemas, not the
  number of partitions. A scan is given folders, not files: the driver
  receives one row per (schema, folder), and file names only for folders
  that hold several schemas or a file that cannot be read.
* Schemas of files can be kept in a table (``store``), so that a run opens
  the footers of new or changed files only.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.repair import stride_sample, union_by_name
from tidemark.sources.files import open_filesystem, store_settings
from tidemark.sources.publish import plain_partitions

# Words read as booleans.
TRUE_WORDS = ["true", "1", "yes", "y", "t"]
FALSE_WORDS = ["false", "0", "no", "n", "f"]

DEFAULT_DATE_FORMAT = "yyyy-MM-dd"
DEFAULT_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


# --------------------------------------------------------------- discovery

def list_partition_files(spark: SparkSession, base: str, partition_col: str,
                         glob: str = "*.parquet") -> DataFrame:
    """(path, <partition_col>, partition_dir, length, modified) for every data
    file under ``base`` laid out as ``<partition_col>=<value>/``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(base)
             .select("path", "length", F.col("modificationTime").alias("modified")))
    pat = f"{re.escape(partition_col)}=([^/]+)"
    return files.select(
        "path", F.regexp_extract("path", pat, 1).alias(partition_col),
        F.regexp_extract("path", f"^(.*/{re.escape(partition_col)}=[^/]+)", 1).alias("partition_dir"),
        "length", "modified").where(F.col(partition_col) != "")


def partition_values(spark: SparkSession, base: str, partition_col: str) -> DataFrame:
    """S-05: sorted distinct partition values of a directory (values come from
    paths, so this works over drifting files)."""
    return (list_partition_files(spark, base, partition_col).select(partition_col)
            .distinct().orderBy(partition_col))


_SCHEMA_OUT = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("column_name", T.StringType()),
    T.StructField("data_type", T.StringType()), T.StructField("nullable", T.BooleanType()),
    T.StructField("error", T.StringType())])


def _read_footers(batches, settings):
    """Executor side: read each file's footer and emit one row per column."""
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_type

    for pdf in batches:
        rows = []
        for p in pdf["path"]:
            try:
                fs, local = open_filesystem(p, settings)
                with fs.open_input_file(local) as fh:
                    sch = pq.read_schema(fh)
                meta = sch.metadata or {}
                spark_json = meta.get(b"org.apache.spark.sql.parquet.row.metadata")
                if spark_json:
                    st = T.StructType.fromJson(json.loads(spark_json))
                    cols = [(f.name, f.dataType.simpleString(), f.nullable) for f in st.fields]
                else:
                    cols = [(f.name, from_arrow_type(
                        f.type, prefer_timestamp_ntz=pa.types.is_timestamp(f.type) and f.type.tz is None
                    ).simpleString(), f.nullable) for f in sch]
                rows += [(p, n, t, nl, None) for n, t, nl in cols]
            except Exception as e:  # unreadable file -> error record (D-18)
                rows.append((p, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["path", "column_name", "data_type", "nullable", "error"])


def file_schemas(spark: SparkSession, base: str, partition_col: str, sample_size: int | None = None,
                 only_partitions: DataFrame | None = None, store: str | None = None) -> DataFrame:
    """(partition, partition_dir, path, column_name, data_type, nullable, error) per file, from footers read on the executors.

    ``sample_size`` keeps every k-th partition (L-04; first and last always
    kept), ``only_partitions`` the named ones; footers of other partitions
    are not opened. ``store`` names a table of known files: only files that it
    lacks, by path, length and time of change, are opened, and added to it."""
    files = list_partition_files(spark, base, partition_col)
    if sample_size:
        files = files.join(stride_sample(files, partition_col, sample_size), partition_col, "left_semi")
    if only_partitions is not None:
        files = files.join(only_partitions.select(F.col(partition_col).cast("string").alias(partition_col)),
                           partition_col, "left_semi")
    settings = store_settings(spark)

    def footers(of: DataFrame) -> DataFrame:
        return of.select("path").mapInPandas(lambda batches: _read_footers(batches, settings), _SCHEMA_OUT)
    out = [partition_col, "partition_dir", "path", "column_name", "data_type", "nullable", "error"]
    if store is None:
        return footers(files).join(files, "path").select(*out)
    from tidemark.sources import io
    state = ["path", "length", "modified"]
    todo = files
    if io.path_exists(spark, store):
        todo = files.join(spark.read.parquet(store).select(*state).distinct(), state, "left_anti")
    with io.staged(footers(todo).join(files.select(*state), "path")) as fresh:
        if not fresh.isEmpty():
            io.append(fresh, store)
    return spark.read.parquet(store).join(files, state).select(*out)


def partition_schemas(spark: SparkSession, base: str, partition_col: str, sample_size: int | None = None) -> DataFrame:
    """T-01: (partition, column_name, data_type, nullable, error) per partition (a mixed partition has a row per type)."""
    return file_schemas(spark, base, partition_col, sample_size).drop("path").distinct()


def drift_map(schemas: DataFrame, partition_col: str) -> DataFrame:
    """T-02: column -> type -> partitions, in long form with counts:
    (column_name, data_type, partitions, first_partition, last_partition)."""
    ok = schemas.where(F.col("error").isNull())
    return (ok.groupBy("column_name", "data_type")
            .agg(F.countDistinct(partition_col).alias("partitions"),
                 F.min(partition_col).alias("first_partition"),
                 F.max(partition_col).alias("last_partition")))


def drift_report(schemas: DataFrame, partition_col: str, examples: int = 3) -> DataFrame:
    """T-03: columns seen with more than one type: per (column, type) the
    number of partitions and the first ``examples`` partitions (bounded list:
    a per-group top-k, never the whole partition list)."""
    ok = schemas.where(F.col("error").isNull()).select("column_name", "data_type", partition_col).distinct()
    multi = (ok.groupBy("column_name").agg(F.countDistinct("data_type").alias("type_count"))
             .where(F.col("type_count") > 1))
    from pyspark.sql import Window
    w = Window.partitionBy("column_name", "data_type").orderBy(partition_col)
    ex = (ok.join(multi, "column_name", "left_semi")
          .withColumn("__rn", F.row_number().over(w)))
    agg = ex.groupBy("column_name", "data_type").agg(
        F.count(F.lit(1)).alias("partitions"),
        F.sort_array(F.collect_list(F.when(F.col("__rn") <= examples, F.col(partition_col))))
        .alias("example_partitions"))
    return agg.join(multi, "column_name")


# ---------------------------------------------------------------- alignment

def type_category(dt: T.DataType) -> str:
    """T-04: string / date / timestamp / integer / decimal / boolean / other."""
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "decimal"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "other"


def type_category_expr(type_name) -> Column:
    """T-04 over type *names* (``simpleString`` form, e.g. column metadata)."""
    t = F.lower(F.trim(F.col(type_name) if isinstance(type_name, str) else type_name))
    return (F.when(t.rlike(r"^(string|varchar|char)"), "string")
            .when(t == "date", "date")
            .when(t.rlike(r"^timestamp"), "timestamp")
            .when(t.isin("tinyint", "smallint", "int", "bigint"), "integer")
            .when(t.isin("float", "double") | t.startswith("decimal"), "decimal")
            .when(t == "boolean", "boolean")
            .otherwise("other"))


def convert_expr(c: Column, current: T.DataType, target: T.DataType, fmt: str | None = None) -> Column:
    """T-05: expression converting ``c`` from ``current`` to ``target``.

    Identical types are left alone; any other pair is converted (D-7: int ->
    long, decimal(10,0) -> decimal(18,2) and float -> double are real
    conversions). Unparseable values become NULL instead of failing the job.
    """
    if current == target:
        return c
    src, dst = type_category(current), type_category(target)
    if dst == "date":
        if src == "string":
            return F.try_to_date(c, fmt or DEFAULT_DATE_FORMAT)
        if src == "timestamp":
            return c.cast(T.DateType())
        return F.try_to_date(c.cast("string"))
    if dst == "timestamp":
        if src == "string":
            out = F.try_to_timestamp(c, F.lit(fmt or DEFAULT_TS_FORMAT))
        elif src in ("date", "timestamp"):
            out = c
        else:
            out = F.try_to_timestamp(c.cast("string"))
        return out.cast(target)
    if dst == "boolean" and src == "string":
        w = F.lower(F.trim(c))
        return F.when(w.isin(TRUE_WORDS), F.lit(True)).when(w.isin(FALSE_WORDS), F.lit(False))
    return c.try_cast(target)


def standardize(df: DataFrame, mapping: dict[str, T.DataType], formats: dict[str, str] | None = None,
                flag_failures: bool = True) -> DataFrame:
    """T-06: align the mapped columns present in ``df`` (absent ones are
    ignored) in one projection. ``_cast_failed`` lists columns whose non-NULL
    input became NULL."""
    formats = formats or {}
    types = {f.name: f.dataType for f in df.schema.fields}
    out, failed = [], []
    for name in df.columns:
        if name in mapping:
            e = convert_expr(F.col(name), types[name], mapping[name], formats.get(name))
            if flag_failures and types[name] != mapping[name]:
                failed.append(F.when(F.col(name).isNotNull() & e.isNull(), F.lit(name)))
            out.append(e.alias(name))
        else:
            out.append(F.col(name))
    if flag_failures:
        arr = F.filter(F.array(*failed), lambda x: x.isNotNull()) if failed else \
            F.array().cast("array<string>")
        out.append(arr.alias("_cast_failed"))
    return df.select(*out)


def read_file_group(spark: SparkSession, base: str, files: list[str], partition_col: str) -> DataFrame:
    """T-07: one scan over files, or folders, that share a schema; the partition column comes back from the paths as a string,
    spelled as in the folder (``01`` stays ``01``)."""
    with plain_partitions(spark):
        df = spark.read.option("basePath", base).option("pathGlobFilter", "*.parquet").parquet(*files)
    return df.withColumn(partition_col, F.col(partition_col).cast("string"))


def schema_groups(schemas: DataFrame) -> list[list[str]]:
    """What to scan for each schema: folders where all files have it, and single files of mixed folders; files that cannot be
    read are left out. Signatures and groups are made on the executors; the driver receives a row per (signature, folder),
    with file names only where the folder is mixed."""
    per_file = (schemas.groupBy("path", "partition_dir")
                .agg(F.max(F.col("error").isNotNull()).alias("bad"),
                     F.sha2(F.concat_ws(",", F.sort_array(F.collect_set(
                         F.concat_ws(":", "column_name", "data_type")))), 256).alias("sig")))
    mixed = (per_file.groupBy("partition_dir").agg((F.max("bad") | (F.min("sig") != F.max("sig"))).alias("mixed")))
    held = (per_file.join(mixed, "partition_dir").where(~F.col("bad")).groupBy("sig", "partition_dir")
            .agg(F.collect_list(F.when(F.col("mixed"), F.col("path"))).alias("files")))
    groups: dict[str, list[str]] = {}
    for r in held.collect():
        groups.setdefault(r["sig"], []).extend(r["files"] or [r["partition_dir"]])
    return [sorted(v) for _, v in sorted(groups.items(), key=lambda kv: min(kv[1]))]


def failed_partitions(schemas: DataFrame, partition_col: str) -> DataFrame:
    """Partitions with files that could not be read, with the error text (D-18)."""
    return schemas.where(F.col("error").isNotNull()).select(partition_col, "error").distinct()


def load_aligned(spark: SparkSession, base: str, partition_col: str, mapping: dict[str, T.DataType],
                 formats: dict[str, str] | None = None, only_partitions: DataFrame | None = None,
                 flag_failures: bool = False, schemas: DataFrame | None = None, store: str | None = None) -> DataFrame:
    """T-08: align and union all files -- one scan per distinct schema.
    ``schemas`` (:func:`file_schemas` output) may be passed when the caller
    already has it; ``store`` keeps the schemas of known files."""
    if schemas is None:
        schemas = file_schemas(spark, base, partition_col, only_partitions=only_partitions, store=store)
    groups = schema_groups(schemas)
    if not groups:
        raise ValueError(f"no readable partitions under {base}")
    parts = [standardize(read_file_group(spark, base, g, partition_col), mapping, formats, flag_failures)
             for g in groups]
    return union_by_name(parts)


def validate_target(df: DataFrame, mapping: dict[str, T.DataType]) -> DataFrame:
    """T-09: PASS / FAIL / MISSING per mapped column with expected and actual
    types (full type compare, D-7)."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for name, want in mapping.items():
        got = actual.get(name)
        status = "MISSING" if got is None else ("PASS" if got == want else "FAIL")
        rows.append((name, want.simpleString(), got.simpleString() if got else None, status))
    schema = "column_name string, expected_type string, actual_type string, status string"
    return df.sparkSession.createDataFrame(rows, schema)


# ------------------------------------------------------------ source types

_SIMPLE = {
    # Relational source type -> Spark type.
    "bit": T.BooleanType(), "tinyint": T.IntegerType(), "smallint": T.IntegerType(),
    "int": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(),
    "float": T.DoubleType(), "real": T.FloatType(), "money": T.DecimalType(19, 4),
    "smallmoney": T.DecimalType(19, 4), "date": T.DateType(), "datetime": T.TimestampType(),
    "datetime2": T.TimestampType(), "smalldatetime": T.TimestampType(), "time": T.StringType(),
    "varchar": T.StringType(), "nvarchar": T.StringType(), "char": T.StringType(),
    "nchar": T.StringType(), "text": T.StringType(), "ntext": T.StringType(),
    "binary": T.BinaryType(), "varbinary": T.BinaryType(), "image": T.BinaryType(),
    "uniqueidentifier": T.StringType(),
}


def source_type_to_spark(type_name: str, precision: int | None = None, scale: int | None = None) -> T.DataType:
    """T-12: relational source column type -> Spark type. DECIMAL/NUMERIC keep
    precision and scale (default 18,0); unknown names map to string."""
    t = type_name.strip().lower()
    m = re.match(r"^(decimal|numeric)\s*(?:\((\d+)\s*(?:,\s*(\d+))?\))?$", t)
    if m:
        p = int(m.group(2) or precision or 18)
        s = int(m.group(3) or scale or 0)
        return T.DecimalType(p, s)
    base = re.sub(r"\s*\(.*\)$", "", t)
    return _SIMPLE.get(base, T.StringType())


def schema_from_columns(columns: list[dict]) -> T.StructType:
    """T-12 over column metadata rows (name, type, precision, scale, nullable)."""
    return T.StructType([
        T.StructField(c["name"], source_type_to_spark(c["type"], c.get("precision"), c.get("scale")),
                      bool(c.get("nullable", True))) for c in columns])


def mapping_types_sql(columns: DataFrame) -> DataFrame:
    """T-12 as a DataFrame transform over metadata rows with ``data_type``,
    ``numeric_precision``, ``numeric_scale``: adds ``spark_type``."""
    t = F.lower(F.trim("data_type"))
    p = F.coalesce(F.col("numeric_precision").cast("int"), F.lit(18)).cast("string")
    s = F.coalesce(F.col("numeric_scale").cast("int"), F.lit(0)).cast("string")
    expr = F.when(t.isin("decimal", "numeric"), F.concat(F.lit("decimal("), p, F.lit(","), s, F.lit(")")))
    for k, v in _SIMPLE.items():
        expr = expr.when(t == k, F.lit(v.simpleString()))
    return columns.withColumn("spark_type", expr.otherwise(F.lit("string")))


def load_summary(spark: SparkSession, partitions_ok: int, partitions_failed: int, rows: int,
                 drifted_columns: list[str]) -> DataFrame:
    """A-28: one-row load summary with an explicit schema."""
    schema = ("partitions_ok long, partitions_failed long, total_rows long, "
              "drifted_columns array<string>")
    return spark.createDataFrame([(partitions_ok, partitions_failed, rows, drifted_columns)], schema)
