"""Sources and sinks (S-02 .. S-25).

Writes go to Parquet paths or catalog tables. Stock Spark has no MERGE /
UPDATE / DELETE for file tables, so a mutation is computed as a DataFrame
(``tidemark.operators.merge``) over the whole partitions it touches, written
once beside the table and moved in place folder by folder
(``tidemark.sources.publish``).
"""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import checkpoint_dir
from tidemark.sources.publish import (FOLDER, append_once, as_spelled, delete_path, leaf_folders, path_exists, publish,
                                      read_folders, read_merged, read_spelled, recover, same_values, staging, swap,
                                      touched_folders, with_folder)

SUPPORTED_FORMATS = ("parquet", "csv", "json", "orc", "text", "avro", "delta")

# Parquet writer defaults (row group 128 MB, page 1 MB).
PARQUET_BLOCK_SIZE = 128 * 1024 * 1024
PARQUET_PAGE_SIZE = 1024 * 1024

#: Memory of the rows that one task of a compaction sorts.
SORTED_BYTES = 256 * 1024 * 1024


# ------------------------------------------------------------------ reading

def read_source(spark: SparkSession, path: str, fmt: str, options: dict | None = None,
                schema: T.StructType | str | None = None) -> DataFrame:
    """S-02: read a file source by format; an unknown format is an error.

    CSV defaults to ``header=true`` (all columns strings unless a schema is
    given); ``avro``/``delta`` need their packages on the classpath.
    """
    fmt = fmt.lower()
    if fmt not in SUPPORTED_FORMATS:
        raise ValueError(f"unsupported file format: {fmt}")
    opts = dict(options or {})
    if fmt == "csv":
        opts.setdefault("header", "true")
    r = spark.read.format(fmt).options(**opts)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def read_jsonl_results(spark: SparkSession, path: str, schema: T.StructType,
                       corrupt_col: str = "_corrupt_record") -> DataFrame:
    """S-04: JSON-lines results with a fixed schema; malformed lines are kept
    whole in ``corrupt_col`` (PERMISSIVE)."""
    full = T.StructType(list(schema.fields) + [T.StructField(corrupt_col, T.StringType())])
    return (spark.read.schema(full).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", corrupt_col).json(path))


def _day_folders(spark: SparkSession, base: str, start: dt.date, end: dt.date) -> list[str]:
    """Folders of the ``year=/month=/day=`` layout under ``base`` for the days from ``start`` to ``end``, zero-padded or not."""
    out = []
    for folder in leaf_folders(spark, base, 3):
        parts = dict(p.split("=", 1) for p in folder.split("/"))
        try:
            day = dt.date(int(parts["year"]), int(parts["month"]), int(parts["day"]))
        except (KeyError, ValueError):
            continue
        if start <= day <= end:
            out.append(folder)
    return out


def read_day(spark: SparkSession, base: str, day: dt.date, fmt: str = "parquet") -> DataFrame | None:
    """S-06: one day of a ``year=/month=/day=`` layout, read from the day's own folder with the columns of all its files (a
    column that is new that day included). A missing or empty day returns ``None`` (skipped, not an error)."""
    return read_days(spark, base, day, day, fmt)


def read_days(spark: SparkSession, base: str, start: dt.date, end: dt.date, fmt: str = "parquet") -> DataFrame | None:
    """I-02: an inclusive day range in one scan of the days' folders, with the columns of all their files; ``None`` if there
    is no row."""
    folders = _day_folders(spark, base, start, end)
    if not folders:
        return None
    root = base.rstrip("/")
    df = (spark.read.format(fmt).option("basePath", root).option("mergeSchema", "true")
          .load([f"{root}/{f}" for f in folders]))
    return None if df.isEmpty() else df


def column_metadata(tables: dict[str, DataFrame]) -> DataFrame:
    """S-07: column metadata as data (table_name, column_name, data_type,
    nullable, ordinal_position), from the DataFrames' schemas."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable, i)
            for t, df in tables.items() for i, f in enumerate(df.schema.fields, start=1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, "
                                       "nullable boolean, ordinal_position int")


def read_catalog(spark: SparkSession, table: str | None = None, query: str | None = None,
                 args: dict | None = None) -> DataFrame:
    """S-03: a catalog table (``spark.table``) or a query over the catalog;
    values are bound as named parameters, never pasted into the text."""
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table or query")
    return spark.table(table) if table is not None else spark.sql(query, args=args or {})


def table_work_list(spark: SparkSession, database: str | None = None) -> DataFrame:
    """S-08: catalog tables as a work list (name, database, type, temporary)."""
    rows = [(t.name, t.database, t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "table_name string, database string, table_type string, "
                                       "is_temporary boolean")


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
              partition_column: str | None = None, lower_bound=None, upper_bound=None,
              num_partitions: int | None = None, properties: dict | None = None) -> DataFrame:
    """S-09: relational extract, whole table or a query, read in parallel
    slices of ``partition_column`` when given."""
    r = spark.read.format("jdbc").option("url", url)
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table or query")
    if table is not None:
        r = r.option("dbtable", table)
    else:
        if partition_column:
            r = r.option("dbtable", f"({query}) q")
        else:
            r = r.option("query", query)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", str(lower_bound))
             .option("upperBound", str(upper_bound)).option("numPartitions", str(num_partitions or 8)))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r.load()


# ------------------------------------------------------------------ writing

def parquet_options(compression: str = "snappy", block_size: int = PARQUET_BLOCK_SIZE,
                    page_size: int = PARQUET_PAGE_SIZE, dictionary: bool = True) -> dict:
    """S-22: Parquet writer settings as writer options."""
    return {"compression": compression, "parquet.block.size": str(block_size),
            "parquet.page.size": str(page_size), "parquet.enable.dictionary": str(dictionary).lower()}


def append(df: DataFrame, path: str, partition_by: list[str] | None = None,
           options: dict | None = None) -> int:
    """S-10: append; readers use ``mergeSchema`` so new columns show up (old
    rows read them as NULL). Returns the rows written, observed during the
    write itself (no second pass over the source)."""
    obs = Observation()
    if partition_by and path_exists(df.sparkSession, path):
        df = as_spelled(df.sparkSession, path, df, partition_by)
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("append").options(**(options or {}))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return int(obs.get["rows"])


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None,
              options: dict | None = None) -> None:
    """S-11: full overwrite (static mode: the whole path is replaced, the
    schema may change)."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "static").options(**(options or {}))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str],
                         options: dict | None = None) -> None:
    """S-13: replace only the partitions present in ``df``, whichever way their folders are spelled."""
    (as_spelled(df.sparkSession, path, df, partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**(options or {}))
     .partitionBy(*partition_by).parquet(path))


def stage(df: DataFrame, name: str | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The written copy cuts lineage (a lost executor re-reads files instead of
    recomputing the mutation) and lets a target be overwritten from data
    that no longer depends on it. It lives as long as its reader needs it;
    :func:`staged` removes it at the end of a block."""
    return _staged_copy(df, name)[0]


def _staged_copy(df: DataFrame, name: str | None = None) -> tuple[DataFrame, str, int]:
    """The copy, its path and its rows, counted while it is written."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "staging", name or f"stage-{uuid.uuid4().hex}")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path, int(seen.get["rows"])


@contextlib.contextmanager
def staged_and_counted(df: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """:func:`stage` for the length of a ``with`` block, and the rows it has; the copy is removed when the block ends, also on
    an error."""
    copy, path, rows = _staged_copy(df)
    try:
        yield copy, rows
    finally:
        delete_path(df.sparkSession, path)


@contextlib.contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """:func:`staged_and_counted` without the count."""
    with staged_and_counted(df) as (copy, _):
        yield copy


def replace_where(target: DataFrame, new: DataFrame, pred: Column) -> DataFrame:
    """S-12 as a pure operator: rows of ``target`` outside ``pred`` plus all
    of ``new``. A row of ``new`` outside ``pred`` raises at execution, as a
    ``replaceWhere`` write does."""
    inside = F.coalesce(pred, F.lit(False))
    checked = new.where(F.when(~inside, F.raise_error(F.lit("new data outside the replace predicate")))
                        .otherwise(F.lit(True)).cast("boolean"))
    return target.where(~inside).unionByName(checked)


def _check_columns(target: DataFrame, source: DataFrame) -> None:
    """A source must bring every column of the target, as for MERGE; columns the target lacks are added to it."""
    missing = [c for c in target.columns if c not in source.columns]
    if missing:
        raise ValueError(f"source lacks the target's columns: {', '.join(missing)}")


def _affected(spark: SparkSession, path: str, target: DataFrame, folders: list[str], partition_by: list[str]) -> DataFrame:
    """The rows of whole partitions, under the table's full schema, with their folders' spelling of the partition values."""
    if not folders:
        return target.limit(0)
    return read_spelled(spark, path, folders, partition_by, target.schema)


def write_replace_where(spark: SparkSession, path: str, new: DataFrame, pred: Column,
                        partition_by: list[str]) -> int:
    """S-12 persisted: replace the rows matching ``pred`` in the partitioned
    Parquet table at ``path`` with ``new``. The partitions that ``pred`` or
    ``new`` touches are rewritten whole: their other rows stay, whatever
    their folders are called (NULL and zero-padded values included), and
    partitions left empty are deleted. New columns of ``new`` are added.
    Returns the rows of the rewritten partitions."""
    recover(spark, path)
    target = read_merged(spark, path)
    _check_columns(target, new)
    rows = with_folder(target)
    parts = new.select(*partition_by).distinct()
    hit = (rows.where(F.coalesce(pred, F.lit(False))).select(FOLDER)
           .union(rows.join(parts, same_values(rows, parts, partition_by), "left_semi").select(FOLDER)))
    folders = touched_folders(spark, path, hit)
    inside = F.coalesce(pred, F.lit(False))
    kept = _affected(spark, path, target, folders, partition_by).where(~inside)
    checked = new.where(F.when(~inside, F.raise_error(F.lit("new data outside the replace predicate")))
                        .otherwise(F.lit(True)).cast("boolean"))
    return publish(spark, path, kept.unionByName(checked, allowMissingColumns=True), partition_by, folders)


def write_upsert(spark: SparkSession, path: str, source: DataFrame, keys: list[str],
                 partition_by: list[str], within_source_partitions: bool = False,
                 version: list[str] | None = None) -> int:
    """J-02 persisted (copy-on-write MERGE): the partitions that hold a
    matching key or receive a source row are rewritten whole, in one write;
    a partition whose last row moved away is deleted. The touched partitions
    are found by a semi-join on the key columns alone (column pruning keeps
    that shuffle narrow). Returns the rows of the rewritten partitions. A
    missing target is created from the source; a source column that the
    target lacks is added, a missing one is an error.

    ``within_source_partitions``: the caller guarantees that a key never
    lives outside the partition its source row names (e.g. an event stays
    on its day). Then the key scan of the whole target is skipped: only the
    source's partitions are looked up (partition columns and file names, no
    data columns).

    ``version``: columns that order the states of a key (the day of its
    partition, a modification time). A source row whose version is older than
    the target's row is left out, so deliveries may come in any order: what
    decides is the target, not the order of the calls."""
    from tidemark.operators.merge import assert_unique_keys, not_older, upsert
    recover(spark, path)
    if not path_exists(spark, path):
        return publish(spark, path, assert_unique_keys(source, keys, "upsert source"), partition_by, [])
    target = read_merged(spark, path)
    _check_columns(target, source)
    if version:
        unique = assert_unique_keys(source, keys, "upsert source")
        with staged(not_older(unique, target, keys, version)) as current:
            return write_upsert(spark, path, current, keys, partition_by, within_source_partitions)
    rows = with_folder(target)
    parts = source.select(*partition_by).distinct()
    hit = rows.join(parts, same_values(rows, parts, partition_by), "left_semi").select(FOLDER)
    if not within_source_partitions:
        hit = hit.union(rows.join(source.select(*keys), keys, "left_semi").select(FOLDER))
    folders = touched_folders(spark, path, hit)
    # the keys are checked here alone, in the plan that writes: a repeated key fails it before anything of the table changes
    result = upsert(_affected(spark, path, target, folders, partition_by), source, keys)
    return publish(spark, path, result, partition_by, folders)


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """S-14: CSV with header, as parallel part files, or through one task as
    one file if the caller asks for that (a choice of the caller, who knows
    that the result is small)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", "true").csv(path)


def create_backup(spark: SparkSession, source: DataFrame, pred: Column, base_path: str,
                  suffix: str | None = None) -> tuple[str, int]:
    """S-15: copy the rows matching ``pred`` to ``<base_path>_backup_<suffix>``
    (suffix default ``%Y%m%d_%H%M%S``); returns (path, rows, counted while
    they are written). A backup is never overwritten: an existing path is an
    error."""
    suffix = suffix or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d_%H%M%S")
    bpath = f"{base_path.rstrip('/')}_backup_{suffix}"
    if path_exists(spark, bpath):
        raise FileExistsError(f"there is a backup at {bpath} already")
    seen = Observation()
    (source.where(F.coalesce(pred, F.lit(False))).observe(seen, F.count(F.lit(1)).alias("rows"))
     .write.mode("errorifexists").parquet(bpath))
    return bpath, int(seen.get["rows"])


def restore_backup(spark: SparkSession, path: str, backup_path: str, pred: Column,
                   partition_by: list[str]) -> int:
    """S-24: put the backed-up slice back (replace-where with the backup)."""
    backup = read_merged(spark, backup_path)
    return write_replace_where(spark, path, backup, pred, partition_by)


def create_table_sql(name: str, schema: T.StructType, partition_by: list[str] | None = None,
                     location: str | None = None, properties: dict | None = None,
                     comments: dict | None = None) -> str:
    """S-16: ``CREATE TABLE IF NOT EXISTS ... USING parquet`` from a schema."""
    cols = []
    for f in schema.fields:
        c = f"`{f.name}` {f.dataType.simpleString().upper()}"
        if not f.nullable:
            c += " NOT NULL"
        if comments and f.name in comments:
            c += " COMMENT '" + comments[f.name].replace("'", "\\'") + "'"
        cols.append(c)
    sql = f"CREATE TABLE IF NOT EXISTS {name} (\n  " + ",\n  ".join(cols) + "\n) USING parquet"
    if partition_by:
        sql += " PARTITIONED BY (" + ", ".join(f"`{p}`" for p in partition_by) + ")"
    if location:
        sql += f" LOCATION '{location}'"
    if properties:
        sql += " TBLPROPERTIES (" + ", ".join(f"'{k}' = '{v}'" for k, v in properties.items()) + ")"
    return sql


def create_table(spark: SparkSession, name: str, schema: T.StructType, **kw) -> None:
    """S-16: create only if absent (first run)."""
    spark.sql(create_table_sql(name, schema, **kw))


def export_table(df: DataFrame, path: str, if_exists: str = "fail", fmt: str = "parquet",
                 max_records_per_file: int | None = None) -> None:
    """S-17: distributed export with ``replace`` / ``append`` / ``fail``;
    row chunks become ``maxRecordsPerFile``."""
    mode = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}[if_exists]
    w = df.write.mode(mode).format(fmt)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", str(max_records_per_file))
    w.save(path)


def write_shards_jsonl(sharded: DataFrame, base: str, yearmonth: str, value_col: str = "request",
                       shard_col: str = "shard") -> int:
    """S-18: request shards as JSON lines, ``<base>/<yearmonth>/shard_<name>.jsonl``, one file per shard: the files M-06 lists.

    ``repartition`` by shard puts each shard's (bounded) records in one task,
    which writes the file under its own name and reports it; a repeated task
    writes the same file again. The reports become the manifest of the files
    written (:func:`written_shards`), and month and manifest are swapped in
    with one move each, however many shards there are: until then the month's
    earlier shards stay readable, and a storage error loses neither.
    Returns the number of files."""
    from tidemark.sources.files import open_filesystem, store_settings
    spark = sharded.sparkSession
    root = base.rstrip("/")
    settings = store_settings(spark)
    recover(spark, root)
    with staging(spark, root) as stage:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{stage}/month")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        where = fs.makeQualified(folder).toString()

        def put(batches):
            import pyarrow as pa
            from pyspark import TaskContext
            store, at = open_filesystem(where, settings)
            attempt = TaskContext.get().taskAttemptId()
            shard, records, size, out = None, 0, 0, None

            def close():
                out.close()
                name = f"shard_{shard}.jsonl"
                store.move(f"{at}/.{attempt}-{shard}", f"{at}/{name}")
                return pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "records": [records], "bytes": [size]})
            for batch in batches:
                for s, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if out is None or s != shard:
                        if out is not None:
                            yield close()
                        shard, records, size = s, 0, 0
                        out = store.open_output_stream(f"{at}/.{attempt}-{shard}")
                    raw = ((line or "") + "\n").encode("utf-8", "surrogatepass")
                    out.write(raw)
                    records, size = records + 1, size + len(raw)
            if out is not None:
                yield close()
        lines = sharded.select(F.col(shard_col).cast("string").alias("shard"), F.col(value_col).cast("string").alias("line"))
        (lines.repartition("shard").sortWithinPartitions("shard")
         .mapInArrow(put, "shard string, file string, records long, bytes long").write.parquet(f"{stage}/manifest"))
        files = spark.read.parquet(f"{stage}/manifest").count()
        manifest = f"_manifest-{yearmonth}"
        swap(spark, root, stage, [p for p in (yearmonth, manifest) if path_exists(spark, f"{root}/{p}")],
             [("month", yearmonth), ("manifest", manifest)])
    return files


def written_shards(spark: SparkSession, base: str, yearmonth: str) -> DataFrame:
    """S-18, M-06: the shard files of a month as their tasks wrote them: shard, file, records, bytes."""
    return spark.read.parquet(f"{base.rstrip('/')}/_manifest-{yearmonth}")


def write_interchange(df: DataFrame, path: str, fmt: str) -> None:
    """S-19: formats that keep any column name: JSON without dropping NULL
    fields, or CSV with header and every value quoted."""
    if fmt == "json":
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif fmt == "csv":
        df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)
    else:
        raise ValueError(f"unsupported interchange format: {fmt}")


def extraction_manifest(df: DataFrame, source_system: str, source_database: str, source_table: str,
                        schema_version: str, extracted_at: dt.datetime,
                        source_types: dict[str, str] | None = None) -> DataFrame:
    """S-23: one-row manifest: source, time, row count (one aggregation over
    the data), schema version and the column type map as JSON."""
    types = {f.name: (f"{source_types[f.name]} -> " if source_types and f.name in source_types else "")
             + f.dataType.simpleString() for f in df.schema.fields}
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(source_system).alias("source_system"), F.lit(source_database).alias("source_database"),
        F.lit(source_table).alias("source_table"),
        F.lit(extracted_at.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("extraction_timestamp"),
        "row_count", F.lit(schema_version).alias("schema_version"),
        F.lit(json.dumps(types, ensure_ascii=False)).alias("data_types_mapping"))


def _memory_of(schema: T.StructType) -> Column:
    """About the bytes a row takes in a sort: its null bits and the sorter's pointers, 8 bytes a column, and what strings and
    nested values hold."""
    size: Column = F.lit(48 + 8 * -(-len(schema) // 64) + 8 * len(schema)).cast("long")
    for f in schema:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c) + 8, F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))) * 4, F.lit(0))
    return size


def compact(spark: SparkSession, path: str, pred: Column, partition_by: list[str], keys: list[str],
            target_file_bytes: int = 512 * 1024 * 1024, sorted_bytes: int = SORTED_BYTES) -> int:
    """S-25: rewrite every partition that holds a row matching ``pred``,
    clustered by ``keys``: range-partitioned and sorted, fewer and larger
    files. The predicate only chooses partitions; all their rows are
    rewritten, and counted before the old files go.

    The file count follows the size on disk (``_metadata.file_size`` of the
    files it reads, aggregated on the executors): about
    ``target_file_bytes`` per file and at least one per partition, so a
    large day is never funnelled into one writer task. As a file is sorted
    by the task that writes it, the count follows the rows' size in memory
    too: about ``sorted_bytes`` per task, however well they compress."""
    recover(spark, path)
    folders = touched_folders(spark, path, with_folder(read_merged(spark, path)).where(F.coalesce(pred, F.lit(False))))
    if not folders:
        return 0
    rows = read_folders(spark, path, folders)
    files = rows.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).distinct()
    size = int(files.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0])
    count, memory = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(_memory_of(rows.schema)), F.lit(0))).first()
    n = max(len(folders), -(-size // int(target_file_bytes)), -(-int(memory) // int(sorted_bytes)))
    whole = read_spelled(spark, path, folders, partition_by, rows.schema)
    return publish(spark, path, whole, partition_by, folders, expect=int(count), clustered=(n, keys))
