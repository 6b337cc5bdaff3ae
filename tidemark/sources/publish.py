"""Partition folders of a file table: which ones hold what, and replacing whole folders by staged ones.

Folder names are always taken from the storage listing or from the files that were read, never rebuilt from partition values:
``month=01`` and ``month=1`` are the same value in different folders, and odd values are escaped in names. Rows that stay keep
their folder's spelling, and new rows take the spelling that their value has in the table (:func:`as_spelled`).

A staged result is written once, beside the table's own folders (a name with a leading underscore, which readers skip), and
then swapped in folder by folder: old folder aside, new folder in. What has to be moved is written down with the staged rows,
and one rename of the staged folder says that the swap has begun. Nothing of the table changes before that rename, and nothing
is deleted before the last move: an error in between leaves all old and new rows on storage, and the next writer, or
:func:`recover`, carries the swap out to its end. There is one writer to a table at a time, as for any file table. Only folder
names pass through the driver, one per partition, as in Spark's own file index.
"""

from __future__ import annotations

import contextlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "_folder"
#: Prefix of the columns that carry a partition value as its folder spells it.
SPELLED = "_as_"
_STAGED, _READY, _ASIDE, _PLAN = "_staged-", "_ready-", "_aside-", "_plan.json"


class UnfinishedSwap(OSError):
    """A storage error during a swap: all old and new rows are on storage, and the next write or ``recover`` finishes it."""


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _hadoop(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> bool:
    _, p, fs = _hadoop(spark, path)
    return fs.delete(p, True)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Rename, with the target's parents made first; an error if the storage refuses."""
    jvm, p, fs = _hadoop(spark, source)
    to = jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise OSError(f"could not move {source} to {target}")


def leaf_folders(spark: SparkSession, root: str, depth: int) -> list[str]:
    """Relative names of the partition folders ``depth`` levels under ``root`` (``c=v/d=w``)."""
    _, p, fs = _hadoop(spark, root)
    if not fs.exists(p):
        return []
    level = [("", p)]
    for _ in range(depth):
        below = []
        for rel, folder in level:
            for st in fs.listStatus(folder):
                name = st.getPath().getName()
                if st.isDirectory() and "=" in name and not name.startswith("."):
                    below.append((f"{rel}/{name}".lstrip("/"), st.getPath()))
        level = below
    return sorted(rel for rel, _ in level)


# ------------------------------------------------------------------ reading

@contextlib.contextmanager
def plain_partitions(spark: SparkSession) -> Iterator[None]:
    """Partition columns of what is read inside are strings, spelled as in the folder names (``01`` stays ``01``)."""
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The whole table with the columns of all its files."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def read_folders(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """Only these partition folders, with the columns of all their files and the partition columns."""
    root = path.rstrip("/")
    return (spark.read.option("basePath", root).option("mergeSchema", "true")
            .parquet(*[f"{root}/{f}" for f in folders]))


def read_spelled(spark: SparkSession, path: str, folders: list[str], partition_by: list[str], schema: T.StructType) -> DataFrame:
    """Only these folders, with the columns of ``schema``, and each partition value once more as its folder spells it."""
    with plain_partitions(spark):
        rows = read_folders(spark, path, folders)
        held = rows.columns
    return rows.select(*[(F.col(f.name) if f.name in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema],
                       *[F.col(p).cast("string").alias(SPELLED + p) for p in partition_by])


def with_folder(df: DataFrame) -> DataFrame:
    """``df`` (a plain scan) with the folder of each row's file, as the storage spells it."""
    return df.withColumn(FOLDER, F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1))


def same_values(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    """Equality of ``cols`` where NULL matches NULL."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def touched_folders(spark: SparkSession, path: str, rows: DataFrame) -> list[str]:
    """Relative folders named in column ``_folder`` of ``rows`` (distinct before they reach the driver)."""
    jvm, root, fs = _hadoop(spark, path)
    base = fs.makeQualified(root).toUri().getPath().rstrip("/")
    out = set()
    for r in rows.select(FOLDER).distinct().collect():
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r[0])).toUri().getPath()
        out.add(folder[len(base):].strip("/"))
    return sorted(out)


# ----------------------------------------------------------------- spelling

def _usual(value: str, kind: T.DataType) -> bool:
    """Whether a partition value is spelled as Spark would spell it."""
    if isinstance(kind, T.IntegralType):
        return re.fullmatch(r"0|-?[1-9][0-9]*", value) is not None
    if isinstance(kind, T.DateType):
        return re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value) is not None
    return isinstance(kind, (T.StringType, T.BooleanType))


def as_spelled(spark: SparkSession, path: str, df: DataFrame, partition_by: list[str]) -> DataFrame:
    """``df`` with its partition columns as strings, spelled as the folders of the table at ``path`` spell them.

    A row that carries its own spelling (:func:`read_spelled`) keeps it. Another takes, level by level, that of the folder of
    its value under the folders chosen so far (the least, if there are several); a value without a folder is spelled as Spark
    spells it, padded with zeros where the level's folders are. The lookup has a row per folder and is joined only if some
    folder of the table is spelled in an unusual way.
    """
    own = [SPELLED + p for p in partition_by]
    rows = df.select("*", *[F.lit(None).cast("string").alias(c) for c in own if c not in df.columns])
    kinds = [df.schema[p].dataType for p in partition_by]
    folders = [[None if part.endswith("=__HIVE_DEFAULT_PARTITION__") else unquote(part.split("=", 1)[1]) for part in f.split("/")]
               for f in leaf_folders(spark, path, len(partition_by))]
    unusual = any(v is not None and not _usual(v, k) for f in folders for v, k in zip(f, kinds, strict=True))
    for i, p in enumerate(partition_by):
        spelled = F.col(p).cast("string")
        if unusual:
            seen = {tuple(f[:i + 1]) for f in folders if f[i] is not None}
            padded = {len(v) for *_, v in seen if re.fullmatch(r"0[0-9]+", v)}
            if len(padded) == 1 and isinstance(kinds[i], T.IntegralType):
                width = padded.pop()
                spelled = F.when((F.col(p) >= 0) & (F.length(spelled) < width), F.lpad(spelled, width, "0")).otherwise(spelled)
            names = [f"_k{j}" for j in range(i)] + ["_v", "_s"]
            known = spark.createDataFrame([(*f[:i], f[i], f[i]) for f in seen], ", ".join(f"{n} string" for n in names))
            known = (known.withColumn("_v", F.col("_v").try_cast(kinds[i])).groupBy(*names[:-1]).agg(F.min("_s").alias("_s")))
            on = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(known[n]) for c, n in zip(own[:i], names, strict=False)],
                        rows[p] == known["_v"])
            rows = rows.join(known, on, "left").drop(*names[:-1])
            spelled = F.coalesce("_s", spelled)
        rows = rows.withColumn(own[i], F.coalesce(own[i], spelled)).drop("_s")
    return rows.select(*[F.col(SPELLED + c).alias(c) if c in partition_by else F.col(c) for c in df.columns if c not in own])


# ------------------------------------------------------------------ writing

def _write_text(spark: SparkSession, path: str, text: str) -> None:
    _, p, fs = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    jvm, p, fs = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def _finish(spark: SparkSession, root: str, name: str) -> None:
    """Carry out the swap of ``_ready-<name>``, from wherever an earlier attempt left it."""
    ready, aside = f"{root}/{_READY}{name}", f"{root}/{_ASIDE}{name}"
    plan = _read_text(spark, f"{ready}/{_PLAN}")
    if plan is not None:  # the plan is the last thing to go: without it, all moves are done
        steps = json.loads(plan)
        out = set(steps["out"])

        def set_aside(old: str) -> None:
            if path_exists(spark, f"{root}/{old}") and not path_exists(spark, f"{aside}/{old}"):
                move_path(spark, f"{root}/{old}", f"{aside}/{old}")
        for source, target in steps["in"]:
            if path_exists(spark, f"{ready}/{source}"):
                if target in out:
                    set_aside(target)
                move_path(spark, f"{ready}/{source}", f"{root}/{target}")
        for old in sorted(out - {target for _, target in steps["in"]}):
            set_aside(old)
        jvm, top, fs = _hadoop(spark, root)
        for old in out:  # parents left without folders
            parent = jvm.org.apache.hadoop.fs.Path(f"{root}/{old}").getParent()
            while parent.getName() != top.getName() and fs.exists(parent) and not fs.listStatus(parent):
                fs.delete(parent, False)
                parent = parent.getParent()
        delete_path(spark, f"{ready}/{_PLAN}")
    delete_path(spark, ready)
    delete_path(spark, aside)


def swap(spark: SparkSession, path: str, staged: str, out: list[str], into: list[tuple[str, str]]) -> None:
    """Take the paths ``out`` (relative to the table) out of it and move ``into`` (relative to ``staged``, to the table) in.

    An error before the swap has begun leaves the table as it was; a later one raises :class:`UnfinishedSwap` and leaves every
    old and new row on storage for ``recover``.
    """
    root = path.rstrip("/")
    name = uuid.uuid4().hex
    _write_text(spark, f"{staged}/{_PLAN}", json.dumps({"out": sorted(out), "in": sorted(into)}))
    move_path(spark, staged, f"{root}/{_READY}{name}")
    try:
        _finish(spark, root, name)
    except Exception as e:
        raise UnfinishedSwap(f"swap {name} in {root} was interrupted; the next write or recover() finishes it") from e


def recover(spark: SparkSession, path: str) -> int:
    """Finish the swaps that an error interrupted; the number of them. Every writer of this package begins with it."""
    root = path.rstrip("/")
    _, p, fs = _hadoop(spark, root)
    if not fs.exists(p):
        return 0
    names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
    begun = sorted(n[len(_READY):] for n in names if n.startswith(_READY))
    for name in begun:
        _finish(spark, root, name)
    for n in names:  # a swap whose last step, this removal, was missed
        if n.startswith(_ASIDE) and n[len(_ASIDE):] not in begun:
            delete_path(spark, f"{root}/{n}")
    return len(begun)


@contextlib.contextmanager
def staging(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder beside the table's own for a result; removed at the end, unless a swap has taken it over."""
    staged = f"{path.rstrip('/')}/{_STAGED}{uuid.uuid4().hex}"
    try:
        yield staged
    finally:
        with contextlib.suppress(Exception):  # a leftover is skipped by readers; the error of the block matters more
            delete_path(spark, staged)


def _ranges(rows: DataFrame, n: int, by: list[str], partition_by: list[str]) -> DataFrame:
    """``rows`` dealt to ``n`` ranges of ``by``; rows that are equal in it are dealt out too, by their place in the input.

    A NULL partition becomes an empty name, which is written to the same folder: without NULL the order that the rows are
    sorted in is the one the writer asks for, and they are sorted once.
    """
    named = rows.withColumns({p: F.coalesce(p, F.lit("")) for p in partition_by})
    return named.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(n, *by, "_place").drop("_place")


def publish(spark: SparkSession, path: str, result: DataFrame, partition_by: list[str], replaced: list[str],
            expect: int | None = None, clustered: tuple[int, list[str]] | None = None) -> int:
    """Replace the folders ``replaced`` of the table by ``result``; a folder without rows left is gone afterwards.

    ``result`` is written once, into a folder the table's readers skip, and counted during that write; nothing of the table
    changes if the write fails or the count is not ``expect``, and no row is lost if a move fails (:func:`swap`). Returns the
    rows written. ``clustered``: the number of ranges of folders and keys that the rows are dealt to, one task each, and the
    keys, by which every file is sorted.
    """
    root = path.rstrip("/")
    recover(spark, root)
    seen = Observation()
    with staging(spark, root) as stage:
        written = as_spelled(spark, root, result, partition_by)
        if clustered:
            written = _ranges(written, clustered[0], [*partition_by, *clustered[1]], partition_by)
        written = written.observe(seen, F.count(F.lit(1)).alias("rows"))  # after the ranges, which read the rows twice
        if clustered:
            written = written.sortWithinPartitions(*partition_by, *clustered[1])
        written.write.partitionBy(*partition_by).parquet(stage)
        rows = int(seen.get["rows"])
        if expect is not None and rows != expect:
            raise ValueError(f"rewrite of {len(replaced)} partitions has {rows} rows, expected {expect}")
        new = leaf_folders(spark, stage, len(partition_by))
        held = {f for f in {*replaced, *new} if path_exists(spark, f"{root}/{f}")}
        swap(spark, root, stage, sorted(held), [(f, f) for f in new])
    return rows


def append_once(spark: SparkSession, df: DataFrame, path: str, partition_by: list[str], tag: str) -> int:
    """Append ``df`` under file names that begin with ``tag``, in place of the files of an earlier attempt with that tag.

    Replaying the same batch therefore leaves one copy of it, and a storage error leaves either attempt's files to
    :func:`recover`.
    """
    root = path.rstrip("/")
    recover(spark, root)
    seen = Observation()
    with staging(spark, root) as stage:
        (as_spelled(spark, root, df, partition_by).observe(seen, F.count(F.lit(1)).alias("rows"))
         .write.partitionBy(*partition_by).parquet(stage))
        jvm, top, fs = _hadoop(spark, root)
        base = fs.makeQualified(top).toUri().getPath().rstrip("/")
        earlier = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{'/'.join(['*'] * len(partition_by))}/{tag}-*")) or []
        old = [st.getPath().toUri().getPath()[len(base):].strip("/") for st in earlier if "=" in st.getPath().getParent().getName()]
        new = []
        for folder in leaf_folders(spark, stage, len(partition_by)):
            for st in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{stage}/{folder}")):
                name = st.getPath().getName()
                if not name.startswith((".", "_")):
                    new.append((f"{folder}/{name}", f"{folder}/{tag}-{name}"))
        swap(spark, root, stage, old, new)
    return int(seen.get["rows"])
