"""Column-name mapping for formats with restricted names (N-01..N-08, A-24).

Everything here is plan-time work over column *names* (a few hundred per
table at most); the data itself is only ever renamed by one projection.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.drift import source_type_to_spark

# Letters that Unicode decomposition does not fold to ASCII.
EXTRA_FOLDS = {"đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ß": "ss", "æ": "ae", "Æ": "AE"}


def fold_accents(name: str) -> str:
    """Strip diacritics (NFKD) and fold the few letters that do not decompose."""
    s = "".join(EXTRA_FOLDS.get(ch, ch) for ch in name)
    return "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch))


def safe_name(name: str, fold: bool = True) -> str:
    """N-01: restricted-format-safe column name.

    Accents folded first (D-10), then every char outside ``[A-Za-z0-9_]``
    becomes ``_``, runs of ``_`` collapse, ``_`` is stripped from both ends,
    a leading digit gets a ``_`` prefix, and an empty result becomes
    ``col_<crc32 % 10000>`` (stable across runs, unlike ``hash``).
    """
    s = fold_accents(name) if fold else name
    s = re.sub(r"[^A-Za-z0-9_]", "_", s)
    s = re.sub(r"_+", "_", s).strip("_")
    if s and s[0].isdigit():
        s = "_" + s
    if not s:
        s = f"col_{zlib.crc32(name.encode('utf-8')) % 10000}"
    return s


def name_mapping(columns: list[str], fold: bool = True) -> tuple[dict, dict]:
    """N-02: (forward, reverse) mappings for one table; collisions (compared
    case-insensitively) get ``_1``, ``_2``... in column order."""
    forward, reverse, taken = {}, {}, set()
    for c in columns:
        base = safe_name(c, fold)
        cand, i = base, 1
        while cand.lower() in taken:
            cand = f"{base}_{i}"
            i += 1
        taken.add(cand.lower())
        forward[c] = cand
        reverse[cand] = c
    return forward, reverse


def rename_forward(df: DataFrame, forward: dict | None = None) -> DataFrame:
    """N-03: rename to safe names in one projection."""
    forward = forward or name_mapping(df.columns)[0]
    return df.toDF(*[forward.get(c, c) for c in df.columns])


def rename_back(df: DataFrame, reverse: dict) -> DataFrame:
    """N-03: restore original names."""
    return df.toDF(*[reverse.get(c, c) for c in df.columns])


def mapping_frame(spark: SparkSession, database: str, schema: str, table: str, columns: list[str],
                  created: str, fold: bool = True) -> DataFrame:
    """N-04: registry rows for one table (source_database, source_schema,
    source_table, original_column_name, avro_compatible_name, created_date)."""
    return mapping_frames(spark, database, schema, {table: columns}, created, fold)


def mapping_frames(spark: SparkSession, database: str, schema: str, tables: dict[str, list[str]],
                   created: str, fold: bool = True) -> DataFrame:
    """N-04 for many tables at once: one small frame (names, not data)."""
    rows = []
    for table, columns in tables.items():
        fwd, _ = name_mapping(columns, fold)
        rows += [(database, schema, table, c, fwd[c], created) for c in columns]
    return spark.createDataFrame(rows, "source_database string, source_schema string, source_table string, "
                                       "original_column_name string, avro_compatible_name string, "
                                       "created_date string").withColumn("created_date", F.to_date("created_date"))


REGISTRY_KEYS = ["source_database", "source_schema", "source_table", "original_column_name"]


def register_mappings(registry: DataFrame | None, new_rows: DataFrame) -> DataFrame:
    """N-04: add rows for originals not yet registered (create if absent);
    existing entries keep their safe name and creation date."""
    if registry is None:
        return new_rows
    fresh = new_rows.join(registry.select(*REGISTRY_KEYS), REGISTRY_KEYS, "left_anti")
    return registry.unionByName(fresh)


def mapped_select(df: DataFrame, forward: dict) -> DataFrame:
    """N-05: select with aliases only where the name changes."""
    return df.select(*[F.col(f"`{c}`").alias(forward[c]) if forward.get(c, c) != c else F.col(f"`{c}`")
                       for c in df.columns])


def select_sql(forward: dict, source: str) -> str:
    """N-05: the same projection as SQL text (backtick-quoted originals)."""
    parts = [f"`{o}` AS {s}" if o != s else f"`{o}`" for o, s in forward.items()]
    return "SELECT\n  " + ",\n  ".join(parts) + f"\nFROM {source}"


def create_table_ddl(table: str, columns: list[dict], forward: dict) -> str:
    """N-06: CREATE TABLE with safe names; ``type(length)`` for sized types,
    ``-1`` (MAX) becomes unsized, NOT NULL only when not nullable (D-16)."""
    defs = []
    for c in columns:
        name = forward[c["name"]]
        t = c["type"]
        length = c.get("length")
        if length not in (None, "", "NULL", -1, "-1"):
            t = f"{t}({length})"
        spark_t = source_type_to_spark(c["type"], c.get("precision"), c.get("scale")).simpleString()
        null = "" if c.get("nullable", True) else " NOT NULL"
        defs.append(f"  `{name}` {spark_t.upper()}{null} COMMENT 'source type {t}'")
    return f"CREATE TABLE IF NOT EXISTS {table} (\n" + ",\n".join(defs) + "\n) USING parquet"


def view_sql(view: str, table: str, forward: dict) -> str:
    """N-07: a view over the safe-named table that restores original names."""
    parts = [f"`{s}` AS `{o}`" if o != s else f"`{o}`" for o, s in forward.items()]
    return f"CREATE OR REPLACE TEMP VIEW `{view}` AS SELECT " + ", ".join(parts) + f" FROM {table}"


def original_view(df: DataFrame, reverse: dict, view: str) -> DataFrame:
    """N-07: register ``vw_<table>`` with original names; returns it."""
    out = rename_back(df, reverse)
    out.createOrReplaceTempView(view)
    return out


def mapping_summary(registry: DataFrame) -> DataFrame:
    """A-24: columns mapped and transformed per table."""
    return (registry.groupBy("source_table")
            .agg(F.count(F.lit(1)).alias("column_count"),
                 F.count(F.when(F.col("original_column_name") != F.col("avro_compatible_name"), 1))
                 .alias("transformed_count"))
            .orderBy(F.col("transformed_count").desc(), "source_table"))


def safe_name_expr(c) -> "F.Column":
    """N-01 on name *data* (e.g. a metadata column) without the accent fold
    and the empty-name fallback -- the pure regex part of the rule."""
    col = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(F.regexp_replace(col, r"[^A-Za-z0-9_]", "_"), "_+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)

