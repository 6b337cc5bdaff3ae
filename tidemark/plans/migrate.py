"""Name-mapped migration of many tables (N-08, S-20, N-04..N-07).

For each table: name mapping (N-02), rename in one projection (N-03),
write in the restricted format, register the mapping (N-04), expose a view
with the original names (N-07). A failing table is recorded, not fatal.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import names as nm
from tidemark.sources import io


def migrate_tables(spark: SparkSession, tables: dict[str, DataFrame], target_root: str, database: str,
                   schema: str, created: dt.date, registry: DataFrame | None = None,
                   fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Returns (status rows, updated mapping registry)."""
    status = []
    registered: dict[str, list[str]] = {}
    for name, df in tables.items():
        try:
            fwd, rev = nm.name_mapping(df.columns)
            safe = nm.mapped_select(df, fwd)
            path = f"{target_root.rstrip('/')}/{nm.safe_name(name)}"
            io.export_table(safe, path, "replace", fmt)
            registered[name] = df.columns
            nm.original_view(spark.read.format(fmt).load(path), rev, f"vw_{nm.safe_name(name)}")
            changed = sum(1 for o, s in fwd.items() if o != s)
            status.append((name, path, "success", len(df.columns), changed, None))
        except Exception as e:
            status.append((name, None, "failed", len(df.columns), None, f"{type(e).__name__}: {e}"))
    if registered:
        rows = nm.mapping_frames(spark, database, schema, registered, created.isoformat())
        registry = nm.register_mappings(registry, rows)
    out = spark.createDataFrame(status, "table_name string, target string, status string, columns int, "
                                        "renamed int, error string")
    return out, registry
