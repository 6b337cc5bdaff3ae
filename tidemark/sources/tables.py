"""Reading the driver tables and other named inputs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.publish import path_exists

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one table (S-01); projection/filters prune at the scan."""
    return spark.read.parquet(table_path(sf_dir, name))


def register_tables(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> None:
    for n in names:
        if path_exists(spark, table_path(sf_dir, n)):
            read_table(spark, sf_dir, n).createOrReplaceTempView(n)
