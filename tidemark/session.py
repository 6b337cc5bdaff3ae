"""Session construction and cluster-shared locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every tidemark job relies on. AQE re-plans joins and coalesces
# shuffle partitions at runtime; skew-join splitting handles hot keys.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "tidemark",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one with the tidemark defaults.

    On a cluster ``master`` stays ``None`` and the submitting environment
    decides; tests pass ``local[*]``.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder for lineage cuts and staging tables.

    Read from ``spark.checkpoint.dir`` (which the cluster sets to shared
    storage). Only when it is unset -- local tests -- a fresh local folder is
    created and registered.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if spark.sparkContext.master.startswith("local"):
        path = fallback or tempfile.mkdtemp(prefix="tidemark-ckpt-")
    elif fallback:
        path = fallback
    else:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; configure a shared folder for the cluster")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def staging_path(spark: SparkSession, name: str) -> str:
    """A path for a staged table inside the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "staging", name)
