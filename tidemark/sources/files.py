"""Single files from inside tasks, through the file system that their path names."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Hadoop settings of the object store that the footer readers on the executors need as well.
_STORE_KEYS = ("fs.s3a.access.key", "fs.s3a.secret.key", "fs.s3a.session.token", "fs.s3a.endpoint", "fs.s3a.endpoint.region",
               "fs.s3a.connection.ssl.enabled")


def store_settings(spark: SparkSession) -> dict[str, str]:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return {k: v for k in _STORE_KEYS if (v := conf.get(k)) is not None}


def open_filesystem(path: str, settings: dict[str, str]):
    """(file system, path in it) of a Hadoop path: local files, ``s3``/``s3a``/``s3n`` with the session's own settings, and
    what the Arrow library knows by its scheme."""
    import pyarrow.fs as pafs
    scheme, rest = re.match(r"^(?:([a-z0-9]+):)?(.*)$", path, re.S).groups()
    if scheme in (None, "file"):
        return pafs.LocalFileSystem(), re.sub(r"^/*", "/", rest)
    if scheme in ("s3", "s3a", "s3n"):
        get = settings.get
        kw = {"access_key": get("fs.s3a.access.key"), "secret_key": get("fs.s3a.secret.key"),
              "session_token": get("fs.s3a.session.token"), "region": get("fs.s3a.endpoint.region"),
              "endpoint_override": get("fs.s3a.endpoint"),
              "scheme": "http" if get("fs.s3a.connection.ssl.enabled") == "false" else "https"}
        return pafs.S3FileSystem(**{k: v for k, v in kw.items() if v is not None}), rest.lstrip("/")
    return pafs.FileSystem.from_uri(path)
