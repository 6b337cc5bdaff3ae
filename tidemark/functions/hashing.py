"""Row fingerprints and table checksums (P-02, F-10, A-25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_MARK = "~"


def encode_value(c) -> Column:
    """Null-safe, unambiguous text form of one value: ``<len>:<text>`` or ``~``.

    ``concat_ws`` alone skips NULLs, so ``(a, NULL)`` and ``(NULL, a)`` would
    hash the same (D-8); the length prefix also keeps separators inside values
    from colliding.
    """
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit(NULL_MARK))


def row_hash(cols: list, bits: int = 256) -> Column:
    """SHA-2 fingerprint of the given columns, null-safe (P-02)."""
    return F.sha2(F.concat_ws("|", *[encode_value(c) for c in cols]), bits)


def row_hash64(cols: list) -> Column:
    """64-bit fingerprint of the same null-safe encoding (``xxhash64``): for
    comparing two versions of one key, where a 2**-64 miss is negligible."""
    return F.xxhash64(F.concat_ws("|", *[encode_value(c) for c in cols]))


def hash_columns(df: DataFrame, exclude: list[str] = (), name: str = "row_hash") -> DataFrame:
    """Add ``row_hash`` over every column except ``exclude`` (partition columns)."""
    cols = [c for c in df.columns if c not in set(exclude)]
    return df.withColumn(name, row_hash(cols))


def table_fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A-25: row count plus an order-free checksum of the rows; one row.

    ``bit_xor`` of a 64-bit row hash alone cancels pairs of equal rows, so the
    wrapping ``sum`` of the same hash is kept next to it. Both aggregate
    partially on each executor: no shuffle beyond one row per task.
    """
    cols = cols or df.columns
    h = F.xxhash64(*[F.col(c) for c in cols])
    return df.agg(F.count(F.lit(1)).alias("row_count"),
                  F.bit_xor(h).alias("xor_checksum"),
                  F.sum(h.cast("decimal(38,0)")).alias("sum_checksum"))
