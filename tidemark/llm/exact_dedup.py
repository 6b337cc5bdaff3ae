"""Exact dedup by counting quotient filters.

Every partition builds a counting quotient filter over 64-bit fingerprints of its texts: the leading bits (quotient)
pick a run, the rest (remainder) is stored sorted inside the run with its count. Filters are cut by fingerprint range,
and the pieces of a range merge losslessly, because reading a filter in slot order gives its fingerprints sorted.
Fingerprints counted more than once route their texts to byte verification, a grouping on the texts themselves, which
is pre-aggregated before its shuffle; nothing else of a text is moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import one_of_each, stage, texts_of, tidy

#: Fingerprints after which a task hands its filter over and starts the next.
FILTER_ITEMS = 1 << 20
#: Fingerprints of one range, which one task merges, if every text is another.
RANGE_ITEMS = 1 << 22
#: Least filled share for which a filter's quotient is chosen.
LOAD = 0.75


@dataclass
class CountingQuotientFilter:
    """A filter over the fingerprints of one range: ``prefix`` leading bits are the range's, the next ``q`` the quotient."""

    prefix: int
    q: int
    occupied: np.ndarray    # bool, one per quotient: the quotient has a run
    run_end: np.ndarray     # bool, one per slot: last slot of its run
    remainder: np.ndarray   # uint64, one per slot, sorted in a run
    count: np.ndarray       # int64, one per slot

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, prefix: int) -> CountingQuotientFilter:
        """From sorted distinct fingerprints (uint64) that share their ``prefix`` leading bits."""
        q = max(1, int(np.ceil(np.log2(max(1, len(fingerprints)) / LOAD))))
        body = fingerprints << np.uint64(prefix) if prefix else fingerprints
        quotient = (body >> np.uint64(64 - q)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        run_end = np.append(quotient[1:] != quotient[:-1], True) if len(quotient) else np.zeros(0, bool)
        return cls(prefix, q, occupied, run_end, body << np.uint64(q), counts.astype(np.int64))

    def read(self, range_id: int) -> np.ndarray:
        """The fingerprints, sorted."""
        runs = np.flatnonzero(self.occupied)
        nth = np.cumsum(self.run_end) - self.run_end
        body = (runs[nth].astype(np.uint64) << np.uint64(64 - self.q)) | (self.remainder >> np.uint64(self.q))
        if not self.prefix:
            return body
        return (body >> np.uint64(self.prefix)) | (np.uint64(range_id) << np.uint64(64 - self.prefix))

    def to_bytes(self) -> dict:
        return {"q": self.q, "occupied": np.packbits(self.occupied).tobytes(),
                "run_end": np.packbits(self.run_end).tobytes(), "remainder": self.remainder.tobytes(),
                "count": self.count.tobytes()}

    @classmethod
    def from_bytes(cls, prefix: int, row) -> CountingQuotientFilter:
        remainder = np.frombuffer(row["remainder"], np.uint64)
        bits = lambda b, n: np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
        return cls(prefix, int(row["q"]), bits(row["occupied"], 1 << int(row["q"])), bits(row["run_end"], len(remainder)),
                   remainder, np.frombuffer(row["count"], np.int64))


def merge(fingerprints: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted fingerprint lists; counts of equal ones add up."""
    f, c = np.concatenate(fingerprints), np.concatenate(counts)
    order = np.argsort(f, kind="stable")  # the lists are sorted runs, which this merges
    f, c = f[order], c[order]
    first = np.append(True, f[1:] != f[:-1]) if len(f) else np.zeros(0, bool)
    return f[first], np.add.reduceat(c, np.flatnonzero(first)) if len(f) else c


_FILTER = pa.schema([("range_id", pa.int64()), ("q", pa.int64()), ("occupied", pa.binary()), ("run_end", pa.binary()),
                     ("remainder", pa.binary()), ("count", pa.binary())])
_FILTER_DDL = "range_id long, q long, occupied binary, run_end binary, remainder binary, count binary"


def repeated_fingerprints(fingerprints: DataFrame, prefix: int) -> DataFrame:
    """(fp, n) of the values of column ``fp`` that occur more than once, by filters over 2**prefix ranges."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def filters() -> Iterator[pa.RecordBatch]:
            f, c = np.unique(np.concatenate(held), return_counts=True)
            ids = (f >> np.uint64(64 - prefix)).astype(np.int64) if prefix else np.zeros(len(f), np.int64)
            for r in np.unique(ids):
                a, b = np.searchsorted(ids, [r, r + 1])
                row = CountingQuotientFilter.build(f[a:b], c[a:b], prefix).to_bytes() | {"range_id": int(r)}
                yield pa.RecordBatch.from_pydict({n: [row[n]] for n in _FILTER.names}, schema=_FILTER)

        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += b.num_rows
            if size >= FILTER_ITEMS:
                yield from filters()
                held, size = [], 0
        if size:
            yield from filters()

    def join(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in rows:
            got = [CountingQuotientFilter.from_bytes(prefix, r) for r in part.to_dict("records")]
            f, c = merge([f, *(x.read(int(key[0])) for x in got)], [c, *(x.count for x in got)])
        more = c > 1
        yield pd.DataFrame({"fp": f[more].view(np.int64), "n": c[more]})

    parts = fingerprints.select("fp").mapInArrow(tidy(build), _FILTER_DDL)
    return parts.groupBy("range_id").applyInPandas(join, "fp long, n long")


def exact_dedup(docs: DataFrame, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are equal after ``normalise`` (none by default); null counts as empty. Of equal
    texts the row with the largest doc_id stays; of repeated rows with that id exactly one stays. Null ids are smaller
    than any other; a group of null ids only keeps one of them (keep_id null). An empty table gives no rows; extra
    columns are left behind.
    """
    spark = docs.sparkSession
    base = texts_of(docs)
    if normalise is not None:
        base = base.withColumn("text", normalise(F.col("text")))
    base = base.withColumn("fp", F.xxhash64("text"))
    # A range for each shuffle partition at least, and so many that one holds RANGE_ITEMS texts at most, or little more.
    prefix = max(int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length(), (docs.count() // RANGE_ITEMS).bit_length())
    repeated = stage(repeated_fingerprints(base, prefix), "repeated-fingerprints").select("fp")
    # Byte verification: only texts whose fingerprint repeats, collapsed before the shuffle.
    groups = (base.join(repeated, "fp").groupBy("fp", "text")
              .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
              .where("group_size > 1")
              .select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size",
                      F.lit(True).alias("grouped")))
    rows = base.groupBy("doc_id", "fp", F.sha2("text", 256).alias("text_sha256")).agg(F.count("*").alias("copies"))
    joined = rows.join(groups, ["fp", "text_sha256"], "left")
    return (joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id",
                    F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                    (F.col("grouped").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id"))
                                                  & (F.col("copy") == 1))).alias("kept"),
                    "text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts (see ``exact_dedup``)."""
    stays = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    rows = docs.withColumns({"_id": F.col("doc_id").cast("long"),
                             "_sha": F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)})
    return one_of_each(rows, stays, ["_id", "_sha"]).select(*(F.col(f"`{c}`") for c in docs.columns))
