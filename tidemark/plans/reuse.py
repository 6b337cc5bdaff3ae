"""Results of earlier runs, kept by row fingerprint (J-13).

The store is a table of its own: key, fingerprint of the request, and where its result lies. A run probes it before it does
anything, processes what is new or changed, and records that afterwards, by a keyed upsert (J-02). Rows lie in folders by a hash
of their key, so recording rewrites the folders of the processed keys and looks up no other. The probe is one equi-join on key
and fingerprint; Catalyst prunes the store's columns and, where the sides' sizes warrant it, builds a Bloom filter of the
smaller side for the scan of the larger (``spark.sql.optimizer.runtime.bloomFilter.enabled``).
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import row_hash
from tidemark.functions.timefn import ts_lit
from tidemark.sources import io

#: Folders of a store; a choice of its first run.
BUCKETS = 64
LOCATION, FINGERPRINT, BUCKET = "result_location", "_fingerprint", "_bucket"


def probe(spark: SparkSession, store: str, current: DataFrame, keys: list[str], fingerprint_cols: list[str]) -> DataFrame:
    """``current`` with ``result_location``: where the result of the same key with the same values lies, NULL where there is
    none and the row is to be processed. A store that does not exist knows nothing. NULL keys equal each other. The frame reads
    the store as it is now: use or stage it before the store is recorded to."""
    marked = current.withColumn(FINGERPRINT, row_hash(fingerprint_cols))
    if not io.path_exists(spark, store):
        return marked.drop(FINGERPRINT).withColumn(LOCATION, F.lit(None).cast("string"))
    io.recover(spark, store)
    known = spark.read.parquet(store).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                                             F.col(FINGERPRINT).alias("_f"), LOCATION)
    same = reduce(lambda a, b: a & b, [marked[k].eqNullSafe(known[f"_k{i}"]) for i, k in enumerate(keys)],
                  marked[FINGERPRINT] == known["_f"])
    return marked.join(known, same, "left").select(*current.columns, LOCATION)


def record(spark: SparkSession, store: str, processed: DataFrame, keys: list[str], fingerprint_cols: list[str],
           location: str, as_of: dt.datetime) -> int:
    """Keep what a run has processed: its rows' keys and fingerprints, with the run's ``location``. A key that is known by
    another fingerprint takes the new one. A repeated key is an error, as for any upsert. Returns the rows recorded."""
    rows = processed.select(*keys, row_hash(fingerprint_cols).alias(FINGERPRINT), F.lit(location).alias(LOCATION),
                            ts_lit(as_of).alias("recorded_at"),
                            F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias(BUCKET))
    with io.staged(rows) as mine:
        n = mine.count()
        if n:  # a key's folder follows from the key, so it never moves
            io.write_upsert(spark, store, mine, keys, [BUCKET], within_source_partitions=True)
    return n
