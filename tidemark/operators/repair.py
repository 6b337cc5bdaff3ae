"""Duplicate repair, coverage statistics, rollups and set operations.

(W-01, W-02, A-18..A-21, A-27, L-01..L-04, U-01..U-05)

Scale notes:
* ``latest_per_key`` filters ``row_number() == 1``; Catalyst turns that into a
  partial ``WindowGroupLimit`` on the map side, so a key holding a third of
  the rows is cut to one row per input partition *before* the shuffle.
* Distinct-key counts use ``count(distinct struct(keys))``, which Spark
  plans as a two-level aggregation (partial de-duplication per task), so a
  hot key never lands whole in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs):
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """W-01: keep the first row per key under ``order`` (e.g. newest first).

    ``order`` must be a total order within a key (append a tie-break),
    otherwise the survivor is arbitrary.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def key_struct(keys: list[str]) -> Column:
    """Null-safe composite key: a struct is never NULL even when a field is (D-9)."""
    return F.struct(*[F.col(k) for k in keys])


def duplicate_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """A-18: total rows, distinct keys, and their difference; one row."""
    return (df.agg(F.count(F.lit(1)).alias("total_records"),
                   F.countDistinct(key_struct(keys)).alias("unique_records"))
            .withColumn("duplicate_count", F.col("total_records") - F.col("unique_records")))


def duplicate_detail(df: DataFrame, keys: list[str], top: int = 100) -> DataFrame:
    """A-19: keys occurring more than once, most repeated first (top-k)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrence_count"))
            .where(F.col("occurrence_count") > 1)
            .orderBy(F.col("occurrence_count").desc(), *keys).limit(top))


def in_range(date_col: str, start, end) -> Column:
    """P-07: inclusive range predicate ``start <= date_col <= end``."""
    return F.col(date_col).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def dedup_slice(df: DataFrame, date_col: str, start, end, keys: list[str],
                order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """W-02: repair duplicates inside a date slice and prove the repair.

    Returns ``(deduped_slice, proof)``. ``proof`` is one row computed in one
    pass over the slice: rows before, distinct keys before, rows after, and
    ``ok`` = (rows after == distinct keys before).
    """
    sl = df.where(in_range(date_col, start, end))
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = sl.withColumn("__rn", F.row_number().over(w))
    deduped = ranked.where(F.col("__rn") == 1).drop("__rn")
    proof = (sl.agg(F.count(F.lit(1)).alias("rows_before"),
                    F.countDistinct(key_struct(keys)).alias("distinct_keys_before"))
             .unionByName(deduped.agg(F.count(F.lit(1)).alias("rows_after")), allowMissingColumns=True)
             .agg(F.max("rows_before").alias("rows_before"),
                  F.max("distinct_keys_before").alias("distinct_keys_before"),
                  F.max("rows_after").alias("rows_after"))
             .withColumn("ok", F.col("rows_after") == F.col("distinct_keys_before")))
    return deduped, proof


def date_coverage(df: DataFrame, date_col: str, start, end, layer: str | None = None) -> DataFrame:
    """A-20: rows, first and last day, distinct days inside the range; one row."""
    out = (df.where(in_range(date_col, start, end))
           .agg(F.count(F.lit(1)).alias("total_records"), F.min(date_col).alias("earliest_date"),
                F.max(date_col).alias("latest_date"), F.countDistinct(date_col).alias("distinct_days")))
    return out.select(F.lit(layer).alias("layer"), "*") if layer is not None else out


def partition_counts(df: DataFrame, partition_col: str) -> DataFrame:
    """A-21: rows per partition value (the row count of the result is the
    number of distinct partitions)."""
    return df.groupBy(partition_col).agg(F.count(F.lit(1)).alias("record_count")).orderBy(partition_col)


def rollup(df: DataFrame, keys: list[str], date_col: str, start, end, aggs: list[Column]) -> DataFrame:
    """A-27: bronze -> silver rollup of a date range by keys and day; the
    aggregates are supplied by the caller (X-02)."""
    return df.where(in_range(date_col, start, end)).groupBy(*keys, date_col).agg(*aggs)


def with_row_index(df: DataFrame, order: list[str], name: str = "row_index",
                   partitions: int | None = None) -> DataFrame:
    """Consecutive 0-based index under a global order, computed distributedly
    and without leaving the JVM: range-partition on the order, number rows
    inside each range, prefix-sum the per-range counts (one row per range,
    broadcast back) and add the offset. No un-partitioned window pulls every
    row into one task. The numbered ranges are staged, since a second
    evaluation of the sampled ranges could cut elsewhere. Equal order values
    stay in one range, so the order should be (nearly) unique."""
    from tidemark.sources.io import stage
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) for c in order]
    r = df.repartitionByRange(n, *cols).withColumn("__p", F.spark_partition_id())
    r = stage(r.withColumn("__rn", F.row_number().over(Window.partitionBy("__p").orderBy(*cols))))
    offs = (r.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
            .withColumn("__off", F.coalesce(F.sum("__c").over(
                Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
            .drop("__c"))
    return (r.join(F.broadcast(offs), "__p")
            .withColumn(name, (F.col("__off") + F.col("__rn") - 1).cast("long"))
            .drop("__p", "__rn", "__off"))


def sample_rows(df: DataFrame, n: int, key: list[str], seed: str = "") -> DataFrame:
    """L-03 (sample): ``n`` rows chosen by an md5 of ``seed`` and the key --
    reproducible in any engine, and a TakeOrdered (top-k per task, then
    merged), so no global sort and no full shuffle."""
    h = F.md5(F.concat(F.lit(seed), F.concat_ws("|", *[F.col(k).cast("string") for k in key])))
    return df.withColumn("__h", h).orderBy("__h", *key).limit(n).drop("__h")


def stride_sample(values: DataFrame, col: str, size: int) -> DataFrame:
    """L-04: every k-th distinct value in sorted order, k = max(1, n // size);
    the first and the last value are always kept (D-23). The values are
    numbered in ranges (:func:`with_row_index`, NULL first) and chosen by their
    numbers in Spark; only their count reaches the driver, whatever column it
    is."""
    numbered = with_row_index(values.select(col).distinct(), [col], "__at")
    n = numbered.count()
    k = max(1, n // max(1, size))
    return numbered.where((F.col("__at") % k == 0) | (F.col("__at") == n - 1)).select(col)


def union_by_name(dfs: list[DataFrame]) -> DataFrame:
    """U-01: union by column name; columns missing on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """U-02: positional UNION ALL."""
    return reduce(lambda a, b: a.union(b), dfs)


def difference(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    """U-03: rows of ``left`` without a match in ``right`` (on keys, or whole rows)."""
    if on:
        return left.join(right.select(*on), on, "left_anti")
    return left.subtract(right)


def distinct_rows(df: DataFrame) -> DataFrame:
    """U-04."""
    return df.distinct()


def drop_duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """U-05: one arbitrary survivor per key (use W-01 when the survivor matters)."""
    return df.dropDuplicates(keys)


def sort_by_category(df: DataFrame, col: str, categories: list[str], *then: str) -> DataFrame:
    """L-02: sort by a custom category order; unknown categories last."""
    rank = F.lit(len(categories) + 1)
    for i, c in reversed(list(enumerate(categories, start=1))):
        rank = F.when(F.col(col) == c, i).otherwise(rank)
    return df.orderBy(rank, *then)
