"""Hard negatives by exact integer inner products: Strassen multiplication of anchor-candidate tiles, then mergeable heaps.

Anchors and candidates are dealt by row number over a grid of bounded cells. A cell multiplies its int64 tiles by Strassen's
recursion, with zero padding where a side is odd, and keeps for each anchor a heap of its first positives. Heaps of all cells
merge into the anchor's positives; these open windows of scores, for which a second pass over the grid keeps heaps of the first
negatives. A cell holds a bounded number of rows whatever the labels are, and a heap a bounded number of entries, so nothing
grows with a label, with copies of a vector or with ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stage

POSITIVES, NEGATIVES = 5, 5
#: A component x counts as floor(SCALE * x).
SCALE = 256
#: Rows of a cell's sides, fewer where vectors are so long that a side would pass SIDE_BYTES; rows and columns of a tile.
ANCHORS, CANDIDATES, SIDE_BYTES = 2048, 4096, 32 << 20
TILE_ROWS, TILE_COLUMNS = 256, 1024
#: Strassen's recursion ends where a side is no longer than this.
LEAF = 16

_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` for int64 matrices by seven half-size products; odd sides are padded with a zero row or column.

    Sums are those of 64-bit integers (modulo 2**64), a ring in which the recursion is exact: an entry that fits a long is
    right even where a part of the recursion does not fit.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    p, q, r = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:p, :q], a[:p, q:], a[p:, :q], a[p:, q:]
    b11, b12, b21, b22 = b[:q, :r], b[:q, r:], b[q:, :r], b[q:, r:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * p, 2 * r), np.int64)
    c[:p, :r] = m1 + m4 - m5 + m7
    c[:p, r:] = m3 + m5
    c[p:, :r] = m2 + m4
    c[p:, r:] = m1 - m2 + m3 + m6
    return c[:m, :n]


def integers(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    """floor(SCALE * x) of list columns as int64 rows of ``dim`` components: shorter vectors end in zeros, and values beyond a
    long become the nearest long."""
    col = vectors.combine_chunks()
    with np.errstate(all="ignore"):
        x = np.floor(SCALE * col.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        x = np.where(x >= 2.0 ** 63, np.iinfo(np.int64).max, np.where(x < -2.0 ** 63, np.iinfo(np.int64).min, x.astype(np.int64)))
    sizes = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = x
    return out


class Heap:
    """The first ``k`` entries of each row: higher scores first, ties by column. Heaps merge in any order."""

    def __init__(self, k: int):
        self.k = k
        self.row = self.col = self.score = np.zeros(0, np.int64)

    def push(self, row: np.ndarray, col: np.ndarray, score: np.ndarray) -> None:
        row, col, score = (np.concatenate(x) for x in ((self.row, row), (self.col, col), (self.score, score)))
        order = np.lexsort((col, ~score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        nth = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        self.row, self.col, self.score = (x[nth < self.k] for x in (row, col, score))

    def push_tile(self, scores: np.ndarray, allowed: np.ndarray, row: int, col: int) -> None:
        """Add the allowed entries of a tile whose first entry is (row, col); only those at or above a row's k-th best matter."""
        if scores.shape[1] > self.k:
            s = np.where(allowed, scores, np.iinfo(np.int64).min)
            allowed = allowed & (s >= np.partition(s, s.shape[1] - self.k, axis=1)[:, -self.k, None])
        r, c = np.nonzero(allowed)
        if len(r):
            self.push(r + row, c + col, scores[r, c])


def _tiles(a: np.ndarray, c: np.ndarray):
    for i in range(0, len(a), TILE_ROWS):
        for j in range(0, len(c), TILE_COLUMNS):
            yield i, j, strassen(a[i:i + TILE_ROWS], np.ascontiguousarray(c[j:j + TILE_COLUMNS].T))


def _sides(anchors: pa.Table, rows: pa.Table, dim: int):
    """Rows in the order of their ids (nulls last), and both sides' labels and integer vectors."""
    rows = rows.sort_by([("vec_id", "ascending")])
    long = [t[n].to_numpy() for t in (anchors, rows) for n in ("rid", "label")]
    return rows, *long, integers(anchors["v"], dim), integers(rows["v"], dim)


def _grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, dim: int):
    """Both sides dealt to the cells (i, j) of the grid by their row numbers, which are unique, so cells are even."""
    most = max(1, SIDE_BYTES // (8 * max(dim, 1)))
    down, across = -(-n_anchors // min(ANCHORS, most)), -(-n_rows // min(CANDIDATES, most))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("i", block(down)).withColumn("j", all_of(across))
    # columns of their own: both sides come from one table, and a cogroup would take equal attributes for one column
    right = rows.select(*(F.col(c).alias(c) for c in rows.columns), block(across).alias("j"), all_of(down).alias("i"))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))


def _first(rows: DataFrame, by: list[str], score: str, vec_id: str, k: int, name: str) -> DataFrame:
    """Merge heaps: the first ``k`` rows of each group (the limit is applied before the shuffle as well)."""
    order = W.partitionBy(*by).orderBy(F.col(score).desc(), F.col(vec_id).asc_nulls_last())
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Hard negatives of the rows whose ``vec_id`` is divisible by ``every``, from columns vec_id, embedding and label.

    A row's score is its inner product with the anchor, on components floor(256 * x) in 64-bit integers; higher scores come
    first, ties by smaller vec_id (null last). An anchor's positives are its first ``positives`` other rows of the same label;
    for each, the first ``negatives`` rows of another label with 80 * positive_score <= 100 * score <= 100 * positive_score are
    returned: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label, a null vector, or a null or non-finite component take no part; a row with a null vec_id is a
    candidate, never an anchor. Repeated rows are rows of their own, as candidates and as anchors (an anchor's repeated row is
    one of its other rows). Vectors of several lengths are padded with zeros; empty ones score 0. Products are modulo 2**64,
    so exact wherever they fit a long. An empty table gives no rows; other columns are left behind.
    """
    spark = vectors.sparkSession
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = stage(vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)
                 .select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"),
                         F.col("label").cast("long").alias("label"), F.col("embedding").alias("v")), "mining-rows")
    chosen = F.col("vec_id") % every == 0
    n = rows.agg(F.count("*").alias("rows"), F.count_if(chosen).alias("anchors"), F.max(F.size("v")).alias("dim")).first()
    if not n["anchors"]:
        return spark.createDataFrame([], _OUT)
    dim = n["dim"]

    def near(anchors: pa.Table, cands: pa.Table) -> pa.Table:
        cands, rid_a, label_a, rid_c, label_c, a, c = _sides(anchors, cands, dim)
        heap = Heap(positives)
        for i, j, s in _tiles(a, c):
            at, to = slice(i, i + s.shape[0]), slice(j, j + s.shape[1])
            heap.push_tile(s, (label_a[at, None] == label_c[None, to]) & (rid_a[at, None] != rid_c[None, to]), i, j)
        row, col = pa.array(heap.row), pa.array(heap.col)
        return pa.table({"rid": anchors["rid"].take(row), "anchor_id": anchors["vec_id"].take(row),
                         "positive_id": cands["vec_id"].take(col), "positive_score": pa.array(heap.score)})

    found = (_grid(rows.where(chosen), rows, n["anchors"], n["rows"], dim)
             .applyInArrow(near, "rid long, anchor_id long, positive_id long, positive_score long"))
    first = _first(found, ["rid"], "positive_score", "positive_id", positives, "nth")
    pairs = first.groupBy("rid").agg(F.collect_list(F.struct("nth", "positive_id", "positive_score")).alias("pairs"))
    opened = stage(rows.where(chosen).join(pairs, "rid"), "mining-windows")
    # positives of no more than these have a window; 80 p <= 100 s is s >= p - floor(p / 5), which cannot overflow
    n_opened = opened.count()
    if not n_opened:
        return spark.createDataFrame([], _OUT)

    def hard(anchors: pa.Table, cands: pa.Table) -> pa.Table:
        cands, _, label_a, _, label_c, a, c = _sides(anchors, cands, dim)
        held = [{p["nth"]: p for p in x} for x in anchors["pairs"].to_pylist()]
        made = []
        high = np.full((len(a), positives), -1, np.int64)
        low = np.zeros((len(a), positives), np.int64)
        for r, x in enumerate(held):
            for nth, p in x.items():
                high[r, nth - 1] = p["positive_score"]
        low[high > 0] = high[high > 0] - high[high > 0] // 5
        heaps = [Heap(negatives) for _ in range(positives)]
        for i, j, s in _tiles(a, c):
            at, to = slice(i, i + s.shape[0]), slice(j, j + s.shape[1])
            other = label_a[at, None] != label_c[None, to]
            for w, heap in enumerate(heaps):
                inside = other & (s <= high[at, w, None]) & (s >= low[at, w, None])
                if inside.any():
                    heap.push_tile(s, inside, i, j)
        for w, heap in enumerate(heaps):
            pos = [held[r][w + 1] for r in heap.row.tolist()]
            row, col = pa.array(heap.row), pa.array(heap.col)
            made.append(pa.table({"rid": anchors["rid"].take(row), "nth": pa.array([w + 1] * len(pos), pa.int32()),
                                  "anchor_id": anchors["vec_id"].take(row),
                                  "positive_id": pa.array([p["positive_id"] for p in pos], pa.int64()),
                                  "negative_id": cands["vec_id"].take(col),
                                  "positive_score": pa.array([p["positive_score"] for p in pos], pa.int64()),
                                  "negative_score": pa.array(heap.score)}))
        return pa.concat_tables(made)

    ddl = ("rid long, nth int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    met = _grid(opened, rows, n_opened, n["rows"], dim).applyInArrow(hard, ddl)
    kept = _first(met, ["rid", "nth"], "negative_score", "negative_id", negatives, "rank")
    return kept.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
                       "negative_score")
