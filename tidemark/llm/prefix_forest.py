"""Nearest neighbours by largest inner product over a forest of hash prefixes.

Each tree gives every vector a string of 64 bits, the signs of its projections; a tree is the sorted array of these strings,
cut into ranges by their first bits. A query descends in every tree to the rows that share its longest prefix, then all trees
ascend together, one bit at a time, until the rows that share the prefix are enough; these are scored exactly. How many are
enough is fitted on a bounded sample of queries, against brute force over the whole index. Vectors get one more component that
makes their norms equal, so that the largest inner product is the smallest angle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, stage, tidy

TREES, BITS = 20, 64
#: Queries of the fit, and the recall it aims at (0.9 is asked for).
SAMPLE, TARGET = 128, 0.955
#: Rows, and queries, of one task's range of a tree; fuller ranges are dealt over several tasks.
RANGE_ROWS, RANGE_QUERIES = 32_768, 8_192


@dataclass(frozen=True)
class Space:
    dim: int
    norm: float   # largest norm of an indexed vector
    trees: int = TREES

    def planes(self) -> np.ndarray:
        return np.random.default_rng(7).normal(size=(self.dim + 1, self.trees * BITS))

    def _codes(self, lifted: np.ndarray) -> np.ndarray:
        bits = (lifted @ self.planes() > 0).reshape(len(lifted), self.trees, 8, 8)
        return np.packbits(bits, axis=3)[..., 0].reshape(len(lifted), self.trees * 8).view(">u8").astype(np.uint64)

    def index_codes(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return self._codes(np.column_stack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))]))

    def query_codes(self, x: np.ndarray) -> np.ndarray:
        return self._codes(np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]))


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of rows with an id and a vector of finite components, not all zero. Single-precision components stay so
    while they travel, which halves every exchange of vectors; tasks compute in double."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    return _matrix(col, dim).astype(np.float64, copy=False)


def _coded(rows: DataFrame, space: Space) -> DataFrame:
    """Rows (vec_id, ids, v) with the codes of the vector as an indexed row and as a query."""
    ddl = f"vec_id long, ids array<long>, v {rows.schema['v'].dataType.simpleString()}, codes array<long>, probes array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column(2), space.dim)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * space.trees),
                                                  pa.array(c.view(np.int64).ravel()))
                         for c in (space.index_codes(x), space.query_codes(x))]
                yield pa.RecordBatch.from_arrays([*b.columns, *lists], names=["vec_id", "ids", "v", "codes", "probes"])
    return rows.select("vec_id", "ids", "v").mapInArrow(tidy(run), ddl)


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def enough(index: DataFrame, queries: DataFrame, space: Space, k: int, target: float) -> float:
    """Rows (counted tree by tree) at which the ascent stops: the least that reaches the target recall on sampled queries."""
    n = queries.count()
    share = int(min(1.0, 2 * SAMPLE / max(n, 1)) * (1 << 20))
    mark = F.pmod(F.xxhash64("vec_id", F.lit("forest sample")), F.lit(1 << 20))
    drawn = queries.where(mark <= share).select(mark.alias("mark"), "vec_id", "v", "probes").collect()  # about 2 * SAMPLE rows
    drawn = sorted(drawn, key=lambda r: (r["mark"], r["vec_id"]))[:SAMPLE]
    if not drawn:
        return 0.0
    q = np.array([r["v"] for r in drawn])
    probes = np.array([r["probes"] for r in drawn], np.int64).view(np.uint64)
    own = np.array([r["vec_id"] for r in drawn])
    out = pa.schema([("q", pa.int64()), ("counts", pa.list_(pa.int64())), ("score", pa.list_(pa.float64())),
                     ("shared", pa.list_(pa.int64()))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(q), BITS + 1), np.int64)
        score, shared = np.full((len(q), 0), 0.0), np.zeros((len(q), 0), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b.column(1), space.dim)
            codes = _matrix(b.column(2), space.trees).view(np.uint64)
            best = np.zeros((len(q), len(x)), np.int64)
            for t in range(space.trees):
                same = _shared_bits(probes[:, t][:, None], codes[:, t][None, :])
                counts += np.bincount((np.arange(len(q))[:, None] * (BITS + 1) + same).ravel(),
                                      minlength=counts.size).reshape(counts.shape)
                best = np.maximum(best, same)
            s = np.where(own[:, None] == b.column(0).to_numpy()[None, :], -np.inf, q @ x.T)
            score, shared = np.column_stack([score, s]), np.column_stack([shared, best])
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, shared = np.take_along_axis(score, top, 1), np.take_along_axis(shared, top, 1)
        yield pa.RecordBatch.from_pydict({"q": np.arange(len(q)), "counts": counts.tolist(), "score": score.tolist(),
                                          "shared": shared.tolist()}, schema=out)

    def gather(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, top = 0, []
        for p in parts:
            for r in p.itertuples():
                counts = counts + np.asarray(r.counts)
                top = sorted([*top, *zip(r.score, r.shared, strict=True)], reverse=True)[:k]
        yield pd.DataFrame({"q": [int(key[0])], "counts": [counts], "score": [[t[0] for t in top]],
                            "shared": [[t[1] for t in top]]})
    ddl = "q long, counts array<long>, score array<double>, shared array<long>"
    got = (index.select("vec_id", "v", "codes").mapInArrow(tidy(probe), ddl).groupBy("q").applyInPandas(gather, ddl)
           .collect())  # SAMPLE rows
    held = np.array([np.cumsum(r["counts"][::-1])[::-1] for r in got], float)  # rows at each level or deeper
    sure = np.array([[np.mean([s >= x for s, v in zip(r["shared"], r["score"], strict=True) if v > -np.inf] or [1])
                      for x in range(BITS + 1)] for r in got])
    for m in np.unique(held):
        level = (held >= m).cumsum(1).argmax(1)  # deepest level with m rows: counts fall with depth
        if sure[np.arange(len(got)), level].mean() >= target:
            return float(m)
    return float(held.max())


def _prefix(code: Column, bits: int) -> Column:
    """The first ``bits`` bits; two shifts, as a shift by the whole width would be none."""
    return F.shiftrightunsigned(F.shiftrightunsigned(code, 1), BITS - 1 - bits)


def search(vectors: DataFrame, every: int = 20, k: int = 20, trees: int = TREES, target: float = TARGET,
           range_rows: int = RANGE_ROWS, range_queries: int = RANGE_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` its ``k`` nearest other rows found.

    score is the inner product in double precision; ties go to the smaller vec_id. Vectors that are null, zero or hold a null
    or non-finite component take no part, nor do those of another length than most. Equal vectors are indexed once, with
    their k + 1 least ids, which is all that can be returned of them. Rows with the same id as the query are its own. An
    empty table gives no rows; extra columns are left behind.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = stage(_usable(vectors), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(sizes["dim"])
    rows = rows.where(F.size("v") == dim)
    space = Space(dim, float(rows.agg(F.max(norm)).first()[0]), trees)
    # The least ids of each distinct vector; the rank limit is applied before the shuffle too.
    least = (rows.distinct().withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
             .groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    index = stage(_coded(least, space), "forest")
    asked = stage(_coded(rows.where(F.col("vec_id") % every == 0).distinct().withColumn("ids", F.array("vec_id")), space), "queries")
    m = enough(index, asked, space, k, target)
    n = index.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / range_rows))))  # bits of a range

    def by_tree(df: DataFrame, codes: str, *cols: str) -> DataFrame:
        return df.select(*cols, F.posexplode(codes).alias("tree", "code")).withColumn("prefix", _prefix(F.col("code"), depth))

    entries = by_tree(index, "codes", "vec_id", "ids", "v")
    probes = by_tree(asked, "probes", "vec_id", "v").withColumnRenamed("vec_id", "query_id")
    ranges = stage(entries.groupBy("tree", "prefix").agg(F.count("*").alias("rows")), "ranges")
    level = _levels(entries, probes, ranges, depth, m, range_rows, range_queries)
    # A query visits the ranges that share its prefix of the level reached (one, where that is deep enough).
    near = probes.join(level, "query_id").where(F.col("level") >= depth).select("tree", "prefix", "query_id", "code", "v", "level")
    if depth:
        wide = ranges.select("tree", "prefix", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level"))
        wide = wide.withColumn("top", F.expr(f"shiftrightunsigned(prefix, {depth} - level)"))
        far = (probes.join(level, "query_id").where(F.col("level") < depth)
               .withColumn("top", F.expr(f"shiftrightunsigned(prefix, {depth} - level)")).drop("prefix")
               .join(wide, ["tree", "level", "top"]).select("tree", "prefix", "query_id", "code", "v", "level"))
        near = near.union(far)
    near = stage(near, "routes")
    found = _visit(entries, near, ranges, dim, k, range_rows, range_queries)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _dealt(entries: DataFrame, routed: DataFrame, ranges: DataFrame, range_rows: int, range_queries: int) -> tuple[DataFrame, DataFrame]:
    """Entries and queries keyed by range, share of its rows and share of its queries: every pair of shares meets once."""
    asked = routed.groupBy("tree", "prefix").agg(F.count("*").alias("queries"))
    share = (ranges.join(asked, ["tree", "prefix"])
             .select("tree", "prefix", F.ceil(F.col("rows") / range_rows).cast("int").alias("row_shares"),
                     F.ceil(F.col("queries") / range_queries).cast("int").alias("query_shares")))
    left = (entries.join(share, ["tree", "prefix"]).withColumn("a", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("row_shares")).cast("int"))
            .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("query_shares") - 1))).drop("row_shares", "query_shares"))
    right = (routed.join(share, ["tree", "prefix"]).withColumn("b", F.pmod(F.xxhash64("query_id", F.lit(2)), F.col("query_shares")).cast("int"))
             .withColumn("a", F.explode(F.sequence(F.lit(0), F.col("row_shares") - 1))).drop("row_shares", "query_shares"))
    return left, right


def _interval(codes: np.ndarray, code: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds, in the sorted codes, of those that share the first ``level`` bits of each code."""
    keep = np.where(level > 0, ~np.uint64(0) << (np.uint64(BITS) - np.maximum(level, 1).astype(np.uint64)), np.uint64(0))
    low = code & keep
    return np.searchsorted(codes, low, "left"), np.searchsorted(codes, low | ~keep, "right")


KEYS = ["tree", "prefix", "a", "b"]


def _levels(entries: DataFrame, probes: DataFrame, ranges: DataFrame, depth: int, m: float, range_rows: int,
            range_queries: int) -> DataFrame:
    """(query_id, level): the deepest level at which the trees together hold ``m`` rows that share the query's prefix."""
    left, right = _dealt(entries.select("vec_id", "tree", "prefix", "code"), probes.select("query_id", "tree", "prefix", "code"),
                         ranges, range_rows, range_queries)

    def count(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        codes = np.sort(rows["code"].to_numpy().view(np.uint64))
        code = asked["code"].to_numpy().view(np.uint64)
        held = []
        for x in range(depth, BITS + 1):
            lo, hi = _interval(codes, code, np.full(len(code), x))
            held.append(hi - lo)
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy(),
                             "held": pd.Series(list(np.array(held).T.astype(np.int64)), dtype=object)})
    deep = (left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInPandas(count, "query_id long, held array<long>")
            .select("query_id", F.posexplode("held").alias("level", "held"))
            .select("query_id", (F.col("level") + depth).alias("level"), "held"))
    if depth:
        up = F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level")
        top = F.expr(f"shiftrightunsigned(prefix, {depth} - level)")
        coarse = (ranges.select("tree", "prefix", "rows", up).withColumn("top", top).groupBy("tree", "level", "top")
                  .agg(F.sum("rows").alias("held")))
        deep = deep.union(probes.select("query_id", "tree", "prefix", up).withColumn("top", top)
                          .join(coarse, ["tree", "level", "top"]).select("query_id", "level", "held"))
    held = deep.groupBy("query_id", "level").agg(F.sum("held").alias("held"))
    return (held.groupBy("query_id")
            .agg(F.coalesce(F.max(F.when(F.col("held") >= m, F.col("level"))), F.lit(0)).alias("level")))


def _products(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products, each the same whatever rows stand beside it; scaled where a term or partial sum would overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = (x * v).sum(1)
        if not (wide := ~np.isfinite(s)).any():
            return s
        up = np.frexp(np.abs(x[wide]).max(1))[1]
        uv = np.frexp(np.abs(v).max())[1]
        s[wide] = np.ldexp((np.ldexp(x[wide], -up[:, None]) * np.ldexp(v, -uv)).sum(1), up + uv)
    return s


def _contenders(got: np.ndarray, sizes: np.ndarray, dim: int, k: int, at: np.ndarray) -> np.ndarray:
    """Places in ``at`` of all that may be among its ``k`` largest products, ties included, given products in any order of sums.

    ``sizes`` holds the products of the norms. Two sums of the same ``dim`` terms differ by at most 2 dim u / (1 - dim u) times
    that (u = eps / 2), and by what terms lose below the least normal number; the bound taken is over twice that.
    """
    got, off = got[at], (2 * dim + 8) * (np.finfo(float).eps * sizes[at] + np.finfo(float).tiny)
    if not (np.isfinite(got).all() and np.isfinite(off).all()):
        return np.arange(len(at))
    low = got - off
    return np.flatnonzero(got + off >= low[np.argpartition(-low, k - 1)[k - 1]])


def _visit(entries: DataFrame, routed: DataFrame, ranges: DataFrame, dim: int, k: int, range_rows: int,
           range_queries: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest rows of each visited share of a range."""
    left, right = _dealt(entries, routed, ranges, range_rows, range_queries)

    def score(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        codes = rows["code"].to_numpy().view(np.uint64)
        order = np.argsort(codes, kind="stable")
        x = np.stack(rows["v"].to_numpy()[order]).astype(np.float64, copy=False)
        ids = rows["ids"].to_numpy()[order]
        first = np.array([i[0] for i in ids], np.int64)
        lone = np.array([len(i) == 1 for i in ids])
        second = np.array([i[min(1, len(i) - 1)] for i in ids], np.int64)
        size = np.sqrt((x * x).sum(1))
        lo, hi = _interval(codes[order], asked["code"].to_numpy().view(np.uint64), asked["level"].to_numpy())
        out_q, out_v, out_s = [], [], []
        for q, v, a, b in zip(asked["query_id"].to_numpy(), asked["v"], lo, hi, strict=True):
            if a == b:
                continue
            v = v.astype(np.float64, copy=False)
            at = a + np.flatnonzero(~(lone[a:b] & (first[a:b] == q)))  # without the query's own rows
            if len(at) > k:
                at = at[_contenders(x[a:b] @ v, size[a:b] * np.sqrt(v @ v), dim, k, at - a)]
            exact = _products(x[at], v)
            # Of k rows in the order of their best entries come the k best entries.
            at, exact = (z[np.lexsort((np.where(first[at] == q, second[at], first[at]), -exact))[:k]] for z in (at, exact))
            each = [(-s, int(i)) for s, j in zip(exact.tolist(), at, strict=True) for i in ids[j] if i != q]
            each.sort()
            out_q += [q] * len(each[:k])
            out_v += [i for _, i in each[:k]]
            out_s += [-s for s, _ in each[:k]]
        return pd.DataFrame({"query_id": out_q, "vec_id": out_v, "score": out_s})
    return (left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS))
            .applyInPandas(score, "query_id long, vec_id long, score double"))
