"""N-gram Jaccard self-join by MinHash banding.

Texts with the same n-gram set form one class, so copies cost one row. Band and row counts follow from the target recall at
the threshold. Classes that share a band hash are tied to the least class of the bucket, and the components of these ties
say which classes may be similar; a component's n-gram sets are verified together, a large one in pairs of blocks or, where
that ships fewer sets, bucket by bucket (a long chain of texts that have little in common), so no task sees more than two
blocks and no pair is ever written out: a task returns each class's number of links and one tie per class that spans the
links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, slices, stage, texts_of, tidy
from tidemark.llm.components import connected_components
from tidemark.llm.rolling import prefix_sums, range_hashes

WORDS, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.9999, 256
#: Classes, and n-grams, that one side of a verification task holds, or a few more.
BLOCK, BLOCK_GRAMS = 512, 1 << 18
#: Columns of the set matrix that are multiplied at once.
COLUMNS = 2048

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_GRAM_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, whose bands reach the recall at the threshold."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def gram_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, in one array, and the texts' bounds in it.

    Words are runs without ASCII white space, in lower case; a text of fewer words is one n-gram of all its words, a text
    without words has none.
    """
    data = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    ends = np.cumsum([len(d) + 1 for d in data])
    space = _SPACE[raw]
    start = np.flatnonzero(~space & np.append(True, space[:-1]))
    stop = np.flatnonzero(space & np.append(False, ~space[:-1]))
    bounds = [0]
    out = []
    if len(start):
        hashed = mix(range_hashes(prefix_sums(raw), start, stop) ^ (stop - start).astype(np.uint64))
        factor = [np.uint64(pow(_GRAM_BASE, j, 1 << 64)) for j in range(words)]
    last = np.searchsorted(start, ends)
    first = 0
    for b in last:
        w = hashed[first:b] if b > first else None
        if w is not None:
            k = min(words, len(w))
            g = np.full(len(w) - k + 1, k, np.uint64)
            for j in range(k):
                g = g + w[j:len(w) - k + 1 + j] * factor[j]
            out.append(np.unique(mix(g)))
        bounds.append(bounds[-1] + (len(out[-1]) if w is not None else 0))
        first = b
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(bounds)


def signatures(grams: np.ndarray, bounds: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash signatures, texts by hashes; texts without n-grams have all ones."""
    sig = np.full((len(bounds) - 1, hashes), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        x = (grams >> np.uint64(32)).astype(np.uint32)
        rng = np.random.default_rng(5)
        a = rng.integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        b = rng.integers(0, 1 << 32, hashes, dtype=np.uint64).astype(np.uint32)
        for k in range(hashes):
            sig[full, k] = np.minimum.reduceat((x * a[k]) ^ b[k], bounds[:-1][full])
    return sig


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        out = mix(out + sig[:, r::rows][:, :bands].astype(np.uint64) + np.uint64(r + 1))
    return out.view(np.int64)


_SIG = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()),
                  ("bands", pa.list_(pa.int64()))])


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id and mark of each row, size and key of its n-gram set, band hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                grams, bounds = gram_sets(part.column(1).to_pylist(), words)
                got = band_hashes(signatures(grams, bounds, bands * rows), bands, rows)
                sums = [np.append(np.uint64(0), np.cumsum(mix(grams + np.uint64(c)))) for c in (1, 2)]
                k1, k2 = ((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.diff(bounds)), pa.array(k1), pa.array(k2),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * bands), pa.array(got.ravel()))],
                    schema=_SIG)
    return docs.select("doc_id", "text", "mark").mapInArrow(tidy(run), "doc_id long, mark long, n long, key1 long, key2 long, bands array<long>")


def _linked(sets: list[np.ndarray], sizes: np.ndarray, sides: np.ndarray | None, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, as a symmetric matrix; only pairs of both sides, where sides are given."""
    g = len(sets)
    inter = np.zeros((g, g), np.float32)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(g), sizes)
    order = np.argsort(values)
    values, owner = values[order], owner[order]
    new = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((g, COLUMNS), np.float32)
        x[owner[a:b], column[a:b] - at] = 1
        inter += x @ x.T
    linked = np.zeros((g, g), bool)
    for at in range(0, g, 128):
        part = inter[at:at + 128].astype(np.float64)
        linked[at:at + 128] = part >= threshold * (sizes[at:at + 128, None] + sizes[None, :] - part) - 1e-9
    np.fill_diagonal(linked, False)
    if sides is not None:
        linked &= sides[:, None] != sides[None, :]
    return linked


#: What is verified together: two blocks of a component (band and bucket -1), or of one bucket of it.
JOB = ["comp", "band", "bucket", "low", "high"]
_LINK = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """Links inside each job; rows (JOB, cross, side, cid, n, copies, bands, grams), sorted by job within partitions.

    Two classes that share several buckets are linked in the first of them alone.
    """
    def job(parts: list[pa.Table]) -> dict:
        t = pa.concat_tables(parts)
        cid, at = np.unique(t["cid"].to_numpy(), return_index=True)
        sizes, copies, sides = (t[c].to_numpy()[at] for c in ("n", "copies", "side"))
        grams = t["grams"]
        linked = _linked([np.frombuffer(grams[int(i)].as_buffer(), np.uint64) for i in at], sizes,
                         sides if t["cross"][0].as_py() else None, threshold)
        band = t["band"][0].as_py()
        if band >= 0:
            bands = np.stack([t["bands"][int(i)].values.to_numpy() for i in at])
            for i, row in enumerate(linked):
                others = np.flatnonzero(row)
                row[others] = (bands[others] == bands[i]).argmax(1) == band
        label = np.arange(len(cid))
        while True:  # the least place reachable by links
            least = np.array([label[row].min(initial=len(cid)) for row in linked])
            now = np.minimum(label, least)
            now = now[now]
            if (now == label).all():
                break
            label = now
        some = np.flatnonzero(linked.any(1))
        return {"cid": cid[some], "links": linked[some] @ copies, "root": cid[label[some]]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            jobs = np.column_stack([t[c].to_numpy() for c in JOB])
            edge = np.flatnonzero(np.append(True, (jobs[1:] != jobs[:-1]).any(1)))
            for a, b in zip(edge, np.append(edge[1:], len(jobs)), strict=True):
                if held and (jobs[a] != now).any():
                    yield pa.RecordBatch.from_pydict(job(held), schema=_LINK)
                    held = []
                held.append(t.slice(a, b - a))
                now = jobs[a]
        if held:
            yield pa.RecordBatch.from_pydict(job(held), schema=_LINK)
    return rows.mapInArrow(tidy(run), "cid long, links long, root long")


def _jobs(classes: DataFrame, comp: DataFrame) -> DataFrame:
    """cid, comp, jobs (band, bucket, blocks) and, for jobs in buckets, bands of each class of a component (node, component).

    A component of B blocks ships each set B times. Where its buckets ship fewer sets, its classes meet in the buckets that they
    share, at most one job per band, so the cost of a component grows with its classes and not with their square.
    """
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS)).cast("long").alias("blocks")
    member = classes.join(comp, F.col("cid") == F.col("node")).select("cid", "n", "bands", F.col("component").alias("comp"))
    sized = stage(member.groupBy("comp").agg(F.count("*").alias("classes"), blocks), "components")
    large = member.join(sized.where("blocks > 1").select("comp"), "comp", "left_semi")
    placed = large.select("cid", "n", "comp", F.posexplode("bands").alias("band", "h"))
    buckets = stage(placed.groupBy("comp", "band", "h").agg(F.count("*").alias("classes"), blocks).where("classes > 1")
                    .withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    shipped = buckets.groupBy("comp").agg(F.sum(F.col("classes") * F.col("blocks")).alias("shipped"))
    split = sized.join(shipped, "comp").where("shipped < classes * blocks").select("comp")
    whole = (member.join(sized.join(split, "comp", "left_anti").select("comp", "blocks"), "comp")
             .select("cid", "comp", F.array(F.struct(F.lit(-1).cast("long").alias("band"), F.lit(-1).cast("long").alias("bucket"),
                                                     "blocks")).alias("jobs"),
                     F.lit(None).cast("array<long>").alias("bands")))
    job = F.struct(F.col("band").cast("long").alias("band"), "bucket", "blocks")
    parts = (placed.join(split, "comp", "left_semi").join(buckets.drop("classes"), ["comp", "band", "h"])
             .groupBy("cid", "comp").agg(F.collect_list(job).alias("jobs"))  # one per band at most
             .join(classes.select("cid", "bands"), "cid"))
    return whole.unionByName(parts)


_CARRIED = {"cid": pa.int64(), "n": pa.int64(), "copies": pa.int64(), "comp": pa.int64(),
            "jobs": pa.list_(pa.struct([("band", pa.int64()), ("bucket", pa.int64()), ("blocks", pa.int64())])),
            "bands": pa.list_(pa.int64())}


def _grams(docs: DataFrame, words: int) -> DataFrame:
    """cid, n, copies, job columns and the n-gram set of rows that carry a text."""
    out = pa.schema([*_CARRIED.items(), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                grams, bounds = gram_sets(part.column(0).to_pylist(), words)
                raw = [grams[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                kept = [part.column(i + 1).cast(kind) for i, kind in enumerate(_CARRIED.values())]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(raw, pa.binary())], schema=out)
    return (docs.select("text", *_CARRIED)
            .mapInArrow(tidy(run), "cid long, n long, copies long, comp long, "
                        "jobs array<struct<band: long, bucket: long, blocks: long>>, bands array<long>, grams binary"))


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, set_id, set_size, n_links, n_grams, group_key, mark.

    n_links counts the other documents whose n-gram sets have a Jaccard similarity of ``threshold`` or more, copies
    included; class_id is the least doc_id among the documents linked directly or over others, set_id the least doc_id with
    the same set, set_size the number of documents with it, n_grams the set's size. group_key is the same for the documents of
    a class (null without words), mark the hash that tells texts of one doc_id apart. Documents without words link to none and
    are their own class.
    Repeated rows count as copies; a null id is never the least unless alone (class null). Null texts count as empty; an
    empty table gives no rows; extra columns are left behind.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    bands, rows = bands_for(threshold, recall)
    base = texts_of(docs).withColumn("mark", F.xxhash64("text"))
    signed = stage(_signed(base, words, bands, rows), "signatures")
    classes = stage(signed.where("n > 0").groupBy("key1", "key2", "n")
                    .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("least"),
                         F.count("*").alias("copies"), F.first("bands").alias("bands"))
                    .select("key1", "key2", "n", F.col("least.doc_id").alias("set_id"), F.col("least.mark").alias("mark"),
                            "copies", "bands", F.monotonically_increasing_id().alias("cid")), "classes")
    keyed = classes.select("cid", F.posexplode("bands").alias("band", "h"))
    bucket = keyed.groupBy("band", "h").agg(F.min("cid").alias("root"), F.max("cid").alias("top")).where("root <> top")
    ties = keyed.join(bucket, ["band", "h"]).where("cid <> root").select(F.col("cid").alias("src"), F.col("root").alias("dst"))
    comp = stage(connected_components(stage(ties.distinct(), "ties"), name="candidates"), "candidates")
    # One text per candidate class: that of its least document.
    wanted = _jobs(classes, comp).join(
        classes.select("cid", "n", "copies", F.col("set_id").alias("want"), F.col("mark").alias("wanted_mark")), "cid")
    texts = wanted.join(base, F.col("want").eqNullSafe(F.col("doc_id")) & (F.col("wanted_mark") == F.col("mark")))
    sets = _grams(texts, words).withColumn("job", F.explode("jobs")).select("*", "job.*")
    pairs = (sets.withColumn("block", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("comp", "band", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                     (F.col("block") != F.col("other")).alias("cross"),
                     (F.col("block") > F.col("other")).cast("int").alias("side"), "cid", "n", "copies", "bands", "grams"))
    links = stage(_verify(pairs.repartition(*map(F.col, JOB)).sortWithinPartitions(*JOB), threshold), "links")
    tied = connected_components(links.select(F.col("cid").alias("src"), F.col("root").alias("dst")), name="linked")
    near = (links.groupBy("cid").agg(F.sum("links").alias("links")).join(tied, F.col("cid") == F.col("node"))
            .select("cid", "links", "component"))
    named = classes.select("cid", "set_id", "copies", "key1", "key2", "n").join(near, "cid", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("set_id").alias("class_id"))
    info = (named.join(least, "component", "left")
            .select("key1", "key2", "n", "set_id", F.coalesce("class_id", "set_id").alias("class_id"),
                    F.coalesce("component", "cid").alias("group_key"),
                    F.col("copies").alias("set_size"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return (signed.select("doc_id", "mark", "n", "key1", "key2").join(info, ["key1", "key2", "n"], "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("set_id", "doc_id").alias("set_id"),
                    F.coalesce("set_size", F.lit(1).cast("long")).alias("set_size"),
                    F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.col("n").alias("n_grams"), "group_key",
                    "mark"))
