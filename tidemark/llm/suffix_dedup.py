"""Removal of long repeated byte strings by merging shard Burrows-Wheeler transforms.

A string of ``LENGTH`` bytes is read as ``LENGTH / STEP`` symbols, each the hash of ``STEP`` bytes. A shard's transform holds,
level by level from the last symbol to the first, the symbols that precede its sorted suffixes. Shards are merged by refining
an interleave: each round puts the merged suffixes in the order of the symbol before them, keeps ties in the order so far,
and splits the blocks whose symbols differ. No suffix is sorted anew; after the last round a block is a set of strings with
equal symbols, and what is equal byte by byte in it (common prefix at least LENGTH) is a repeated interval.

Only text that may repeat gets that far. Every window of LENGTH bytes has an anchor, its least hash of ``GRAM`` bytes; equal
windows have equal anchors, so text whose anchor occurs once is unique. The windows of an anchor form a segment; segments
with equal bytes repeat in whole and travel once; the others meet by anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, slices, stage, texts_of, tidy
from tidemark.llm.rolling import BASE, byte_table

LENGTH, STEP, GRAM = 200, 50, 25
#: Bytes of text hashed at once; longer texts are taken in overlapping parts.
PART = 1 << 19
#: Bytes of segments merged at once; an anchor with more is dealt out window by window instead.
GROUP_BYTES, SHARD_BYTES = 2 << 20, 1 << 19
#: Strings compared byte by byte at once.
CHECKED = 1 << 14
#: Segments a task remembers having sent.
SENT = 1 << 18

_LOW = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def gram_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each place, by doubling."""
    n, size, out, have = len(raw), 1, None, 0
    if n < width:
        return np.zeros(0, np.uint64)
    h = byte_table()[raw]
    while True:
        shift = np.uint64(pow(BASE, size, 1 << 64))
        if width & size:
            m = n - have - size + 1
            out = h if out is None else out[:m] * shift + h[have:have + m]
            have += size
        if have == width:
            return out
        h = h[:-size] * shift + h[size:]
        size *= 2


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each place."""
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    rest = width - size
    return np.minimum(v[:len(v) - rest], v[rest:]) if rest else v


class Parts:
    """Bytes of many texts side by side, and the anchors of their windows.

    ``doc``, ``lo`` (first window's place in its text), ``at`` (the same in ``raw``), ``windows`` and ``fp`` (anchor) have an
    entry per segment.
    """

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        doc, base, pieces = [], [], []
        for d, t in enumerate(texts):
            for a in range(0, max(1, len(t) - length + 1), PART):
                if len(t) - a >= length:
                    doc.append(d)
                    base.append(a)
                    pieces.append(t[a:a + PART + length - 1])
        self.raw = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        begin = np.cumsum(sizes) - sizes
        self.doc = self.lo = self.at = self.windows = np.zeros(0, np.int64)
        self.fp = np.zeros(0, np.uint64)
        out = []
        # parts are hashed together, at most so many bytes that a place fits the low bits
        first = 0
        while first < len(pieces):
            last = int(np.searchsorted(begin + sizes, begin[first] + 2 * PART, "right"))
            last = max(last, first + 1)
            out.append(self._anchors(begin[first:last], sizes[first:last], np.array(doc[first:last]),
                                     np.array(base[first:last]), length, gram))
            first = last
        if out:
            self.doc, self.lo, self.at, self.windows, self.fp = (np.concatenate(c) for c in zip(*out, strict=True))

    def _anchors(self, begin, sizes, doc, base, length, gram):
        off, end = int(begin[0]), int(begin[-1] + sizes[-1])
        raw = self.raw[off:end]
        h = _mix(gram_hashes(raw, gram))
        v = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        anchor = (_sliding_least(v, length - gram + 1) & _LOW).astype(np.int64)
        piece = np.repeat(np.arange(len(sizes)), sizes)[:len(anchor)]
        valid = np.arange(len(anchor)) + length <= (begin - off + sizes)[piece]
        s = np.flatnonzero(valid)
        a, p = anchor[s], piece[s]
        new = np.append(True, (a[1:] != a[:-1]) | (p[1:] != p[:-1]))
        at = s[new]
        windows = np.diff(np.append(np.flatnonzero(new), len(s)))
        return doc[p[new]], at - (begin - off)[p[new]] + base[p[new]], at + off, windows, h[a[new]]

    def bytes_of(self, i: int, length: int = LENGTH) -> bytes:
        return self.raw[self.at[i]:self.at[i] + self.windows[i] + length - 1].tobytes()


def _stable_order(symbols: np.ndarray) -> np.ndarray:
    """Places in the order of 32-bit symbols, ties as they stand."""
    return (np.sort((symbols.astype(np.uint64) << np.uint64(32)) | np.arange(len(symbols), dtype=np.uint64))
            & np.uint64(0xFFFFFFFF)).astype(np.int64)


class ShardBWT:
    """Transform of the windows of some segments: ``bwt[r]`` are the symbols before the suffixes in the order of round r."""

    def __init__(self, segments: list[bytes], windows: np.ndarray, length: int = LENGTH, step: int = STEP):
        raw = np.frombuffer(b"".join(segments), np.uint8)
        sizes = np.array([len(s) for s in segments], np.int64)
        symbol = (_mix(gram_hashes(raw, step)) >> np.uint64(32)).astype(np.uint32)
        n = int(windows.sum())
        self.segment = np.repeat(np.arange(len(segments)), windows)
        self.place = np.arange(n) - np.repeat(np.cumsum(windows) - windows, windows)
        at = self.place + np.repeat(np.cumsum(sizes) - sizes, windows)
        self.order, self.bwt = np.arange(n), []
        for level in range(length // step - 1, -1, -1):
            self.bwt.append(symbol[at[self.order] + level * step])
            self.order = self.order[_stable_order(self.bwt[-1])]


def merge(shards: list[ShardBWT]) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, block): the shard of each merged suffix, and its block of equal strings."""
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s.order) for s in shards])
    block = np.zeros(len(z), np.int64)
    for r in range(len(shards[0].bwt)):
        before = np.empty(len(z), np.uint32)
        before[np.argsort(z, kind="stable")] = np.concatenate([s.bwt[r] for s in shards])
        order = _stable_order(before)
        z, before, block = z[order], before[order], block[order]
        split = (before[1:] != before[:-1]) | (block[1:] != block[:-1])
        block = np.append(0, np.cumsum(split)) if len(z) else block
    return z, block


def _same_bytes(raw: np.ndarray, at: np.ndarray, block: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """Of the suffixes in blocks of several, those that really equal another one of their block in their first ``length`` bytes.

    Symbols are hashes, so a block is compared byte by byte with its first suffix; a block in which that finds a difference,
    which takes a collision, is split by its bytes.
    """
    i = np.flatnonzero(many)
    if not len(i):
        return many
    starts = np.append(True, block[i][1:] != block[i][:-1])
    head = np.maximum.accumulate(np.where(starts, np.arange(len(i)), 0))
    view = np.lib.stride_tricks.sliding_window_view(raw, length)
    differs = np.zeros(len(i), bool)
    for a in range(0, len(i), CHECKED):
        part = slice(a, a + CHECKED)
        differs[part] = (view[at[i[part]]] != view[at[i[head[part]]]]).any(1)
    out = many.copy()
    for b in np.unique(block[i][differs]).tolist():
        held = i[np.searchsorted(block[i], b):np.searchsorted(block[i], b, "right")]
        kinds: dict[bytes, list[int]] = {}
        for x in held.tolist():
            kinds.setdefault(view[at[x]].tobytes(), []).append(x)
        out[[x for same in kinds.values() if len(same) == 1 for x in same]] = False
    return out


def repeated_windows(segments: list[bytes], windows: np.ndarray, length: int = LENGTH, step: int = STEP) -> list[np.ndarray]:
    """For each segment, which of its windows equal a window of another place."""
    sizes = np.cumsum([len(s) for s in segments])
    cuts = [0, *np.searchsorted(sizes, np.arange(SHARD_BYTES, sizes[-1], SHARD_BYTES)).tolist(), len(segments)]
    cuts = sorted(set(cuts))
    shards = [ShardBWT(segments[a:b], windows[a:b], length, step) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    z, block = merge(shards)
    many = np.bincount(block)[block] > 1
    at, first_byte = [], 0  # place of each merged suffix in the joined segments
    for k, s in enumerate(shards):
        held = segments[cuts[k]:cuts[k + 1]]
        lengths = np.array([len(x) for x in held], np.int64)
        begin = np.cumsum(lengths) - lengths + first_byte
        at.append((s.place + begin[s.segment])[s.order])
        first_byte += int(lengths.sum())
    place = np.empty(len(z), np.int64)
    place[np.argsort(z, kind="stable")] = np.concatenate(at)
    many = _same_bytes(np.frombuffer(b"".join(segments), np.uint8), place, block, many, length)
    out: list[np.ndarray] = []
    for k, s in enumerate(shards):
        hit = np.zeros(len(s.order), bool)
        hit[s.order] = many[z == k]
        out += np.split(hit, np.cumsum(windows[cuts[k]:cuts[k + 1]])[:-1])
    return out


def _runs(hit: np.ndarray) -> list[int]:
    """Start and end of each run of true values, in turn."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.tolist()


_ANCHOR = pa.schema([("fp", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64())])
_SEGMENT = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("lo", pa.int64()), ("windows", pa.int64()),
                      ("fp", pa.int64()), ("seg", pa.int64()), ("bytes", pa.binary())])
_HIT = pa.schema([("fp", pa.int64()), ("seg", pa.int64()), ("runs", pa.list_(pa.int64()))])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                  ("kept", pa.binary())])


def _utf8(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _anchors(base: DataFrame, length: int) -> DataFrame:
    """(fp, doc_id, mark, n): how often each anchor occurs in each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                p = Parts(_utf8(part.column(1).to_pylist()), length)
                order = np.lexsort((p.fp, p.doc))
                fp, doc = p.fp[order], p.doc[order]
                new = np.append(True, (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])) if len(fp) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                at = pa.array(doc[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[first].view(np.int64)), part.column(0).take(at), part.column(2).take(at),
                     pa.array(np.diff(np.append(first, len(fp))))], schema=_ANCHOR)
    return base.select("doc_id", "text", "mark").mapInArrow(tidy(run), "fp long, doc_id long, mark long, n long")


def _segments(rows: DataFrame, length: int) -> DataFrame:
    """Segments of rows (doc_id, text, mark, fps) whose anchor is among fps; bytes with the first of its kind in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text", PART):
                p = Parts(_utf8(part.column(1).to_pylist()), length)
                wanted = np.unique(part.column(3).flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
                at = np.flatnonzero(np.isin(p.fp, wanted))
                if len(sent) > SENT:
                    sent.clear()
                held = [p.bytes_of(i, length) for i in at.tolist()]
                digests = b"".join(hashlib.blake2b(x, digest_size=8).digest() for x in held)
                fp, seg = p.fp[at].view(np.int64), np.frombuffer(digests, np.int64)
                raw: list[bytes | None] = []
                for x, key in zip(held, zip(fp.tolist(), seg.tolist(), strict=True), strict=True):
                    raw.append(None if key in sent else x)
                    sent.add(key)
                d = pa.array(p.doc[at])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(d), part.column(2).take(d), pa.array(p.lo[at]), pa.array(p.windows[at]),
                     pa.array(fp), pa.array(seg), pa.array(raw, pa.binary())], schema=_SEGMENT)
    return rows.select("doc_id", "text", "mark", "fps").mapInArrow(tidy(run), "doc_id long, mark long, lo long, windows long, fp long, seg long, bytes binary")


def _met(segments: DataFrame, length: int, step: int) -> DataFrame:
    """(fp, seg, runs) of segments with a repeated window; rows (fp, seg, windows, bytes) sorted by fp, seg in partitions."""
    def found(held: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(held)
        fp, seg = t["fp"].to_numpy(), t["seg"].to_numpy()
        first = np.flatnonzero(np.append(True, (fp[1:] != fp[:-1]) | (seg[1:] != seg[:-1])))
        t = t.take(pa.array(first))
        windows = t["windows"].to_numpy()
        hits = repeated_windows(t["bytes"].to_pylist(), windows, length, step)
        some = [i for i, h in enumerate(hits) if h.any()]
        at = pa.array(some, pa.int64())
        return pa.RecordBatch.from_arrays([t["fp"].take(at).combine_chunks(), t["seg"].take(at).combine_chunks(),
                                           pa.array([_runs(hits[i]) for i in some], pa.list_(pa.int64()))], schema=_HIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:  # whole anchors are merged together, as many as fit
            t = pa.Table.from_batches([batch])
            fp = t["fp"].to_numpy()
            sizes = np.cumsum(pa.compute.binary_length(t["bytes"]).to_numpy())
            edge = [0, *(np.flatnonzero(fp[1:] != fp[:-1]) + 1).tolist(), len(fp)]
            last = held[-1]["fp"][-1].as_py() if held else None
            start, done = 0, 0
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if size + (int(sizes[a - 1]) if a else 0) - done > GROUP_BYTES and (a > start or held) \
                        and not (a == 0 and fp[0] == last):
                    if a > start:
                        held.append(t.slice(start, a - start))
                    yield found(held)
                    held, size, start, done = [], 0, a, int(sizes[a - 1]) if a else 0
            if start < len(fp):
                held.append(t.slice(start))
                size += int(sizes[-1]) - done
        if held:
            yield found(held)
    return segments.mapInArrow(tidy(run), "fp long, seg long, runs array<long>")


def _window_hashes(segments: DataFrame, length: int) -> DataFrame:
    """(fp, seg, place, h1, h2) of every window of segments, for anchors too frequent to meet in one task."""
    out = pa.schema([("fp", pa.int64()), ("seg", pa.int64()), ("place", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, seg, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                h = _mix(gram_hashes(np.frombuffer(raw, np.uint8), length))
                g = _mix(gram_hashes(np.frombuffer(raw, np.uint8)[::-1].copy(), length)[::-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, fp)), pa.array(np.full(n, seg)), pa.array(np.arange(n)),
                                                  pa.array(h.view(np.int64)), pa.array(g.copy().view(np.int64))], schema=out)
    return (segments.select("fp", "seg", "windows", "bytes")
            .mapInArrow(tidy(run), "fp long, seg long, place long, h1 long, h2 long"))


def _cut(rows: DataFrame, length: int, keep: list[str], as_text: bool) -> DataFrame:
    """Texts (doc_id, text, spans of (lo, hi) window places) without the bytes their repeated windows cover."""
    rows = rows.select("doc_id", "text", "spans", *keep)
    ddl = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long", "text string" if as_text else "kept binary",
                     *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[3:])])
    schema = _OUT.set(4, pa.field("text", pa.string())) if as_text else _OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                cols: dict[str, list] = {n: [] for n in schema.names}
                spans = part.column(2)
                lo, hi = (spans.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("lo", "hi"))
                last = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
                first = 0
                for i, (doc_id, text) in enumerate(zip(part.column(0).to_pylist(), _utf8(part.column(1).to_pylist()),
                                                       strict=True)):
                    raw = np.frombuffer(text, np.uint8)
                    a, b = lo[first:last[i]], hi[first:last[i]]
                    first = last[i]
                    edge = np.bincount(a, minlength=len(raw) + 1) - np.bincount(b + length - 1, minlength=len(raw) + 1)
                    gone = np.cumsum(edge[:-1]) > 0
                    left = raw[~gone].tobytes()
                    for n, v in zip(cols, (doc_id, len(raw), int(gone.sum()), len(_runs(gone)) // 2,
                                           left.decode("utf-8", "ignore") if as_text else left), strict=True):
                        cols[n].append(v)
                made = pa.RecordBatch.from_pydict(cols, schema=schema)
                yield pa.RecordBatch.from_arrays([*made.columns, *(part.column(n) for n in keep)], names=[*schema.names, *keep])
    return rows.mapInArrow(tidy(run), ddl)


def remove_repeats(docs: DataFrame, length: int = LENGTH, step: int = STEP, group_bytes: int = GROUP_BYTES,
                   keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), and the ``keep`` columns.
    With ``as_text``, text instead of kept: the whole characters among these bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the texts' UTF-8 bytes, the same
    text included; strings never cross texts. Repeated rows are texts of their own, so each repeats the other. Null texts
    count as empty, and texts shorter than ``length`` stay whole; an empty table gives no rows; extra columns are left behind.
    """
    bounded_batches(docs.sparkSession)
    base = texts_of(docs).withColumn("mark", F.xxhash64("text"))
    long_enough = base.where(F.octet_length("text") >= length)
    anchors = stage(_anchors(long_enough, length), "anchors")
    often = anchors.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").select("fp")
    wanted = anchors.join(often, "fp").groupBy("doc_id", "mark").agg(F.collect_set("fp").alias("fps"))
    same = [F.col("k.doc_id").eqNullSafe(F.col("t.doc_id")), F.col("k.mark") == F.col("t.mark")]
    texts = long_enough.alias("t").join(wanted.alias("k"), same).select("t.doc_id", "t.text", "t.mark", "k.fps")
    seen = stage(_segments(texts, length), "segments")
    sent = seen.where("bytes is not null").select("fp", "seg", "windows", "bytes")
    weight = sent.groupBy("fp").agg(F.sum(F.octet_length("bytes")).alias("size"), F.countDistinct("seg").alias("kinds"))
    # anchors whose segments all have the same bytes are settled by counting them
    mixed = stage(weight.where("kinds > 1"), "mixed-anchors")
    met = _met(sent.join(mixed.where(F.col("size") <= group_bytes).select("fp"), "fp", "left_semi")
               .repartition("fp").sortWithinPartitions("fp", "seg"), length, step)
    hot = (sent.join(mixed.where(F.col("size") > group_bytes).select("fp"), "fp", "left_semi")
           .dropDuplicates(["fp", "seg"]))
    windows = _window_hashes(hot, length)
    twice = windows.groupBy("fp", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("fp", "h1", "h2")
    dealt = (windows.join(twice, ["fp", "h1", "h2"], "left_semi").groupBy("fp", "seg")
             .agg(F.flatten(F.collect_list(F.array("place", F.col("place") + 1))).alias("runs")))
    copies = (seen.groupBy("fp", "seg").agg(F.count("*").alias("n"), F.max("windows").alias("windows")).where("n > 1")
              .select("fp", "seg", F.array(F.lit(0).cast("long"), "windows").alias("runs")))
    hits = met.union(dealt).union(copies)
    pairs = F.transform(F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1),
                        lambda i: F.struct((F.col("lo") + F.get("runs", 2 * i)).alias("lo"),
                                           (F.col("lo") + F.get("runs", 2 * i + 1)).alias("hi")))
    spans = (seen.select("doc_id", "mark", "lo", "fp", "seg").join(hits, ["fp", "seg"])
             .select("doc_id", "mark", pairs.alias("pairs")).groupBy("doc_id", "mark")
             .agg(F.flatten(F.collect_list("pairs")).alias("spans")))
    whole = texts_of(docs, *keep).withColumn("mark", F.xxhash64("text"))
    rows = (whole.alias("t").join(spans.alias("k"), same, "left")
            .select("t.doc_id", "t.text", "k.spans", *(f"t.{c}" for c in keep)))
    return _cut(rows, length, list(keep), as_text)
