"""Removal of word sequences that an earlier document holds, by relative Lempel-Ziv parsing against indexed reference blocks.

A window is LENGTH consecutive words. Its anchor, the least hash of GRAM words in it, is the same wherever the window stands, so
documents are routed to reference blocks by anchor: first it is found which anchors more than one document holds (packed sorted
remainders, a range of hashes at a time), then the stretches of text under these anchors are cut at content-defined places,
stretches that a task has seen in an earlier document are settled on the spot, and the rest go, segment by segment, to the
block of their anchor. A block indexes its reference windows; every segment is factored greedily against it, documents in
ascending order: a factor is extended word by word as far as the reference goes, and the windows across a factor's end are
looked up again, so no window is missed between two factors. Factors of LENGTH words or more are duplicate spans.

An anchor with over GROUP_BYTES of segments does not fit a block: its segments are cut into single windows, dealt by content.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, slices, stage, texts_of, tidy
from tidemark.llm.rolling import BASE, powers, prefix_sums, range_hashes

LENGTH, GRAM = 13, 5
#: Bytes of text hashed at once; longer texts are taken in parts that overlap by LENGTH - 1 words.
PART = 1 << 19
#: Text bytes whose anchors one range of hashes holds, about; bits of ranges at least; bits of a remainder.
RANGE_TEXT, RANGE_BITS, REST_BITS = 64 << 20, 6, 32
#: A stretch ends after a segment whose anchor is divisible by this.
CUT = 8
#: Bytes of segments indexed at once; an anchor with more is dealt out window by window.
GROUP_BYTES = 2 << 20
#: Stretches that a task remembers.
SEEN = 1 << 18
#: Rows are known by a hash of this many bytes while anchors are counted; a clash only adds candidates.
ROW_BYTES = 5

_LOW = np.uint64((1 << 24) - 1)
_WS = rb"[\x20\x09-\x0D]"
_GAP = re.compile(_WS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each place."""
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    rest = width - size
    return np.minimum(v[:len(v) - rest], v[rest:]) if rest else v


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of bytes that end in white space."""
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    before = np.append(True, gap[:-1])
    return np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)


def _pieces(text: bytes, length: int) -> Iterator[tuple[bytes, int]]:
    """A long text in parts, each with the ``length - 1`` words after its own as well; and how many words are its own."""
    more = re.compile(rb"(?:%s+[^\x20\x09-\x0D]+){0,%d}" % (_WS, length - 1))
    at = 0
    while len(text) - at > PART and (gap := _GAP.search(text, at + PART)):
        yield text[at:more.match(text, gap.start()).end()], len(text[at:gap.start()].split())
        at = gap.start()
    yield text[at:], 0


class Segments:
    """Segments of texts: runs of windows with one anchor. Entries: ``doc`` (number of the text), ``lo`` (first window, by word
    number), ``windows``, ``fp`` (anchor), ``begin`` and ``end`` (bytes in ``raw``), ``piece``."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        parts, doc, base = [], [], []
        for d, t in enumerate(texts):
            words = 0
            for p, own in _pieces(t, length):
                parts.append(p)
                doc.append(d)
                base.append(words)
                words += own
        self.raw = b" ".join(parts) + b" "
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        at = np.cumsum(sizes) - sizes
        out, first = [], 0
        while first < len(parts):  # as many parts at once as keep a word's number within the low bits
            last = max(first + 1, int(np.searchsorted(at + sizes, at[first] + 2 * PART, "right")))
            out.append(self._anchors(int(at[first]), int(at[last - 1] + sizes[last - 1]), first, at[first:last],
                                     np.array(doc[first:last]), np.array(base[first:last]), length, gram))
            first = last
        self.doc, self.lo, self.windows, self.fp, self.begin, self.end, self.piece = (
            (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 7)

    def _anchors(self, off, stop, first, at, doc, base, length, gram):
        raw = np.frombuffer(self.raw, np.uint8, stop - off, off)
        start, end = word_places(raw)
        h = _mix(range_hashes(prefix_sums(raw), start, end) + (end - start).astype(np.uint64))
        n = len(h)
        none = np.zeros(0, np.int64)
        if n < length:
            return none, none, none, none.astype(np.uint64), none, none, none
        g = h[:n - gram + 1].copy()
        for j in range(1, gram):
            g = g * np.uint64(BASE) + h[j:n - gram + 1 + j]
        g = _mix(g)
        anchor = (_least((g & ~_LOW) | np.arange(len(g), dtype=np.uint64), length - gram + 1) & _LOW).astype(np.int64)
        piece = np.searchsorted(at - off, start, "right") - 1
        s = np.flatnonzero(piece[:n - length + 1] == piece[length - 1:])
        a, p = anchor[s], piece[s]
        new = np.append(True, (a[1:] != a[:-1]) | (p[1:] != p[:-1])) if len(s) else np.zeros(0, bool)
        place, p, a = s[new], p[new], a[new]
        windows = np.diff(np.append(np.flatnonzero(new), len(s)))
        word0 = np.searchsorted(start, at - off)  # first word of each part
        return (doc[p], base[p] + place - word0[p], windows, g[a], start[place] + off, end[place + windows + length - 2] + off,
                p + first)

    def words(self, first: int, last: int) -> bytes:
        """The words of segments ``first`` to ``last``, joined by one space."""
        return b" ".join(self.raw[self.begin[first]:self.end[last]].split())


def factor(rows: list[tuple[int, bytes]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Greedy factors of texts (doc, words joined by one space; docs ascending) against the texts of smaller docs: for each
    text the runs (first, behind last) of windows inside factors of ``length`` words or more."""
    index: dict[bytes, tuple[int, int]] = {}
    fresh: list[tuple[bytes, int, int]] = []
    held, out, doc = [], [], None
    for r, (d, raw) in enumerate(rows):
        if d != doc:
            for key, i, p in fresh:
                index.setdefault(key, (i, p))
            fresh, doc = [], d
        words = raw.split(b" ")
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        held.append(words)
        runs, p, n = [], 0, len(words)
        while p + length <= n:
            key = raw[ends[p - 1] if p else 0:ends[p + length - 1] - 1]
            source = index.get(key)
            if source is None:
                fresh.append((key, r, p))
                p += 1
                continue
            other, q = held[source[0]], source[1]
            k = length
            while p + k < n and q + k < len(other) and words[p + k] == other[q + k]:
                k += 1
            runs.append((p, p + k - length + 1))
            p += k - length + 1  # the first window across the factor's end is looked up next
        out.append(runs)
    return out


def pack(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _utf8(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _dealt(part: np.ndarray, *cols: np.ndarray) -> Iterator[tuple]:
    """(number, the columns' entries with that number) for each number in ``part``."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(part)], strict=True):
        yield int(part[a]), *(c[order[a:b]] for c in cols)


def _shared(base: DataFrame, length: int, gram: int) -> tuple[DataFrame, int]:
    """(row, keys): for each row hash the leading bits of its anchors that another row holds too, and their number of bits.

    An anchor goes to the range of its first bits with its next bits and its row; one that several rows of a batch hold goes
    there once, without a row, and these rows hear of it at once. So a hot anchor counts once a batch, not once a row.
    """
    total = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(RANGE_BITS, (total // RANGE_TEXT).bit_length())
    ranges, drop, width = 1 << bits, np.uint64(64 - REST_BITS - bits), -(-(REST_BITS + bits) // 8)
    low = np.uint64((1 << REST_BITS) - 1)
    packed = pa.schema([("p", pa.int64()), ("keys", pa.binary()), ("rows", pa.binary())])

    def row(p: int, keys: bytes, rows: bytes) -> dict:
        return {"p": p, "keys": keys, "rows": rows}

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for part in slices(batch, "text", PART):
                s = Segments(_utf8(part.column(1).to_pylist()), length, gram)
                keys.append(s.fp >> drop)
                rows.append(part.column(0).to_numpy()[s.doc].astype(np.uint64))
            if not keys:
                continue
            pairs = np.unique(np.stack([np.concatenate(keys), np.concatenate(rows)], 1), axis=0)
            key, of = pairs[:, 0], pairs[:, 1]
            first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            counts = np.diff(np.append(np.flatnonzero(first), len(key)))
            many = np.repeat(counts > 1, counts)
            out = [row(p, pack(k, 4), pack(r, ROW_BYTES))
                   for p, k, r in _dealt((key[first] >> np.uint64(REST_BITS)).astype(np.int64), key[first] & low,
                                         np.where(many, np.uint64(0), of)[first])]
            # rows of p >= ranges hold whole keys that are known to be shared
            out += [row(ranges + q, pack(k, width), pack(r, ROW_BYTES))
                    for q, k, r in _dealt((of[many] % np.uint64(ranges)).astype(np.int64), key[many], of[many])]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=packed)

    def count(table: pa.Table) -> pa.Table:
        p = table["p"][0].as_py()
        of = unpack(b"".join(table["rows"].to_pylist()), ROW_BYTES)
        if p >= ranges:
            key = unpack(b"".join(table["keys"].to_pylist()), width)
        else:
            rest = unpack(b"".join(table["keys"].to_pylist()), 4)
            order = np.argsort(rest, kind="stable")
            rest, of = rest[order], of[order]
            first = np.append(True, rest[1:] != rest[:-1])
            counts = np.diff(np.append(np.flatnonzero(first), len(rest)))
            several = (counts > 1) | (np.add.reduceat(of == 0, np.flatnonzero(first)) > 0)
            told = np.repeat(several, counts) & (of > 0)
            key, of = rest[told] | np.uint64(p << REST_BITS), of[told]
        return pa.Table.from_pylist([row(q, pack(k, width), pack(r, ROW_BYTES))
                                     for q, k, r in _dealt((of % np.uint64(ranges)).astype(np.int64), key, of)], schema=packed)

    def gather(table: pa.Table) -> pa.Table:
        key = unpack(b"".join(table["keys"].to_pylist()), width)
        of = unpack(b"".join(table["rows"].to_pylist()), ROW_BYTES)
        told = [(r, pack(k, width)) for r, k in _dealt(of.astype(np.int64), key)]
        return pa.table({"row": pa.array([r for r, _ in told], pa.int64()), "keys": pa.array([k for _, k in told], pa.binary())})

    ddl = "p long, keys binary, rows binary"
    found = base.select("row", "text").mapInArrow(tidy(anchors), ddl).groupBy("p").applyInArrow(count, ddl)
    return found.groupBy("p").applyInArrow(gather, "row long, keys binary"), REST_BITS + bits


def _packed(base: DataFrame) -> DataFrame:
    """``base`` with its text compressed: texts cross two exchanges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            done = pa.array([zip_(t) for t in _utf8(batch.column("text").to_pylist())], pa.binary())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", done)
    fields = [f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in base.schema]
    return base.mapInArrow(tidy(run), ", ".join(fields))


def _bounded(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows whose compressed texts unpack to PART bytes at most, or single rows, with these texts."""
    unzip = zstandard.ZstdDecompressor().decompress
    packed = batch.column(batch.schema.get_field_index("text")).to_pylist()
    sizes = [zstandard.frame_content_size(z) for z in packed]
    at = size = 0
    for i, k in enumerate([*sizes, PART + 1]):
        if i > at and size + k > PART:
            yield batch.slice(at, i - at), [unzip(z) for z in packed[at:i]]
            at, size = i, 0
        size += k


_STRETCH = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("lo", pa.int64()), ("windows", pa.int64()),
                      ("words", pa.binary())])


def _stretches(texts: DataFrame, bits: int, length: int, gram: int) -> DataFrame:
    """Stretches of text under shared anchors; words are null where the task has seen them in a smaller document."""
    width, drop = -(-bits // 8), np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        for batch in batches:
            for part, raw in _bounded(batch):
                s = Segments(raw, length, gram)
                wanted = np.unique(unpack(b"".join(part.column("keys").to_pylist()), width))
                at = np.flatnonzero(np.isin(s.fp >> drop, wanted))
                if not len(at):
                    continue
                joined = ((np.diff(at) == 1) & (s.piece[at[1:]] == s.piece[at[:-1]])
                          & (s.lo[at[:-1]] + s.windows[at[:-1]] == s.lo[at[1:]]) & (s.fp[at[:-1]] % np.uint64(CUT) != 0))
                first = at[np.append(True, ~joined)]
                last = at[np.append(~joined, True)]
                ids = part.column("doc_id").to_numpy()[s.doc[first]]
                if len(least) > SEEN:
                    least.clear()
                words: list[bytes | None] = []
                for a, b, d in zip(first.tolist(), last.tolist(), ids.tolist(), strict=True):
                    w = s.words(a, b)
                    key = hashlib.blake2b(w, digest_size=16).digest()
                    known = least.get(key)
                    if known is not None and known < d:
                        words.append(None)
                        continue
                    least[key] = d
                    words.append(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), part.column("mark").take(pa.array(s.doc[first])), pa.array(s.lo[first]),
                     pa.array(s.lo[last] + s.windows[last] - s.lo[first]), pa.array(words, pa.binary())], schema=_STRETCH)
    return texts.select("doc_id", "mark", "text", "keys").mapInArrow(
        tidy(run), "doc_id long, mark long, lo long, windows long, words binary")


_SEGMENT = pa.schema([("fp", pa.int64()), ("size", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("lo", pa.int64()),
                      ("words", pa.binary())])


def _segments(stretches: DataFrame, length: int, gram: int, sizes_only: bool = False) -> DataFrame:
    """The segments of stretches (doc_id, mark, lo, words), each with its words unless only sizes are asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "words", PART):
                s = Segments(part.column("words").to_pylist(), length, gram)
                at = pa.array(s.doc)
                words = [None] * len(s.fp) if sizes_only else [s.raw[a:b] for a, b in zip(s.begin.tolist(), s.end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.fp.view(np.int64)), pa.array(s.end - s.begin), part.column("doc_id").take(at),
                     part.column("mark").take(at), pa.array(part.column("lo").to_numpy()[s.doc] + s.lo),
                     pa.array(words, pa.binary())], schema=_SEGMENT)
    return stretches.select("doc_id", "mark", "lo", "words").mapInArrow(
        tidy(run), "fp long, size long, doc_id long, mark long, lo long, words binary")


_SPAN_DDL = "doc_id long, mark long, lo long, hi long"
_SPAN = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _factored(segments: DataFrame, length: int, group_bytes: int) -> DataFrame:
    """Spans of repeated windows, from segments sorted by fp in partitions: whole anchors form a block, as many as fit."""
    def found(block: pa.Table) -> pa.RecordBatch:
        block = block.sort_by("doc_id")
        runs = factor(list(zip(block["doc_id"].to_pylist(), block["words"].to_pylist(), strict=True)), length)
        at = pa.array([i for i, r in enumerate(runs) for _ in r], pa.int64())
        lo = block["lo"].to_numpy()[at.to_numpy()]
        ends = np.array([x for r in runs for x in r], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([block["doc_id"].take(at).combine_chunks(), block["mark"].take(at).combine_chunks(),
                                           pa.array(lo + ends[:, 0]), pa.array(lo + ends[:, 1])], schema=_SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            fp, upto = t["fp"].to_numpy(), np.append(0, np.cumsum(t["size"].to_numpy()))
            edge = [0, *(np.flatnonzero(fp[1:] != fp[:-1]) + 1).tolist(), len(fp)]
            last = held[-1]["fp"][-1].as_py() if held else None
            start = 0
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                full = size + int(upto[b] - upto[start]) > group_bytes
                if full and (a > start or held) and not (a == 0 and fp[0] == last):
                    yield found(pa.concat_tables([*held, t.slice(start, a - start)]))
                    held, size, start = [], 0, a
            if start < len(fp):
                held.append(t.slice(start))
                size += int(upto[-1] - upto[start])
        if held:
            yield found(pa.concat_tables(held))
    return (segments.select("fp", "size", "doc_id", "mark", "lo", "words").repartition("fp").sortWithinPartitions("fp")
            .mapInArrow(tidy(run), _SPAN_DDL))


def _by_window(segments: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows of segments whose anchors do not fit a block: every window goes by the hash of its words."""
    out = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("lo", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, mark, lo = [], [], [], []
            for d, m, at, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "lo", "words")), strict=True):
                words = raw.split(b" ")
                for p in range(len(words) - length + 1):
                    key.append(hashlib.blake2b(b" ".join(words[p:p + length]), digest_size=16).digest())
                    lo.append(at + p)
                doc += [d] * (len(words) - length + 1)
                mark += [m] * (len(words) - length + 1)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(doc, pa.int64()), pa.array(mark, pa.int64()),
                                              pa.array(lo, pa.int64())], schema=out)
    windows = segments.select("doc_id", "mark", "lo", "words").mapInArrow(
        tidy(run), "key binary, doc_id long, mark long, lo long")
    least = windows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    return (windows.join(least, "key").where("doc_id > least")
            .select("doc_id", "mark", "lo", (F.col("lo") + 1).alias("hi")))


def _cut(rows: DataFrame, length: int, keep: list[str]) -> DataFrame:
    """Texts (compressed) without the words that their spans' windows cover; kept words are joined by one space."""
    names = ["doc_id", "n_words", "n_removed", "kept", *keep]
    kinds = ["long", "long", "long", "binary", *(rows.schema[c].dataType.simpleString() for c in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _bounded(batch):
                made: dict[str, list] = {n: [] for n in names[:4]}
                for doc_id, text, spans in zip(part.column("doc_id").to_pylist(), texts, part.column("spans").to_pylist(), strict=True):
                    raw = np.frombuffer(text + b" ", np.uint8).copy()
                    start, end = word_places(raw)
                    cover = np.zeros(len(start) + 1, np.int64)
                    for s in spans or []:
                        cover[s["lo"]] += 1
                        cover[s["hi"] + length - 1] -= 1
                    stays = np.cumsum(cover[:-1]) == 0
                    edge = np.zeros(len(raw) + 1, np.int8)
                    edge[start[stays]] += 1
                    edge[end[stays] + 1] -= 1
                    raw[end] = 32
                    kept = raw[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()[:-1]
                    for n, v in zip(made, (doc_id, len(start), int((~stays).sum()), kept), strict=True):
                        made[n].append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(made[n], pa.int64()) for n in names[:3]), pa.array(made["kept"], pa.binary()),
                                                  *(part.column(c) for c in keep)], names=names)
    return rows.select("doc_id", "text", "spans", *keep).mapInArrow(
        tidy(run), ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def remove_earlier(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the remaining words joined by one space, UTF-8), and the ``keep``
    columns.

    Words are runs of bytes other than 0x20 and 0x09-0x0D. A word goes if a window of ``length`` words that covers it also
    starts in a document with a smaller doc_id; windows are judged on the input. Equal doc_ids, repeated rows among them, are
    not smaller than each other; a row with a null doc_id keeps all its words and is no reference. Null and empty texts have no
    words; texts shorter than a window stay whole; an empty table gives no rows; extra columns are left behind.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    mark = F.xxhash64("text").alias("mark")
    row = (F.pmod(F.xxhash64("doc_id", "text"), F.lit((1 << 8 * ROW_BYTES) - 1)) + 1).alias("row")
    base = texts_of(docs).select("doc_id", "text", mark, row).where(F.col("doc_id").isNotNull())
    shared, bits = _shared(base, length, gram)
    texts = _packed(base).join(shared, "row")
    seen = stage(_stretches(texts, bits, length, gram), "stretches")
    fresh = seen.where("words is not null")
    hot = stage(_segments(fresh, length, gram, sizes_only=True).groupBy("fp").agg(F.sum("size").alias("total"))
                .where(F.col("total") > group_bytes).select("fp"), "hot-anchors")
    segments = _segments(fresh, length, gram)
    spans = seen.where("words is null").select("doc_id", "mark", "lo", (F.col("lo") + F.col("windows")).alias("hi"))
    if hot.isEmpty():
        spans = spans.union(_factored(segments, length, group_bytes))
    else:
        spans = (spans.union(_factored(segments.join(hot, "fp", "left_anti"), length, group_bytes))
                 .union(_by_window(segments.join(hot, "fp", "left_semi"), length)))
    spans = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    names = {c: f"kept_{i}" for i, c in enumerate(keep)}  # carried under names that no step uses
    whole = texts_of(docs, *(F.col(c).alias(n) for c, n in names.items())).select("*", mark)
    rows = _packed(whole).join(spans, ["doc_id", "mark"], "left")
    return _cut(rows, length, list(names.values())).withColumnsRenamed({n: c for c, n in names.items()})
