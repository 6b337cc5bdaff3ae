"""Brown class-based n-grams: exchange clustering of words, class transitions, word emissions.

Every word has a class, found by exchange on its own contexts. The most frequent words are moved one after another, with
the others in groups by their last bytes: a round counts, over all training text, the classes before and after each of these
units, and moves each to the class that gains most mutual information. Then every other word of the vocabulary leaves its
group: tasks count the classes before and after it, the counts meet by word in one shuffle, and each word moves to its best
class against the same transitions, all at once, as distributed exchange clustering does. Counts and classes of words that are
not among the frequent ones stay a table, joined to the words of each text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, slices, stage, texts_of, tidy

#: Words looked up inside a task, of at most HEAD_BYTES each, so the broadcast is at most HEAD * HEAD_BYTES bytes and counts.
HEAD, HEAD_BYTES = 131_072, 64
#: Units of the sweeps: so many words, and so many groups of the other words by their last SUFFIX bytes. A word unseen in
#: training keeps the class of its group.
SINGLE, GROUPS, SUFFIX = 16_384, 4_096, 3
CLASSES, ROUNDS = 32, 4
#: Distinct words, and contexts of words outside the sweeps, after which a task hands its counts over.
COUNTED, CONTEXTS = 1 << 19, 1 << 21
#: Weight of the unigram class distribution in transitions, in tokens; weight of the class model beside plain unigrams.
PRIOR, WEIGHT = 20.0, 0.95
#: Counts of a context whose gains are looked up: most are that small.
FEW = 8
#: Units per row of a task's context counts; such rows are added up in so many bins first, then over the bins.
CHUNK, BINS = 1024, 64

END = b""


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def group_of(word: bytes) -> int:
    """The group of a word that is no unit of its own."""
    return zlib.crc32(word[-SUFFIX:]) % GROUPS


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts; tasks count before the shuffle."""
    out = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())],
                                              schema=out)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                if len(seen) > COUNTED:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()
    return texts.select("text").mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> list:
    """About the ``most`` most frequent words, never more: those whose count reaches a level, chosen from the number of words
    at each level (a table of at most 64 * 16 rows), and of the level below a share by hash, so about that many rows reach
    the driver from all tasks together."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    held, least, wanted = 0, None, F.lit(False)
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        if held + r["words"] > most:
            share = (most - held) / r["words"]
            wanted = (F.col("level") == r["level"]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)))
            break
        held += r["words"]
        least = r["level"]
    if least is not None:
        wanted |= F.col("level") >= least
    rows = counts.withColumn("level", level).where(wanted).collect()
    return sorted(rows, key=lambda r: (-r["n"], bytes(r["word"])))[:most]


class Lexicon:
    """Codes of words: the place of a word of the head, and after these the group of any other word. A code's unit is one of
    the SINGLE first places, or a group."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.words = words
        self.place = {w: i for i, w in enumerate(words)}
        self.counts = np.array(counts, np.float64)
        self.unit = np.array([*(i if i < SINGLE else SINGLE + group_of(w) for i, w in enumerate(words)),
                              *range(SINGLE, SINGLE + GROUPS)], np.int64)
        self._group: dict[bytes, int] = {}

    def codes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(code of each word, positions of the words outside the head)."""
        code = np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))
        tail = np.flatnonzero(code < 0)
        get, known = self._group.get, self._group
        for i in tail.tolist():
            s = words[i][-SUFFIX:]
            if (g := get(s)) is None:
                g = zlib.crc32(s) % GROUPS
                if len(known) < 1 << 17:
                    known[s] = g
            code[i] = len(self.words) + g
        return code, tail


_CODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("codes", pa.binary()),
                    ("tail", pa.list_(pa.struct([("word", pa.binary()), ("at", pa.int32())])))])
_CODED_DDL = "row long, doc_id long, held_out boolean, codes binary, tail array<struct<word: binary, at: int>>"


def packed(values: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Runs of ``values`` that end at ``stop``, as a binary array."""
    at = (np.append(0, stop) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(stop), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a binary array, where its rows end)."""
    rows = column.to_pylist()
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(rows), kind), np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) // size)


def encoded(docs: DataFrame, lexicon: Broadcast) -> DataFrame:
    """Each document as the codes of its words, and its words outside the head with their positions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [words_of(t) for t in part.column(1).to_pylist()]
                words = [w for t in texts for w in t]
                stop = np.cumsum([len(t) for t in texts])
                code, tail = lexicon.value.codes(words)
                doc = np.searchsorted(stop, tail, "right")
                outside = pa.StructArray.from_arrays(
                    [pa.array([words[i] for i in tail.tolist()], pa.binary()),
                     pa.array((tail - np.append(0, stop)[doc]).astype(np.int32))], names=["word", "at"])
                cut = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(len(texts))), part.column(0), part.column(2), packed(code, stop),
                     pa.ListArray.from_arrays(pa.array(cut), outside)], schema=_CODED)
                row += len(texts)
    return stage(docs.select("doc_id", "text", "held_out").mapInArrow(tidy(run), _CODED_DDL), "coded")


def squeezed(counts: np.ndarray) -> bytes:
    """Counts as compressed planes of bytes: most are zero or small, so little but the lowest plane is left."""
    return pa.compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` counts of :func:`squeezed`."""
    planes = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _chunks(values: list[np.ndarray]) -> Iterator[dict]:
    for k in range(0, len(values[0]), CHUNK):
        part = [v[k:k + CHUNK] for v in values]
        if any(p.any() for p in part):
            yield {"chunk": k // CHUNK, "bin": TaskContext.get().partitionId() % BINS,
                   "counts": squeezed(np.concatenate([p.ravel() for p in part]))}


def contexts(train: DataFrame, lexicon: Broadcast, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all training text: (units x classes before, units x classes after, followed by itself)."""
    n = len(classes)
    out = pa.schema([("chunk", pa.int64()), ("bin", pa.int64()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after, twice = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, 1), np.int64)
        for batch in batches:
            u = np.concatenate([[0], lexicon.value.unit[unpacked(batch.column(0), np.int32)[0]]])  # an end stands before
            c = classes[u]
            before += np.bincount(u[1:] * k + c[:-1], minlength=n * k).reshape(n, k)
            after += np.bincount(u[:-1] * k + c[1:], minlength=n * k).reshape(n, k)
            twice[:, 0] += np.bincount(u[1:][u[1:] == u[:-1]], minlength=n)
        rows = list(_chunks([before, after, twice]))
        yield pa.RecordBatch.from_pylist(rows, schema=out)

    def cells(chunk: int) -> int:
        return min(CHUNK, n - chunk * CHUNK) * (2 * k + 1)

    def total(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = int(key[0])
        sums = np.zeros(cells(chunk), np.int64)
        for p in parts:
            for raw in p["counts"]:
                sums += unsqueezed(raw, len(sums))
        yield pd.DataFrame({"chunk": [chunk], "counts": [squeezed(sums)]})

    got = (train.select("codes").mapInArrow(tidy(count), "chunk long, bin long, counts binary")
           .groupBy("chunk", "bin").applyInPandas(total, "chunk long, counts binary")
           .groupBy("chunk").applyInPandas(total, "chunk long, counts binary").collect())
    before, after, twice = np.zeros((n, k)), np.zeros((n, k)), np.zeros(n)
    for r in got:  # a fixed number of chunks
        a = int(r["chunk"]) * CHUNK
        m = min(CHUNK, n - a)
        flat = unsqueezed(bytes(r["counts"]), cells(int(r["chunk"])))
        before[a:a + m] = flat[:m * k].reshape(m, k)
        after[a:a + m] = flat[m * k:2 * m * k].reshape(m, k)
        twice[a:a + m] = flat[2 * m * k:]
    return before, after, twice


def _xlogx(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0)
    return x * np.log(np.maximum(x, 1e-300))


def exchange(classes: np.ndarray, before: np.ndarray, after: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """One sweep: each unit in turn moves to the class that gains most; unit 0 (the end) keeps class 0 for itself."""
    k = before.shape[1]
    pairs = np.zeros((k, k))
    np.add.at(pairs.T, classes, before)
    now = classes.copy()
    total = before.sum(1)
    diagonal = np.arange(k)
    for u in np.argsort(-total, kind="stable"):
        if u == 0 or not total[u]:
            continue
        a, left, right, own = now[u], before[u].copy(), after[u].copy(), twice[u]
        left[classes[u]] -= own  # where a unit follows itself, the class beside it moves with it
        right[classes[u]] -= own
        pairs[:, a] -= left
        pairs[a, :] -= right
        pairs[a, a] -= own
        row, col = pairs.sum(1) + left, pairs.sum(0) + right
        base = _xlogx(pairs)
        gain = (_xlogx(pairs + right[None, :]) - base).sum(1) + (_xlogx(pairs + left[:, None]) - base).sum(0)
        same = pairs[diagonal, diagonal]
        gain += (_xlogx(same + left + right + own) - _xlogx(same + left) - _xlogx(same + right) + _xlogx(same))
        gain -= _xlogx(row + right.sum() + own) - _xlogx(row) + _xlogx(col + left.sum() + own) - _xlogx(col)
        gain[0] = -np.inf
        b = int(np.argmax(gain))
        pairs[:, b] += left
        pairs[b, :] += right
        pairs[b, b] += own
        now[u] = b
    return now


def best_classes(pairs: np.ndarray, now: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class that gains most for each of many words, each moved alone out of its class ``now``.

    ``left`` and ``right`` are words x classes, ``own`` says how often a word follows itself. Only the cells of the
    transitions that a word's contexts change are looked at. Of equal gains the least class wins.
    """
    n, k = left.shape
    word = np.arange(n)
    left, right = left.copy(), right.copy()
    left[word, now] -= own
    right[word, now] -= own
    gain = np.zeros((n, k))
    for side, other, cells in ((right, left, pairs.T), (left, right, pairs)):
        w, j = np.nonzero(side)
        if not len(w):
            continue
        count, mine = side[w, j], now[w]
        change = np.empty((len(w), k))
        plain = (count <= FEW) & (j != mine)  # all but the cell of its own class are as they are for any word
        i = np.flatnonzero(plain)
        few = np.arange(1, FEW + 1)[:, None, None]
        change[i] = (_xlogx(cells + few) - _xlogx(cells))[count[i].astype(np.int64) - 1, j[i]]
        rest = cells[j[i], mine[i]] - count[i]
        change[i, mine[i]] = _xlogx(rest + count[i]) - _xlogx(rest)
        i = np.flatnonzero(~plain)
        base = cells[j[i]]
        base[np.arange(len(i)), mine[i]] -= count[i]
        inside = np.flatnonzero(j[i] == mine[i])
        base[inside] -= other[w[i[inside]]]
        base[inside, mine[i[inside]]] -= own[w[i[inside]]]
        change[i] = _xlogx(base + count[i, None]) - _xlogx(base)
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        gain[w[first]] += np.add.reduceat(change, first, axis=0)
    same = np.tile(np.diag(pairs), (n, 1))
    same[word, now] -= left[word, now] + right[word, now] + own
    gain += _xlogx(same + left + right + own[:, None]) - _xlogx(same + left) - _xlogx(same + right) + _xlogx(same)
    for mass, whole in ((right.sum(1) + own, pairs.sum(1)), (left.sum(1) + own, pairs.sum(0))):
        rest = np.tile(whole, (n, 1))
        rest[word, now] -= mass
        gain -= _xlogx(rest + mass[:, None]) - _xlogx(rest)
    gain[:, 0] = -np.inf
    return gain.argmax(1)


_SEEN = pa.schema([("word", pa.binary()), ("seen", pa.binary())])
_OWN = pa.schema([("word", pa.binary()), ("place", pa.int32()), ("n", pa.int64()), ("class", pa.int32())])


def own_classes(train: DataFrame, lexicon: Broadcast, classes: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """(word, place, n, class) of every training word that is no unit of its own, each by its own contexts.

    A task sends a word's counts as one row for every CONTEXTS contexts it has read, so a frequent word arrives as few rows;
    rows of a word are added up as they stream by in the order of words. A word of the head travels as a space, which no word
    holds, and its place; counts travel as a context and a byte, again and again for a count beyond a byte.
    """
    k = len(pairs)
    wide = 2 * k + 1
    cell = np.dtype([("context", np.uint8 if wide <= 256 else np.uint16), ("times", np.uint8)])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        head = len(lex.words)
        outside: dict[bytes, int] = {}
        keys: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            key, times = np.unique(np.concatenate(keys), return_counts=True)
            rows_of = (times + 254) // 255
            key = np.repeat(key, rows_of)
            word, counted = key // wide, np.empty(len(key), cell)
            counted["context"], counted["times"] = key % wide, 255
            counted["times"][np.cumsum(rows_of) - 1] = times - 255 * (rows_of - 1)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            stop = np.append(first[1:], len(key))
            names = list(outside)
            which = word[first]
            return pa.RecordBatch.from_arrays(
                [pa.array([b" " + w.to_bytes(4, "big") if w < head else names[w - head] for w in which.tolist()], pa.binary()),
                 packed(counted, stop)], schema=_SEEN)

        for batch in batches:
            code, stop = unpacked(batch.column(0), np.int32)
            word = code.astype(np.int64)
            tail = batch.column(1)
            flat = tail.flatten()
            doc = np.repeat(np.arange(len(tail)), np.diff(tail.offsets.to_numpy()))
            spot = np.append(0, stop)[doc] + flat.field("at").to_numpy()
            word[spot] = [head + outside.setdefault(w, len(outside)) for w in flat.field("word").to_pylist()]
            unit = lex.unit[code]
            c = classes[unit]
            pick = np.flatnonzero(unit >= SINGLE)  # never an end, so there is a word after it
            prior = pick - 1
            at = word[pick] * wide
            before = np.where(pick > 0, c[prior], 0)
            again = (pick > 0) & (word[prior] == word[pick])
            keys += [at + before, at + k + c[pick + 1], at[again] + 2 * k]
            if sum(map(len, keys)) > CONTEXTS:
                yield rows()
                keys.clear()
                outside.clear()
        if sum(map(len, keys)):
            yield rows()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen(words: list[bytes], sums: np.ndarray) -> pa.RecordBatch:
            place = [int.from_bytes(w[1:], "big") if w[:1] == b" " else -1 for w in words]
            words = [lexicon.value.words[p] if p >= 0 else w for w, p in zip(words, place)]
            now = classes[SINGLE + np.array([group_of(w) for w in words], np.int64)]
            best = best_classes(pairs, now, sums[:, :k], sums[:, k:2 * k], sums[:, 2 * k])
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(place, pa.int32()), pa.array(sums[:, :k].sum(1).astype(np.int64)),
                 pa.array(best.astype(np.int32))], schema=_OWN)

        words, sums = [], np.zeros((0, wide))  # the last word, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            names = words + batch.column(0).to_pylist()
            new = np.array([True, *(x != y for x, y in zip(names, names[1:]))])
            group = np.cumsum(new) - 1
            counted, stop = unpacked(batch.column(1), cell)
            at = np.repeat(group[len(words):], np.diff(np.append(0, stop))) * wide + counted["context"]
            total = np.bincount(at, counted["times"], minlength=(group[-1] + 1) * wide).reshape(-1, wide)
            total[:len(sums)] += sums
            words = [names[i] for i in np.flatnonzero(new)]
            if len(words) > 1:
                yield chosen(words[:-1], total[:-1])
            words, sums = words[-1:], total[-1:]
        if words:
            yield chosen(words, sums)
    met = (train.select("codes", "tail").mapInArrow(tidy(seen), "word binary, seen binary")
           .repartition(F.col("word")).sortWithinPartitions("word"))
    return stage(met.mapInArrow(tidy(settle), "word binary, place int, n long, class int"), "word-classes")


@dataclass
class Model:
    lexicon: Lexicon
    classes: np.ndarray   # class of each code: words of the head, then groups, for words unseen in training
    step: np.ndarray      # log10 weight of a class after a class, apart from the word's own count
    tokens: int           # N
    scale: float          # N + (V + 1) / 2


@dataclass
class Fitted:
    model: Model
    words: DataFrame      # word, n, class of the training words outside the head
    coded: DataFrame      # the documents as codes
    tails: DataFrame      # per document with words outside the head: transitions into and out of these, their counts


_TAIL = pa.schema([("key", pa.int64()), ("word", pa.binary()), ("side", pa.int64())])
_STEPS = pa.schema([("row", pa.int64()), ("held_out", pa.bool_()), ("into", pa.binary()), ("out", pa.binary()),
                    ("known", pa.int64()), ("words", pa.float64())])
#: Bits of a class, or of a class and one more value, in a packed number.
BITS = 9


def tail_steps(coded: DataFrame, words: DataFrame, head: int, classes: np.ndarray, k: int) -> DataFrame:
    """The transitions beside words outside the head, per document, once these words have met their classes.

    Such a word travels with its document's row and fold as one number, ``key``, and a second, ``side``: its position, the
    classes before and after it (plus one; 0 for another word outside the head) and its own, its group's until it meets its
    class. The words come back to their document as they were, key, side and count, and stream by in its order.
    """
    mask = (1 << BITS) - 1

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, stop = unpacked(batch.column(2), np.int32)
            tail = batch.column(3)
            flat = tail.flatten()
            doc = np.repeat(np.arange(len(tail)), np.diff(tail.offsets.to_numpy()))
            at = flat.field("at").to_numpy().astype(np.int64)
            spot = np.append(0, stop)[doc] + at
            c = np.where(code < head, classes[code] + 1, 0).astype(np.int64)
            left = np.where(at > 0, c[spot - 1], 1)  # an end, of class 0, stands before
            side = ((at << BITS | left) << BITS | c[spot + 1]) << BITS | classes[code[spot]].astype(np.int64)
            key = (batch.column(0).to_numpy() * 2 + batch.column(1).fill_null(True).to_numpy(zero_copy_only=False))[doc]
            for a in range(0, len(doc), 1 << 16):
                i = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(key[i]), flat.field("word")[i], pa.array(side[i])], schema=_TAIL)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def steps(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            key, side, n = (np.concatenate(x) for x in zip(*parts))
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            stop = np.append(first[1:], len(key))
            c, right, left = side & mask, (side >> BITS & mask) - 1, (side >> 2 * BITS & mask) - 1
            prior = np.where(left >= 0, left, np.append(0, c[:-1]))  # else the word outside the head just before
            leave = right >= 0
            return pa.RecordBatch.from_arrays(
                [pa.array(key[first] >> 1), pa.array((key[first] & 1).astype(bool)), packed((prior * k + c).astype(np.uint16), stop),
                 packed((c * k + right)[leave].astype(np.uint16), np.cumsum(np.add.reduceat(leave.astype(np.int64), first))),
                 pa.array(np.add.reduceat((n > 0).astype(np.int64), first)),
                 pa.array(np.add.reduceat(np.log10(n + 0.5), first))], schema=_STEPS)

        parts: list[list[np.ndarray]] = []  # of the last document, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [c.to_numpy() for c in batch.columns]
            key = part[0]
            last = int(np.searchsorted(key, key[-1]))
            if last or (parts and parts[0][0][-1] != key[-1]):
                yield steps([*parts, [x[:last] for x in part]] if last else parts)
                parts = []
            parts.append([x[last:] for x in part])
        if parts:
            yield steps(parts)
    rows = coded.select("row", "held_out", "codes", "tail").where(F.size("tail") > 0)
    met = rows.mapInArrow(tidy(listed), "key long, word binary, side long").join(words, "word", "left")
    side, group = F.col("side"), F.lit(mask).cast("long")
    own = F.coalesce(F.col("class").cast("long"), side.bitwiseAND(group))
    met = (met.select("key", (side - side.bitwiseAND(group) + own).alias("side"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
           .repartition("key").sortWithinPartitions("key", "side"))
    return stage(met.mapInArrow(tidy(joined), "row long, held_out boolean, into binary, out binary, known long, words double"),
                 "tail-steps")


def _head_steps(codes: pa.Array, head: int, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(transition into each word, whether neither side is outside the head, codes, where documents end)."""
    code, stop = unpacked(codes, np.int32)
    c, known = classes[code], code < head
    return np.append(0, c[:-1]) * k + c, known & np.append(True, known[:-1]), code, stop


def transitions(coded: DataFrame, tails: DataFrame, head: int, classes: np.ndarray, k: int) -> np.ndarray:
    """Class before x class, over all training text; a task sends at most k * k rows, pre-aggregated once more."""
    out = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def rows(total: np.ndarray) -> pa.RecordBatch:
        cell = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], schema=out)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            step, plain, _, _ = _head_steps(batch.column(0), head, classes, k)
            total += np.bincount(step[plain], minlength=k * k)
        yield rows(total)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for column in batch.columns:
                total += np.bincount(unpacked(column, np.uint16)[0], minlength=k * k)
        yield rows(total)
    both = (coded.where("not held_out").select("codes").mapInArrow(tidy(inside), "cell long, n long")
            .union(tails.where("not held_out").select("into", "out").mapInArrow(tidy(beside), "cell long, n long")))
    pairs = np.zeros(k * k)
    for cell, n in both.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # k * k rows
        pairs[cell] = n
    return pairs.reshape(k, k)


def fit(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> Fitted:
    """Cluster and count the texts of rows not held out; all rows are encoded on the way (doc_id, text, held_out)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = texts_of(docs, "held_out")
    counts = stage(word_counts(texts.where("not held_out").select("text")), "word-counts")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(whole["n"]), int(whole["v"])
    rows = most_frequent(counts.where((F.octet_length("word") <= HEAD_BYTES) & (F.octet_length("word") > 0)), HEAD)
    ends = counts.where(F.octet_length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lexicon = Lexicon([END, *(bytes(r["word"]) for r in rows)], [int(ends), *(r["n"] for r in rows)])
    head = len(lexicon.words)
    shared = spark.sparkContext.broadcast(lexicon)
    coded = encoded(texts, shared)
    train = coded.where("not held_out")
    place = np.concatenate([[0], 1 + np.arange(SINGLE + GROUPS - 1) % (classes - 1)])
    for r in range(rounds + 1):
        before, after, twice = contexts(train, shared, place, classes)
        if r < rounds:
            place = exchange(place, before, after, twice)
    pairs = np.zeros((classes, classes))
    np.add.at(pairs.T, place, before)
    own = own_classes(train, shared, place, pairs)
    of = place[lexicon.unit]
    for at, c in own.where("place >= 0").select("place", "class").collect():  # at most HEAD rows
        of[at] = c
    words = own.where("place < 0").select("word", "n", "class")
    tails = tail_steps(coded, words, head, of, classes)
    pairs = transitions(coded, tails, head, of, classes)
    kinds = np.bincount(of[:head], minlength=classes).astype(float)
    for c, many in words.groupBy("class").agg(F.count("*").alias("many")).collect():  # a row a class
        kinds[c] += many
    scale = n + 0.5 * (v + 1)
    size = pairs.sum(0)
    after_class = (pairs + PRIOR * (size + 0.5) / (n + 0.5 * classes)) / (pairs.sum(1, keepdims=True) + PRIOR)
    step = np.log10(WEIGHT * after_class / (size + 0.5 * (kinds + 1)) + (1 - WEIGHT) / scale)
    return Fitted(Model(lexicon, of, step, n, scale), words, coded, tails)


_ROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                  ("known", pa.int64()), ("words", pa.float64()), ("steps", pa.float64())])
_BESIDE = pa.schema([("row", pa.int64()), ("tail_known", pa.int64()), ("tail_words", pa.float64()), ("tail_steps", pa.float64())])


def score(fitted: Fitted) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text)."""
    model = fitted.model
    k, head = len(model.step), len(model.lexicon.words)
    weight, flat = np.log10(model.lexicon.counts + 0.5), model.step.ravel()
    shared = fitted.coded.sparkSession.sparkContext.broadcast((model.classes, weight, model.lexicon.counts > 0, flat))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, weight, trained, flat = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            step, plain, code, stop = _head_steps(batch.column(3), head, classes, k)
            start = np.append(0, stop[:-1])
            held, at = code < head, np.minimum(code, head - 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(stop - start), pa.array(np.add.reduceat((held & trained[at]).astype(np.int64), start)),
                 pa.array(np.add.reduceat(np.where(held, weight[at], 0.0), start)),
                 pa.array(np.add.reduceat(np.where(plain, flat[step], 0.0), start))], schema=_ROW)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = shared.value[3]
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for column in batch.columns[3:]:
                step, stop = unpacked(column, np.uint16)
                sums = np.append(0.0, np.cumsum(flat[step]))
                total += sums[stop] - sums[np.append(0, stop[:-1])[:len(stop)]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total)], schema=_BESIDE)
    rows = fitted.coded.select("row", "doc_id", "held_out", "codes").mapInArrow(
        tidy(inside), "row long, doc_id long, held_out boolean, n_tokens long, known long, words double, steps double")
    tails = fitted.tails.select("row", "known", "words", "into", "out").mapInArrow(
        tidy(beside), "row long, tail_known long, tail_words double, tail_steps double")
    whole = F.col("words") + F.coalesce("tail_words", F.lit(0.0))
    return (rows.join(tails, "row", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
                    F.lit(model.tokens).cast("long").alias("train_tokens"),
                    (whole - F.col("n_tokens") * float(np.log10(model.scale))).alias("base_score"),
                    (whole + F.col("steps") + F.coalesce("tail_steps", F.lit(0.0))).alias("score")))


def class_scores(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """Learn from the rows whose column ``held_out`` is not true, score all rows.

    base_score is the smoothed unigram score, score the class model's; both are log10 of the text's probability, its end
    included. Null texts count as empty: one token, the end. Repeated rows count, and are scored, each on its own; a null
    held_out counts as false. Without training text every token is unknown. Extra columns are left behind.
    """
    return score(fit(docs.select("doc_id", "text", F.coalesce(F.col("held_out"), F.lit(False)).alias("held_out")), classes, rounds))
