"""Packing by non-negative least squares over a histogram of piece lengths.

Each task packs the documents of its own partition, block by block, so packing needs no shuffle and no table of all
pieces. In a block: documents become full windows and one rest each; the rests' lengths are binned; every combination
of up to ``DEPTH`` bins that fills the window is a column of a least-squares system against the histogram; its
non-negative solution, rounded, says how often each combination is used; what is left is packed greedily, longest
first; then gaps are closed by cutting the emptiest sequences. Only the last sequence of a partition stays unfilled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidemark.llm.bpe import encode_text
from tidemark.llm.common import bounded_batches, slices, texts_of, tidy

#: Combinations have up to so many pieces; lengths are rounded up to multiples of BIN for the histogram.
DEPTH, BIN = 3, 32
#: Tokens of a block; a block's ids are what a task holds in memory.
BLOCK_TOKENS = 1 << 22

#: How the byte-level pre-tokenizer splits text (fixed value of that format).
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: itself if printable, else the next free letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}


@lru_cache(maxsize=2)
def token_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids of texts by a tokenizers file, without adding special tokens; the file's added tokens are recognised in the text, as
    the library does.

    Where the file is a plain byte-level BPE whose ids are its merge ranks, texts are cut at the added tokens and its
    vocabulary is run by the rank encoder, which gives the same ids in a fifth of the time; any other file is run by the
    tokenizers library.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", ())]
    added = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
    plain = not any(t.get(k) for t in spec.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip", "normalized"))
    ranked = (model.get("type") == "BPE" and not spec.get("normalizer") and not model.get("dropout")
              and plain and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
              and sorted(model["vocab"].get(c, -1) for c in _byte_letters()) == [*range(256)]
              and all(model["vocab"].get(m) == 256 + i for i, m in enumerate(merges)))
    if not ranked:
        tok = Tokenizer.from_file(path)
        return lambda texts: [np.array(e.ids, np.uint32) for e in tok.encode_batch(texts, add_special_tokens=False)]
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in t): model["vocab"][t] for t in [*letters, *merges]}
    enc = tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})
    if not added:
        return lambda texts: [encode_text(enc, t) for t in texts]
    cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")

    def encode(text: str) -> np.ndarray:
        pieces = cut.split(text)  # every second piece is an added token
        if len(pieces) == 1:
            return encode_text(enc, text)
        return np.concatenate([np.array([added[x]], np.uint32) if i % 2 else encode_text(enc, x) for i, x in enumerate(pieces)])
    return lambda texts: [encode(t) for t in texts]


@lru_cache(maxsize=8)
def combinations(window_bins: int, depth: int) -> tuple[tuple[int, ...], ...]:
    """Every multiset of up to ``depth`` bins whose lengths add up to the window, longest first."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, top: int, taken: tuple[int, ...]) -> None:
        if left == 0:
            out.append(taken)
        elif len(taken) < depth:
            for b in range(min(top, left), 0, -1):
                grow(left - b, b, (*taken, b))
    grow(window_bins, window_bins, ())
    return tuple(out)


def nnls(a: np.ndarray, h: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by active sets: min |a x - h|, x >= 0."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    gram, rhs = a.T @ a, a.T @ h
    for _ in range(rounds):
        slope = rhs - gram @ x
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(rhs).max(initial=0))):
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(gram[np.ix_(at, at)], rhs[at], rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 1e-12
            old = x[at]
            step = np.min(old[bad] / np.maximum(old[bad] - z[bad], 1e-300))
            x[at] = old + min(1.0, step) * (z - old)
            drop = at[bad & (x[at] <= 1e-10)]
            if not len(drop):
                drop = at[bad][:1]
            x[drop] = 0
            active[drop] = False
            if not active.any():
                break
    return x


def repeat_counts(hist: np.ndarray, window_bins: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """How often each combination is used: the rounded solution, never more than the histogram holds."""
    combos = [c for c in combinations(window_bins, depth) if all(hist[b] for b in c)]
    if not combos:
        return []
    a = np.zeros((window_bins + 1, len(combos)))
    for j, c in enumerate(combos):
        for b in c:
            a[b, j] += 1
    x = nnls(a, hist.astype(float))
    left, out = hist.copy(), []
    for j in np.argsort(-x, kind="stable"):
        n = int(round(float(x[j])))
        if n <= 0:
            break
        n = min(n, *(int(left[b] // combos[j].count(b)) for b in set(combos[j])))
        if n > 0:
            for b in combos[j]:
                left[b] -= n
            out.append((combos[j], n))
    return out


Piece = tuple[int, int, int]  # document's place in the block, start, length


def pack_block(rests: list[Piece], window: int, depth: int = DEPTH, width: int = BIN) -> list[list[Piece]]:
    """Sequences of the rests: all full but the last one."""
    bins = -(-window // width)
    shelf: list[list[Piece]] = [[] for _ in range(bins + 1)]
    for p in sorted(rests, key=lambda p: -p[2]):
        shelf[-(-p[2] // width)].append(p)
    out: list[list[Piece]] = []
    exact = bins if window % width == 0 else window // width
    hist = np.array([len(s) for s in shelf])
    for combo, n in repeat_counts(hist, exact, depth) if exact == bins else []:
        for _ in range(n):
            out.append([shelf[b].pop() for b in combo])
    top = bins
    while True:  # greedy: the longest piece opens a sequence, then the longest that fits
        while top and not shelf[top]:
            top -= 1
        if not top:
            break
        seq = [shelf[top].pop()]
        gap = window - seq[0][2]
        b = min(top, gap // width)
        while b:
            if shelf[b]:
                seq.append(shelf[b].pop())
                gap -= seq[-1][2]
                b = min(b, gap // width)
            else:
                b -= 1
        out.append(seq)
    out.sort(key=lambda s: -sum(p[2] for p in s))
    i, j = 0, len(out) - 1
    while i < j:  # the emptiest sequences are cut up to fill the others
        gap = window - sum(p[2] for p in out[i])
        while gap and i < j:
            d, s, n = out[j].pop()
            take = min(gap, n)
            out[i].append((d, s, take))
            gap -= take
            if take < n:
                out[j].append((d, s + take, n - take))
            elif not out[j]:
                out.pop()
                j -= 1
        i += 1
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                  ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, eos: int = 1) -> DataFrame:
    """Pack every document into sequences of ``window`` tokens at most; one row per piece.

    doc_id, start (ids of its document before it), length, ids (little-endian unsigned 32-bit), doc_tokens (with the
    end id), sequence_id, offset (place in the sequence, gapless from 0). sequence_id is unique over all tasks, not
    dense. A null or empty text is the end id alone; repeated rows (and null ids) are documents of their own; an empty
    table gives no rows; extra columns are left behind.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_encoder(tokenizer_path)
        base = TaskContext.get().partitionId() << 33
        made = 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        rests: list[Piece] = []
        held = 0

        def rows(seqs: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            for k in range(0, len(seqs), 1024):
                cols: dict[str, list] = {f.name: [] for f in _OUT}
                for seq in seqs[k:k + 1024]:
                    at = 0
                    for d, s, n in seq:
                        for name, v in zip(cols, (doc_ids[d], s, n, ids[d][s:s + n].tobytes(), len(ids[d]),
                                                  base + made, at), strict=True):
                            cols[name].append(v)
                        at += n
                    made += 1
                yield pa.RecordBatch.from_pydict(cols, schema=_OUT)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """Emit what is packed; the unfilled sequence goes on to the next block."""
            nonlocal doc_ids, ids, rests, held
            seqs = pack_block(rests, window)
            rests, keep = [], []
            if seqs and not last and sum(p[2] for p in seqs[-1]) < window:
                keep = seqs.pop()
            yield from rows(seqs)
            places = {d: i for i, d in enumerate(dict.fromkeys(p[0] for p in keep))}
            doc_ids, ids = [doc_ids[d] for d in places], [ids[d] for d in places]
            rests, held = [(places[d], s, n) for d, s, n in keep], 0

        for batch in batches:
            for part in slices(batch, "text"):
                whole: list[list[Piece]] = []
                for doc_id, x in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    d = len(ids)
                    doc_ids.append(doc_id)
                    ids.append(np.append(x, np.uint32(eos)).astype("<u4"))
                    n = len(ids[d])
                    whole += [[(d, s, window)] for s in range(0, n - n % window, window)]
                    if n % window:
                        rests.append((d, n - n % window, n % window))
                    held += n
                yield from rows(whole)
                if held >= BLOCK_TOKENS:
                    yield from flush(False)
        yield from flush(True)

    return texts_of(docs).mapInArrow(tidy(run), "doc_id long, start long, length long, ids binary, doc_tokens long, "
                                          "sequence_id long, offset long")
