"""Byte-level BPE encoding and decoding by tiktoken with a local rank file.

Long texts are cut at safe boundaries first: a cut lies where no match of the split pattern can span it and no
lookahead sees past it, so the pieces encode to the same ids as the whole text. Decoding joins raw bytes, so any id
list gives back the exact bytes, also where a token ends inside a character.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from tidemark.llm.common import bounded_batches, texts_of, tidy

#: Characters after which a text is cut at the next safe boundary.
CUT_CHARS = 1 << 16
#: A run of white space longer than this is matched here: the library's matcher keeps a stack entry per character.
LONG_SPACE = 1 << 14

#: Between a non-space and a space; or where a run of letters, or of digits, ends.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")
_SPACES = regex.compile(r"\s{%d,}" % LONG_SPACE)


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, limit: int = CUT_CHARS) -> Iterator[str]:
    """Cut ``text`` at the first safe boundary after every ``limit`` characters."""
    at = 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, at + limit)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str, limit: int = CUT_CHARS) -> np.ndarray:
    """Ids of ``text`` as unsigned 32-bit integers."""
    if len(text) <= limit:
        return enc.encode_to_numpy(text, disallowed_special=())
    out = []
    for piece in safe_pieces(text, limit):
        if _SPACES.search(piece):
            for m in regex.finditer(enc._pat_str, piece):
                out.append(np.asarray(enc._encode_single_piece(m.group()), dtype=np.uint32))
        else:
            out.append(enc.encode_to_numpy(piece, disallowed_special=()))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _over(docs: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, arrow: pa.Schema) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict(fn(b), schema=arrow)
    return docs.mapInArrow(tidy(run), schema)


_IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_BOTH = _IDS.append(pa.field("decoded", pa.binary()))


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Ids of every document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers).

    Null and empty texts give no ids; repeated rows give a row each; extra columns are left behind.
    """
    def fn(b: pa.RecordBatch) -> dict:
        enc = encoding(rank_file, pattern)
        ids = [encode_text(enc, t) for t in b.column(1).to_pylist()]
        return {"doc_id": b.column(0), "n_tokens": [len(i) for i in ids],
                "ids": [i.astype("<u4").tobytes() for i in ids]}
    return _over(texts_of(docs), fn, "doc_id long, n_tokens long, ids binary", _IDS)


def decode(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Raw bytes of every id list: doc_id, decoded. Null ids give no bytes."""
    out = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def fn(b: pa.RecordBatch) -> dict:
        enc = encoding(rank_file, pattern)
        return {"doc_id": b.column(0), "decoded": [enc.decode_bytes(np.frombuffer(i or b"", "<u4").tolist())
                                                   for i in b.column(1).to_pylist()]}
    return _over(tokens.select("doc_id", "ids"), fn, "doc_id long, decoded binary", out)


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts: doc_id, n_tokens, ids, decoded.

    One row per document, repeated rows and null ids included. Null and empty texts have no ids and decode to no bytes, texts of
    any length are encoded whole; an empty table gives no rows, extra columns are left behind.
    """
    def fn(b: pa.RecordBatch) -> dict:
        enc = encoding(rank_file, pattern)
        ids = [encode_text(enc, t) for t in b.column(1).to_pylist()]
        return {"doc_id": b.column(0), "n_tokens": [len(i) for i in ids],
                "ids": [i.astype("<u4").tobytes() for i in ids],
                "decoded": [enc.decode_bytes(i.tolist()) for i in ids]}
    return _over(texts_of(docs), fn, "doc_id long, n_tokens long, ids binary, decoded binary", _BOTH)
