"""Byte-level BPE and packing against the libraries themselves."""
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import odd_rows
from tidemark.llm import bpe, packing

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def random_texts(n, seed=1):
    rng = random.Random(seed)
    letters = list("abcDE  ..,,''s\n\t!?_09é²ßЖ中  <|endoftext|>\U0001f600") + ["'s", " the", "\n\n", "   "]
    return ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(n)]


def test_safe_cuts_do_not_change_ids():
    enc = bpe.encoding(RANKS, P.PATTERN)
    for t in random_texts(3000):
        assert bpe.encode_text(enc, t, limit=3).tolist() == enc.encode_ordinary(t)


def test_long_runs():
    enc = bpe.encoding(RANKS, P.PATTERN)
    for t in ("a" * 100_000, "!" * 100_000, "9" * 100_000, " " * 70_000 + "x"):
        assert bpe.encode_text(enc, t).tolist() == enc.encode_ordinary(t)
    spaces = " " * 2_000_000 + "x"  # more than the library's own matcher can take
    assert enc.decode_bytes(bpe.encode_text(enc, spaces).tolist()) == spaces.encode()


def test_round_trip_of_odd_rows(odd, nothing):
    enc = bpe.encoding(RANKS, P.PATTERN)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), bytes(r.decoded))
                 for r in bpe.round_trip(odd, RANKS, P.PATTERN).collect())
    want = sorted((i is None, i or 0, len(x := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(),
                   (t or "").encode()) for i, t, _ in odd_rows())
    assert got == want
    ids = bpe.encode(odd, RANKS, P.PATTERN)
    assert sorted(bytes(r.decoded) for r in bpe.decode(ids, RANKS, P.PATTERN).collect()) == sorted(w[4] for w in want)
    assert bpe.round_trip(nothing, RANKS, P.PATTERN).count() == 0


def test_ids_are_those_of_the_tokenizers_library():
    tok = Tokenizer.from_file(JSON)
    texts = random_texts(5000, 2)
    texts += ["hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b", "<|endoftext", " <|endoftext|>\n\n y"]
    got = packing.token_encoder(JSON)(texts)
    assert [x.tolist() for x in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    other = P.path("word_bpe_49k.json")  # not a ranked byte-level file: run by the library
    assert packing.token_encoder(other)(["Hello world"])[0].tolist() == \
        Tokenizer.from_file(other).encode("Hello world", add_special_tokens=False).ids


def test_combinations_and_nnls():
    assert set(packing.combinations(4, 3)) == {(4,), (3, 1), (2, 2), (2, 1, 1)}
    rng = np.random.default_rng(0)
    a = rng.random((12, 7))
    x = np.array([0, 3, 0, 1.5, 0, 0, 2])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    y = packing.nnls(a, rng.normal(size=12))
    assert (y >= 0).all()


@pytest.mark.parametrize("lengths", [[1100] * 50, [1] * 5000, list(range(1, 2048, 3)), [2047], []])
def test_block_is_full_but_for_the_last_sequence(lengths):
    rests = [(d, 0, n) for d, n in enumerate(lengths)]
    seqs = packing.pack_block(rests, 2048)
    sizes = [sum(p[2] for p in s) for s in seqs]
    assert all(n == 2048 for n in sizes[:-1]) and all(0 < n <= 2048 for n in sizes)
    got = sorted(p for s in seqs for p in s)
    for d, n in enumerate(lengths):
        at = 0
        for _, s, k in [p for p in got if p[0] == d] if n > 1 else []:
            assert s == at
            at += k
    assert sum(sizes) == sum(lengths)


def test_packing_covers_every_id_once(odd, nothing, monkeypatch):
    encode = packing.token_encoder(JSON)
    rows = packing.pack(odd, JSON, window=64).collect()
    tokens = sum(len(x) + 1 for x in encode([t or "" for _, t, _ in odd_rows()]))
    assert sum(r.length for r in rows) == tokens
    seqs = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.start + r.length <= r.doc_tokens
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    unfilled = 0
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 64
        unfilled += at < 64
    assert unfilled <= 3  # one a partition
    whole = {}
    for r in sorted(rows, key=lambda r: r.start):
        if r.doc_id in (4, 5, 8):
            whole[r.doc_id] = whole.get(r.doc_id, b"") + bytes(r.ids)
    texts = dict((i, t) for i, t, _ in odd_rows())
    for d, raw in whole.items():
        assert np.frombuffer(raw, "<u4").tolist() == [*encode([texts[d]])[0].tolist(), 1]
    assert packing.pack(nothing, JSON).count() == 0
