import hashlib
import math
import random
import re

import numpy as np
import pytest

from tidemark.llm import hard_negatives as hn
from tidemark.llm import substring_rlz as rlz

from .conftest import make_docs


# ------------------------------------------------------------------ hard negatives

def mined(rows, every=100):
    """Hard negatives by plain loops with unbounded integers."""
    kept = [(i, v, lab, [math.floor(256 * x) for x in vec]) for i, (v, vec, lab) in enumerate(rows)
            if lab is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    out = []
    for i, a, label, x in kept:
        if a is None or a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), v is None, v or 0, lab, j) for j, v, lab, y in kept
                        if j != i)
        for s, no_id, p, *_ in [r for r in scored if r[3] == label][:5]:
            inside = [r for r in scored if r[3] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(a, None if no_id else p, k, None if r[1] else r[2], -s, -r[0]) for k, r in enumerate(inside, 1)]
    return sorted(out, key=str)


def vectors(spark, rows, parts=3):
    schema = "vec_id long, embedding array<double>, label int, rid string, i string, v string, pairs int"
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], schema).repartition(parts)


def same(spark, rows, **kw):
    got = [tuple(r) for r in hn.mine(vectors(spark, rows, **kw)).collect()]
    assert sorted(got, key=str) == mined(rows)
    return got


def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (7, 33, 65), (40, 64, 17), (129, 50, 70), (64, 64, 64)):
        a, b = rng.integers(-2 ** 31, 2 ** 31, (m, k)), rng.integers(-2 ** 25, 2 ** 25, (k, n))
        want = np.array([[int(x) for x in r] for r in a.astype(object) @ b.astype(object)])
        for leaf in (1, 4, 16, 64):
            assert (hn.strassen(a, b, leaf) == want).all()


def test_strassen_holds_where_parts_of_it_overflow():
    a = np.full((8, 8), 2 ** 31, np.int64)
    b = np.zeros((8, 8), np.int64)
    b[0], b[1] = 2 ** 31, -(2 ** 31) + 1
    assert (hn.strassen(a, b, 1) == 2 ** 31).all()


def test_mining_against_loops(spark):
    rng = random.Random(2)
    vec = lambda: [rng.choice([0.0, 0.5, 1.0, -0.25, rng.random()]) for _ in range(6)]
    rows = [(i, vec(), i % 3) for i in range(420)]
    rows += [(100, rows[100][1], 1), (100, vec(), 1), (7, [0.0] * 6, 0), (None, vec(), 1), (-100, vec(), 2)]
    rows += [(500, None, 1), (501, vec(), None), (502, [1.0, None], 1), (600, [float("nan")] * 6, 1), (700, [float("inf")], 0),
             (800, [], 1), (900, [1.0, 2.0], 1), (901, [0.3] * 11, 0)]
    assert len(same(spark, rows)) > 50


def test_ties_and_copies(spark):
    """Vectors of 0 and 1, and one vector for a third of the rows: ties go by id, over cells and tiles."""
    rng = random.Random(5)
    rows = [(i, [float(rng.random() < 0.5) for _ in range(5)] if i % 3 else [1.0] * 5, rng.randrange(2)) for i in range(300)]
    same(spark, rows)


def test_small_cells_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i * 20, [rng.choice([-1.0, 0.25, 2.0]) for _ in range(7)], rng.randrange(3)) for i in range(90)]
    want = same(spark, rows)
    for name, value in (("ANCHORS", 4), ("CANDIDATES", 9), ("TILE_ROWS", 3), ("TILE_COLUMNS", 8)):
        monkeypatch.setattr(hn, name, value)
    assert sorted(same(spark, rows, parts=5), key=str) == sorted(want, key=str)


def test_mining_of_little(spark):
    assert hn.mine(vectors(spark, [(0, [1.0], 1)], parts=1).where("vec_id < 0")).collect() == []
    assert same(spark, [(1, [1.0], 1), (3, [1.0], 2)]) == []
    assert same(spark, [(0, [1.0], 1), (3, [1.0], 2)]) == []          # no positive
    assert same(spark, [(0, [1.0], 1), (3, [-1.0], 1), (4, [-1.0], 2)]) == []  # a negative score has no window
    assert same(spark, [(0, [0.0], 1), (3, [0.0], 1), (4, [0.0], 2)]) == [(0, 3, 1, 4, 0, 0)]


# ------------------------------------------------------------------ substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(rows, length):
    """(doc_id, n_words, n_removed, kept hash) by a table of all windows."""
    least, words = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - length + 1):
            if i is not None:
                key = tuple(w[p:p + length])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - length + 1):
            if i is not None and least[tuple(w[p:p + length])] < i:
                gone |= set(range(p, p + length))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def earlier(df, **kw):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(bytes(r["kept"])).hexdigest())
                   for r in rlz.remove_earlier(df, **kw).collect()), key=str)


def random_docs(seed, n=80, vocabulary=6, length=60):
    """Few words, so that windows repeat everywhere, and shared passages with different surroundings."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["é", "日本"]
    say = lambda k: rng.choice([" ", "\n", " \t "]).join(rng.choices(words, k=k))
    passage = [say(30) for _ in range(4)]
    return [(rng.randrange(n * 2), f"{say(rng.randrange(length))} {rng.choice(passage)} {say(rng.randrange(9))}") for _ in range(n)]


@pytest.mark.parametrize(("seed", "length", "gram", "group"), [(1, 13, 5, 2 << 20), (2, 5, 3, 2 << 20), (3, 6, 3, 400), (4, 13, 5, 300)])
def test_removal_against_a_table_of_windows(spark, seed, length, gram, group):
    """Small blocks put frequent anchors on the way for those that fit none."""
    rows = random_docs(seed)
    rows += [rows[0], (None, rows[1][1]), (5, None), (6, ""), (7, "one two"), (8, " \n ")]
    df = make_docs(spark, [(i, t, "en") for i, t in rows], parts=4)
    assert earlier(df, length=length, gram=gram, group_bytes=group) == removed(rows, length)


def test_odd_and_empty_tables(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert earlier(odd) == removed(rows, 13)
    assert rlz.remove_earlier(nothing).collect() == []
    kept = rlz.remove_earlier(odd, keep=("lang", "score", "n_chars")).columns
    assert kept == ["doc_id", "n_words", "n_removed", "kept", "lang", "score", "n_chars"]


def test_long_texts_are_cut_without_a_trace(spark, monkeypatch):
    rng = random.Random(9)
    text = " ".join(f"v{rng.randrange(3000)}" for _ in range(9000))
    rows = [(1, text), (2, "start " + text[20_000:41_000] + " end"), (3, text[:300]), (4, "x" * 90_000 + " " + text[100:400])]
    df = make_docs(spark, [(i, t, "en") for i, t in rows])
    monkeypatch.setattr(rlz, "PART", 1500)
    segments = rlz.Segments([text.encode()])
    monkeypatch.undo()
    whole = rlz.Segments([text.encode()])
    covered = lambda s: sorted(p for a, n in zip(s.lo.tolist(), s.windows.tolist(), strict=True) for p in range(a, a + n))
    assert covered(segments) == covered(whole) == list(range(9000 - 12))
    assert earlier(df) == removed(rows, 13)


def test_factors_are_checked_at_their_ends():
    """Two references that overlap: the windows across the end of the first factor are found in the second."""
    w = [f"w{i}" for i in range(40)]
    join = lambda x: " ".join(x).encode()
    got = rlz.factor([(1, join(w[:20])), (2, join(w[8:40])), (3, join(w))])
    assert got[0] == [] and got[1] == []
    assert got[2] == [(0, 8), (8, 28)]
    assert rlz.factor([(1, join(w[:20])), (1, join(w[:20]))]) == [[], []]


def test_packed_numbers():
    a = np.array([0, 1, 255, 2 ** 33 + 5, 2 ** 39], np.uint64)
    assert (rlz.unpack(rlz.pack(a, 5), 5) == a).all()
