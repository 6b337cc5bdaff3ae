"""Exact, near and passage dedup against brute force."""
import collections
import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import make_docs, odd_rows
from tidemark.llm import exact_dedup, ngram_join, suffix_dedup


# --- counting quotient filters ---

def test_filter_gives_back_its_fingerprints():
    rng = np.random.default_rng(1)
    for prefix in (0, 5):
        f = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
        if prefix:
            f = f[f >> np.uint64(64 - prefix) == 3]
        c = rng.integers(1, 9, len(f))
        cqf = exact_dedup.CountingQuotientFilter.build(f, c, prefix)
        back = exact_dedup.CountingQuotientFilter.from_bytes(prefix, cqf.to_bytes())
        assert (back.read(3) == f).all() and (back.count == c).all()


def test_merge_adds_counts():
    f, c = exact_dedup.merge([np.array([1, 5, 9], np.uint64), np.array([5, 7], np.uint64), np.zeros(0, np.uint64)],
                             [np.array([1, 2, 1]), np.array([4, 1]), np.zeros(0, np.int64)])
    assert f.tolist() == [1, 5, 7, 9] and c.tolist() == [1, 6, 1, 1]


def test_exact_dedup_of_odd_rows(odd, nothing):
    rows = exact_dedup.exact_dedup(odd).collect()
    texts = [(i, t or "") for i, t, _ in odd_rows()]
    size = collections.Counter(t for _, t in texts)
    keep = {}
    for i, t in texts:
        keep[t] = max(keep.get(t, -1), -1 if i is None else i)
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in size}
    want = sorted((i is None, i or 0, keep[t], size[t], sha[t]) for i, t in texts)
    got = sorted((r.doc_id is None, r.doc_id or 0, -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in rows)
    assert got == want
    kept = collections.Counter(r.text_sha256 for r in rows if r.kept)
    assert kept == collections.Counter({s: 1 for s in sha.values()})
    stay = exact_dedup.keep_one(odd)
    assert stay.columns == odd.columns and sorted((r.text or "") for r in stay.collect()) == sorted(size)
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.keep_one(nothing).count() == 0


def test_exact_dedup_with_a_normal_form(spark):
    from pyspark.sql import functions as F
    docs = make_docs(spark, [(1, "A b", "en"), (2, "a B", "en"), (3, "c", "en")])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, F.lower).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True)}


def test_ranges_follow_the_number_of_texts(spark, monkeypatch):
    asked = []
    real = exact_dedup.repeated_fingerprints
    monkeypatch.setattr(exact_dedup, "repeated_fingerprints", lambda f, prefix: asked.append(prefix) or real(f, prefix))
    docs = make_docs(spark, [(i, f"text {i // 2}", "en") for i in range(600)])
    for items in (1 << 22, 2):
        monkeypatch.setattr(exact_dedup, "RANGE_ITEMS", items)
        rows = exact_dedup.exact_dedup(docs).collect()
        assert all(r.group_size == 2 and r.keep_id == r.doc_id // 2 * 2 + 1 for r in rows) and sum(r.kept for r in rows) == 300
    assert asked[0] < asked[1] and 600 / 2 ** asked[1] <= 2


def test_hot_copies(spark):
    docs = make_docs(spark, [(i, "same text" if i % 3 else f"own {i}", "en") for i in range(3000)], 7)
    rows = exact_dedup.exact_dedup(docs).where("group_size > 1").collect()
    assert len(rows) == 2000 and {r.keep_id for r in rows} == {2999} and sum(r.kept for r in rows) == 1


# --- n-gram join ---

def brute_links(texts, n=5, t=0.8):
    sets = []
    for x in texts:
        w = (x or "").lower().encode().split()
        k = min(n, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    links = [0] * len(sets)
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and c >= t * (len(sets[i]) + len(sets[j]) - c) - 1e-9:
                links[i] += 1
                links[j] += 1
                label[max(find(i), find(j))] = min(find(i), find(j))
    return links, [find(i) for i in range(len(sets))]


def near_rows(seed=2, groups=6, size=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(20, 150))
        for _ in range(size):
            x = list(base)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.choice(words)
            rows.append(" ".join(x))
    return [(i, t, "en") for i, t in enumerate(rows + [" ".join(rng.choices(words, k=50)) for _ in range(30)] + ["", None, "one", "One"])]


def test_band_choice():
    bands, rows = ngram_join.bands_for(0.8, 0.9999, 256)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9999 and bands * rows <= 256
    assert 1 - (1 - 0.8 ** (rows + 1)) ** (256 // (rows + 1)) < 0.9999


@pytest.mark.parametrize("block", [1024, 7])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # 7: every class is verified in pairs of blocks
    rows = near_rows()
    links, label = brute_links([t for _, t, _ in rows])
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.near_duplicates(make_docs(spark, rows)).collect()}
    assert got == {i: (links[i], label[i]) for i, _, _ in rows}


def test_a_chain_of_texts_meets_in_buckets(spark, monkeypatch):
    """Neighbours are similar, the ends have nothing in common, copies and a dense group hang on it: no set is shipped more
    than about once per band, though the component has far more blocks than there are bands."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rng = random.Random(8)
    stream = [f"c{i}" for i in range(2400)]
    texts = [" ".join(stream[4 * i:4 * i + 64]) for i in range(400)]
    for _ in range(20):  # near copies of one link of the chain
        x = stream[800:864]
        x[rng.randrange(5, 59)] = f"d{rng.randrange(1000)}"
        texts.append(" ".join(x))
    texts += texts[10:13] * 2
    jobs = []
    plan = ngram_join._jobs
    monkeypatch.setattr(ngram_join, "_jobs", lambda *a: jobs.append(plan(*a)) or jobs[-1])
    links, label = brute_links(texts)
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.near_duplicates(make_docs(spark, rows)).collect()}
    assert got == {i: (links[i], label[i]) for i, _, _ in rows}
    made = jobs[0].collect()
    bands, _ = ngram_join.bands_for()
    assert {j.bucket >= 0 for r in made for j in r.jobs} == {True}
    assert sum(j.blocks for r in made for j in r.jobs) < len(made) * bands * 1.5 < len(made) * (len(made) / 7)


def test_near_duplicates_of_odd_rows(odd, nothing):
    rows = ngram_join.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows())
    links, _ = brute_links([t for _, t, _ in odd_rows()])
    assert sorted(r.n_links for r in rows) == sorted(links)
    assert {r.class_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert all(r.n_links == 1 and r.class_id is None for r in rows if r.doc_id is None)
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in rows if r.doc_id in (1, 2, 3))
    assert ngram_join.near_duplicates(nothing).count() == 0


# --- repeated passages ---

def brute_cut(texts, n):
    seen = collections.Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i:i + n]] > 1:
                gone[i:i + n] = True
        raw = np.frombuffer(t, np.uint8)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, raw[~gone].tobytes()))
    return out


def test_gram_hashes_tell_strings_apart():
    raw = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=2000)), np.uint8)
    for w in (1, 2, 25, 50, 200):
        h, known = suffix_dedup.gram_hashes(raw, w), {}
        assert len(h) == len(raw) - w + 1
        assert all(known.setdefault(raw[i:i + w].tobytes(), x) == x for i, x in enumerate(h))
        assert len(set(known.values())) == len(known)
    assert len(suffix_dedup.gram_hashes(raw[:10], 25)) == 0


def test_merged_transforms_give_blocks_of_equal_strings():
    rng = random.Random(9)
    segs = [bytes(rng.choices(b"ab", k=rng.randint(8, 20))) for _ in range(300)]
    windows = np.array([len(s) - 7 for s in segs])
    shards = [suffix_dedup.ShardBWT(segs[a:a + 60], windows[a:a + 60], 8, 2) for a in range(0, 300, 60)]
    z, block = suffix_dedup.merge(shards)
    at, strings = [0] * 5, []
    for s in z:
        shard = shards[s]
        w = shard.order[at[s]]
        at[s] += 1
        seg, place = shard.segment[w], shard.place[w]
        strings.append(segs[60 * s + seg][place:place + 8])
    assert len(set(zip(strings, block.tolist(), strict=True))) == len(set(strings)) == len(set(block.tolist()))


@pytest.mark.parametrize("group_bytes", [1 << 22, 2000])
def test_passages_match_brute_force(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1500)
    rng = random.Random(3)
    words = ["the", "cat", "a", "zebra", "é", "x" * 30]
    base = " ".join(rng.choices(words, k=400))
    rows = []
    for i in range(60):
        t = " ".join(rng.choices(words, k=rng.randint(0, 120)))
        if i % 3 == 0:
            a = rng.randint(0, 900)
            t = t[:50] + base[a:a + rng.randint(150, 500)] + t[50:]
        if i % 7 == 0:
            t += " the" * 150
        rows.append((i % 55, t, "en"))
    rows += [(100, None, "en"), (101, "", "en"), (None, rows[0][1], "en"), (102, "a" * 5000, "en")]
    got = suffix_dedup.remove_repeats(make_docs(spark, rows, 5), group_bytes=group_bytes).collect()
    want = brute_cut([(t or "").encode() for _, t, _ in rows], 200)
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == \
        sorted((key(i), *w) for (i, _, _), w in zip(rows, want, strict=True))


def test_passages_of_odd_rows(odd, nothing):
    got = suffix_dedup.remove_repeats(odd).collect()
    want = brute_cut([(t or "").encode() for _, t, _ in odd_rows() if t is None or len(t) < 50_000], 200)
    assert len(got) == len(odd_rows())
    short = [r for r in got if r.n_bytes < 50_000]
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in short) == sorted(w[:3] for w in want)
    assert all(r.n_removed == r.n_bytes for r in got if r.doc_id in (5, 6))
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_strings_with_equal_symbols_but_other_bytes_are_kept(spark):
    """Two strings of 50 bytes whose 32-bit symbols are equal, between the same surroundings: no 200 bytes are in common."""
    import numpy as np
    from tidemark.llm import suffix_dedup as sd
    rng = np.random.default_rng(3)
    inner = rng.integers(97, 123, (1 << 18, 10), dtype=np.uint8)
    left, right = b"l" * 20, b"r" * 20
    whole = np.concatenate([np.tile(np.frombuffer(left, np.uint8), (len(inner), 1)), inner,
                            np.tile(np.frombuffer(right, np.uint8), (len(inner), 1))], 1)
    symbol = (sd._mix(sd.gram_hashes(whole.ravel(), 50)[::50]) >> np.uint64(32))
    order = np.argsort(symbol, kind="stable")
    twin = next(i for i in np.flatnonzero(symbol[order][1:] == symbol[order][:-1])
                if (whole[order[i]] != whole[order[i + 1]]).any())
    a, b = whole[order[twin]].tobytes(), whole[order[twin + 1]].tobytes()
    assert a != b
    near = np.random.default_rng(4).integers(65, 91, 260, dtype=np.uint8).tobytes()
    texts = [near[:130] + x + near[130:] for x in (a, b)]
    segments, windows = [*texts, texts[0]], np.array([len(texts[0]) - 199] * 3)
    got = sd.repeated_windows(segments[:2], windows[:2])
    common = {texts[0][i:i + 200] for i in range(windows[0])} & {texts[1][i:i + 200] for i in range(windows[0])}
    assert not common and not any(h.any() for h in got)
    got = sd.repeated_windows(segments, windows)
    assert got[0].all() and got[2].all() and not got[1].any()
    docs = make_docs(spark, [(i, t.decode(), "en") for i, t in enumerate(texts)])
    assert [r.n_removed for r in sd.remove_repeats(docs).collect()] == [0, 0]
