"""Language ID and class-based scores against their definitions."""
import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tests.llm.conftest import make_docs, odd_rows
from tidemark.llm import brown, language_id
from tidemark.llm.language_id import MARK, Segmenter, Vocabulary

PIECES = P.path("piece_bpe_32k.model")


# --- language ID ---

def toy():
    pieces = [MARK, MARK + "a", "a", "b", "ab", "ba", "aba", MARK + "ab"]
    p = np.random.default_rng(0).random((len(pieces), 2))
    return pieces, p / p.sum(0), Segmenter(Vocabulary.of(pieces), p / p.sum(0))


def segmentations(s):
    for cuts in itertools.product([0, 1], repeat=len(s) - 1):
        out, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                out.append(s[at:i])
                at = i
        yield [*out, s[at:]]


def test_forward_sums_all_segmentations():
    pieces, p, seg = toy()
    place = {x: i for i, x in enumerate(pieces)}
    words = ["a", "ab", "abab", "baab", "c", "acb"]
    got = np.exp(seg.log_probability(words))
    for w, g in zip(words, got, strict=True):
        total = np.zeros(2)
        for parts in segmentations(MARK + w):
            probs = [p[place[x]] if x in place else np.full(2, language_id.UNKNOWN if len(x) == 1 else 0.0) for x in parts]
            total += np.prod(probs, axis=0)
        assert np.allclose(g, total)


def test_expected_counts_are_those_of_all_segmentations():
    pieces, p, seg = toy()
    place = {x: i for i, x in enumerate(pieces)}
    counts = np.array([[2.0, 0.0], [1.0, 3.0]])
    got = seg.expected(["abab", "ba"], counts)
    want = np.zeros(p.shape)
    for w, n in zip(["abab", "ba"], counts, strict=True):
        ways = [s for s in segmentations(MARK + w) if all(x in place for x in s)]
        probs = np.array([np.prod([p[place[x]] for x in s], axis=0) for s in ways])
        for s, post in zip(ways, probs / probs.sum(0), strict=True):
            for x in s:
                want[place[x]] += post * n
    assert np.allclose(got, want)


def plain_log(place, p, word):
    """Forward sums in logarithms, letter by letter."""
    s = MARK + word
    f = [np.zeros(p.shape[1])]
    for j in range(1, len(s) + 1):
        ways = []
        for k in range(1, min(j, 20) + 1):
            x = s[j - k:j]
            if x in place:
                ways.append(f[j - k] + np.log(p[place[x]]))
            elif k == 1:
                ways.append(f[j - k] + np.log(language_id.UNKNOWN))
        f.append(np.logaddexp.reduce(ways, axis=0))
    return f[-1]


def test_long_words_are_scored_whole(monkeypatch):
    pieces, p, seg = toy()
    place = {x: i for i, x in enumerate(pieces)}
    rng = random.Random(1)
    words = ["".join(rng.choices("abc", k=k)) for k in (47, 48, 49, 50, 333, 5000)]
    want = [plain_log(place, p, w) for w in words]
    assert np.allclose(seg.log_probability(words), want, rtol=1e-9)
    monkeypatch.setattr(language_id, "STRIDE", 7)
    assert np.allclose(seg.log_probability(words), want, rtol=1e-9)


def test_expected_counts_of_long_words_are_the_scaled_ones(monkeypatch):
    _, _, seg = toy()
    rng = random.Random(2)
    words = ["".join(rng.choices("ab", k=k)) for k in (40, 40, 45, 48)]
    counts = np.array([[1.0, 2.0], [0.0, 1.0], [3.0, 0.0], [1.0, 1.0]])
    want = seg.expected(words, counts)
    monkeypatch.setattr(language_id, "WORD_CHARS", 10)
    assert np.allclose(seg.expected(words, counts), want)


def test_all_pieces_are_used():
    v = Vocabulary.load(PIECES)
    assert max(map(len, v.pieces)) > 12
    piece = next(x for x in v.pieces if len(x) == 13 and x[0] == MARK and x[1:].isalpha())
    codes = np.array([[ord(c) for c in piece]], np.uint64)
    assert v.pieces[v.places(codes)[0, 0, 12]] == piece


def test_words_keep_their_marks():
    assert language_id.words_of("हिन्दी भाषा") == ["हिन्दी", "भाषा"]
    assert language_id.words_of("مُحَمَّد 12 e\u0301te\u0301!") == ["مُحَمَّد", "e\u0301te\u0301"]
    assert language_id.words_of("\u0301 12") == []


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"), PIECES)
    got = language_id.predict(docs, model, PIECES, keep=("lang",)).where(
        "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(odd, nothing):
    model = language_id.fit(odd, PIECES)
    assert model.langs == ["de", "en", "fr"]
    rows = language_id.predict(odd, model, PIECES).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        if r.doc_id in (1, 2, 3, 8):
            assert r.lang_pred == "und" and r.score == 0
        else:
            assert r.lang_pred in model.langs and 0 < r.score <= 1
    assert language_id.words_of("²³ Ⅷ 12") == [] and language_id.words_of("a²") == ["a²"]
    empty = language_id.fit(nothing, PIECES)
    assert empty.langs == [] and language_id.predict(nothing, model, PIECES).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, empty, PIECES).collect()} == {"und"}


# --- class-based scores ---

def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())), b""]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("head", [131_072, 3])
def test_base_scores_and_counts(odd, monkeypatch, head):
    monkeypatch.setattr(brown, "HEAD", head)  # 3: nearly all words take the joined way
    rows = odd_rows()
    seen = collections.Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    want = sorted((-1 if i is None else i, held(i), len(x := tokens(t)), sum(seen[w] > 0 for w in x),
                   round(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 4)) for i, t, _ in rows)
    docs = odd.withColumn("held_out", language_id.fold(odd["doc_id"]) == 1)
    got = brown.class_scores(docs, classes=6, rounds=2).collect()
    assert {r.train_tokens for r in got} == {n}
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)


def class_of_words(fitted):
    """Class of every training word: those of the head, and those of the table."""
    model = fitted.model
    found = {w: int(c) for w, c in zip(model.lexicon.words, model.classes, strict=False)}
    return found | {bytes(r.word): r["class"] for r in fitted.words.collect()}


def objective(pairs):
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0).sum()
    return xlogx(pairs) - xlogx(pairs.sum(0)) - xlogx(pairs.sum(1))


def class_pairs(texts, of, k):
    pairs = np.zeros((k, k))
    for words in texts:
        for a, b in zip([b"", *words[:-1]], words, strict=True):
            pairs[of[a], of[b]] += 1
    return pairs


def some_texts(n=60):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["long" * 20]
    weights = [1 / (1 + i) for i in range(41)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 25))) for _ in range(n)]
    return [*texts, "w0 w0 w0 w0", "w39 w39 w38 w38 w37", "unseen w1 never-seen never-seen w39 w40"]


@pytest.mark.parametrize(("head", "single"), [(131_072, 16_384), (20, 6), (3, 6), (30, 2)])
def test_scores_are_those_of_a_plain_class_bigram(spark, monkeypatch, head, single):
    """Scores against plain loops that are given nothing but the class of each word."""
    monkeypatch.setattr(brown, "HEAD", head)
    monkeypatch.setattr(brown, "SINGLE", single)
    k, texts = 5, some_texts()
    docs = make_docs(spark, [(i, t, "en") for i, t in enumerate(texts)]).selectExpr("doc_id", "text", "doc_id % 7 = 3 or doc_id = 62 as held_out")
    fitted = brown.fit(docs, classes=k, rounds=2)
    of = class_of_words(fitted)
    train = [tokens(t) for i, t in enumerate(texts) if i % 7 != 3 and i != 62]
    count = collections.Counter(w for t in train for w in t)
    assert set(of) >= set(count) and of[b""] == 0 and 0 not in {c for w, c in of.items() if w}
    n, v = sum(count.values()), len(count)
    pairs = class_pairs(train, of, k)
    kinds = collections.Counter(of[w] for w in count)
    group = lambda w: int(fitted.model.classes[len(fitted.model.lexicon.words) + brown.group_of(w)])
    scale = n + 0.5 * (v + 1)

    def log10(prior, word):
        a, b = (of.get(w, None) if w in count else group(w) for w in (prior, word))
        size = pairs[:, b].sum()
        step = (pairs[a, b] + brown.PRIOR * (size + 0.5) / (n + 0.5 * k)) / (pairs[a].sum() + brown.PRIOR)
        return math.log10((count[word] + 0.5) * (brown.WEIGHT * step / (size + 0.5 * (kinds[b] + 1)) + (1 - brown.WEIGHT) / scale))
    got = {r.doc_id: r.score for r in brown.score(fitted).collect()}
    for i, t in enumerate(texts):
        words = tokens(t)
        assert got[i] == pytest.approx(sum(log10(a, b) for a, b in zip([b"", *words[:-1]], words, strict=True)), abs=1e-9)


def test_every_word_outside_the_sweeps_takes_its_best_class(spark, monkeypatch):
    """Against the objective itself, computed anew for every class a word might take."""
    monkeypatch.setattr(brown, "SINGLE", 6)
    monkeypatch.setattr(brown, "HEAD", 20)
    monkeypatch.setattr(brown, "CONTEXTS", 50)  # counts of a word come in many rows
    k, texts = 5, some_texts()
    train = [tokens(t) for t in texts]
    docs = make_docs(spark, [(i, t, "en") for i, t in enumerate(texts)]).selectExpr("doc_id", "text", "false as held_out")
    rng = np.random.default_rng(2)
    place = np.append(0, rng.integers(1, k, brown.SINGLE + brown.GROUPS - 1))
    count = collections.Counter(w for t in train for w in t)
    common = sorted((w for w in count if w and len(w) <= 64), key=lambda w: (-count[w], w))[:20]
    lexicon = brown.Lexicon([b"", *common], [count[b""], *(count[w] for w in common)])
    shared = spark.sparkContext.broadcast(lexicon)
    of = {w: int(place[brown.SINGLE + brown.group_of(w)]) for w in count}
    of |= {w: int(place[i]) for i, w in enumerate(lexicon.words[:6])}
    pairs = class_pairs(train, of, k)
    got = {bytes(r.word): r for r in brown.own_classes(brown.encoded(docs, shared), shared, place, pairs).collect()}
    assert set(got) == set(count) - set(lexicon.words[:6])
    for w, r in got.items():
        value = [objective(class_pairs(train, of | {w: c}, k)) for c in range(1, k)]
        assert value[r["class"] - 1] == pytest.approx(max(value), abs=1e-7)
        assert r.n == count[w] and r.place == lexicon.place.get(w, -1)


def test_model_is_a_distribution(odd):
    """Over known words and one unknown word a class, the probabilities after any class add up to one."""
    from pyspark.sql import functions as F
    fitted = brown.fit(odd.withColumn("held_out", F.lit(False)), classes=6, rounds=2)
    model = fitted.model
    table = collections.Counter(w for _, t, _ in odd_rows() for w in tokens(t))
    of = class_of_words(fitted)
    c, n = np.array([of[w] for w in table]), np.array(list(table.values())) + 0.5
    words = (10 ** model.step[:, c] * n).sum(1)
    unknown = (10 ** model.step * 0.5).sum(1)  # one a class
    used = np.bincount(c, minlength=6) > 0
    spare = (1 - brown.WEIGHT) * 0.5 * 5 / model.scale  # the unigram part counts its one unknown in every class
    assert np.allclose((words + unknown - spare)[used], 1, atol=1e-9)


def test_sweep_moves_a_unit_by_its_exact_gain():
    """The first unit of a sweep, one that often follows itself, goes where the objective, computed anew, is best."""
    text = np.array([0, 1, 1, 1, 2, 1, 1, 3, 2, 3, 1, 1, 2, 0] * 3)
    place, k = np.array([0, 1, 2, 3]), 4
    before, after, twice = np.zeros((4, k)), np.zeros((4, k)), np.zeros(4)
    np.add.at(before, (text[1:], place[text[:-1]]), 1)
    np.add.at(after, (text[:-1], place[text[1:]]), 1)
    np.add.at(twice, text[1:][text[1:] == text[:-1]], 1)
    assert before.sum(1).argmax() == 1
    value = []
    for c in range(1, k):
        of = np.array([0, c, 2, 3])
        pairs = np.zeros((k, k))
        np.add.at(pairs, (of[text[:-1]], of[text[1:]]), 1)
        value.append(objective(pairs))
    assert brown.exchange(place, before, after, twice)[1] == 1 + np.argmax(value)


def test_exchange_finds_alternating_classes(spark):
    rng = random.Random(1)
    a, b = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(a) + " " + rng.choice(b) for _ in range(60)), "en") for i in range(60)]
    docs = make_docs(spark, rows).selectExpr("doc_id", "text", "doc_id % 5 = 1 as held_out")
    got = brown.class_scores(docs, classes=3, rounds=4).where("held_out").collect()
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert gain > 0.2  # nearly log10(2) a token


def test_no_training_text(odd, nothing):
    from pyspark.sql import functions as F
    got = brown.class_scores(odd.where("doc_id in (1, 4)").withColumn("held_out", F.lit(True)), classes=4, rounds=1).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(1, 1, 0, 0), (4, 4, 0, 0)}
    assert all(r.base_score == 0 for r in got)  # 0.5 / 0.5
    assert brown.class_scores(nothing.withColumn("held_out", F.lit(True)), classes=4, rounds=1).count() == 0


def test_what_the_class_model_ships_is_small(spark, monkeypatch):
    """Context counts are packed, and a word outside the head crosses the exchanges as numbers, not as lists of rows."""
    from types import SimpleNamespace

    monkeypatch.setattr(brown, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    rng = np.random.default_rng(4)
    counts = rng.poisson(0.2, (3000, 65)).astype(np.int64)
    counts[7, 3] = (1 << 40) + 5
    rows = list(brown._chunks([counts[:, :32], counts[:, 32:64], counts[:, 64:]]))
    assert sum(len(r["counts"]) for r in rows) < counts.size / 4  # less than two bits a cell
    first = brown.unsqueezed(rows[0]["counts"], brown.CHUNK * 65)
    assert (first == np.concatenate([counts[:1024, :32].ravel(), counts[:1024, 32:64].ravel(), counts[:1024, 64]])).all()

    monkeypatch.undo()
    monkeypatch.setattr(brown, "HEAD", 20)
    plans, stage = [], brown.stage

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stage(df, name)
    monkeypatch.setattr(brown, "stage", seen)
    docs = make_docs(spark, [(i, t, "en") for i, t in enumerate(some_texts())]).selectExpr("doc_id", "text", "doc_id % 7 = 3 as held_out")
    assert brown.class_scores(docs, classes=5, rounds=1).count() == len(some_texts())
    plan = dict(plans)["tail-steps"]
    assert "collect_list" not in plan and "MapInArrow" in plan


def test_a_frequent_context_and_a_long_document(spark, monkeypatch):
    """A context met more often than a byte holds, in one task; a document whose words outside the head fill many batches."""
    monkeypatch.setattr(brown, "SINGLE", 2)
    monkeypatch.setattr(brown, "HEAD", 3)
    texts = ["a x " * 1500 + "b y " * 700 + "x x", "a y", "", "zz " * 9000, "a " * 4000 + "q r s", "q r"]
    train = [tokens(t) for t in texts]
    count = collections.Counter(w for t in train for w in t)
    docs = make_docs(spark, [(i, t, "en") for i, t in enumerate(texts)], 2).selectExpr("doc_id", "text", "false as held_out")
    k, fitted = 4, brown.fit(docs, classes=4, rounds=1)
    of = class_of_words(fitted)
    assert {bytes(r.word): r.n for r in fitted.words.collect()} == {w: n for w, n in count.items() if w not in fitted.model.lexicon.place}
    pairs = class_pairs(train, of, k)
    got = brown.transitions(fitted.coded, fitted.tails, len(fitted.model.lexicon.words), fitted.model.classes, k)
    assert (got == pairs).all()
    assert {r.row for r in fitted.tails.collect()} <= {r.row for r in fitted.coded.collect()}
    n, scored = sum(count.values()), brown.score(fitted).collect()
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in scored} == {i: (len(t), len(t), n) for i, t in enumerate(train)}
