"""Language identification by segmentation-marginalised unigrams.

The pieces are a fixed public vocabulary. Each language has a probability per piece; the probability of a word is the sum
over all its segmentations into pieces, by the forward algorithm; a text is the product over its words. Probabilities are
fitted by expectation maximisation over the same segmentations. Words are runs of letters, in lower case, with the
vocabulary's word mark in front.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, slices, texts_of, tidy

#: Training documents of each language: about so many are drawn by a hash of the id (all, where there are fewer).
SAMPLE_PER_LANGUAGE = 8192
ROUNDS = 2
#: Longer words are rescaled at every letter, so that their sums stay in range; the fit leaves out words longer than FIT_CHARS,
#: for its sums hold a number per letter and language. Scores take words of any length.
WORD_CHARS, FIT_CHARS = 48, 1 << 16
#: Letters of a long word whose pieces are looked up at once.
STRIDE = 1 << 12
#: Added to each expected count, in words of the pooled languages; probability of a letter outside the vocabulary.
SMOOTH, UNKNOWN = 0.02, 1e-7
#: Probabilities are scaled by this per letter, so that products of a word stay in range.
SCALE = 16.0
CACHED_WORDS = 200_000

MARK = "▁"
_WORD = re.compile(r"[^\W\d_]+")
#: The same with combining marks, which belong to the letter before them.
_MARKED, _MARKED_WORD = regex.compile(r"\p{M}"), regex.compile(r"(?:[^\W\d_\p{M}]\p{M}*+)+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
UND = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, with their combining marks (numbers written by other than digits go along); none where
    there is no letter."""
    if not any(map(str.isalpha, text)):
        return []
    return (_MARKED_WORD if not text.isascii() and _MARKED.search(text) else _WORD).findall(text.lower())


@dataclass
class Vocabulary:
    """Pieces by length: sorted hashes and the pieces' places."""

    pieces: list[str]
    tables: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, model_file: str) -> Vocabulary:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        return cls.of(pieces)

    @classmethod
    def of(cls, pieces: list[str]) -> Vocabulary:
        tables = []
        for k in range(1, max(map(len, pieces), default=0) + 1):
            at = np.array([i for i, p in enumerate(pieces) if len(p) == k], np.int64)
            h = np.zeros(len(at), np.uint64)
            codes = np.array([[ord(c) for c in pieces[i]] for i in at], np.uint64).reshape(len(at), k)
            for j in range(k):
                h = h * _BASE + codes[:, j]
            order = np.argsort(h)
            tables.append((h[order], at[order]))
        return cls(pieces, tables)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """For words as rows of code points: place of the piece [i, i + k) at (word, i, k - 1), or -1."""
        n, size = codes.shape
        out = np.full((n, size, min(size, len(self.tables))), -1, np.int64)
        h = np.zeros((n, size), np.uint64)
        for k in range(1, out.shape[2] + 1):
            m = size - k + 1
            h = h[:, :m] * _BASE + codes[:, k - 1:]
            keys, at = self.tables[k - 1]
            if len(keys):
                j = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                out[:, :m, k - 1] = np.where(keys[j] == h, at[j], -1)
        return out


class Segmenter:
    """Forward and backward sums over all segmentations, for many words and all languages at once."""

    def __init__(self, vocabulary: Vocabulary, probability: np.ndarray):
        """``probability``: pieces by languages."""
        self.vocabulary, self.langs = vocabulary, probability.shape[1]
        sizes = np.array([len(p) for p in vocabulary.pieces])
        scaled = probability * SCALE ** sizes[:, None]
        # two rows more: a letter that is no piece, and what is no piece at all
        self.p = np.vstack([scaled, np.full((1, self.langs), UNKNOWN * SCALE), np.zeros((1, self.langs))])

    def _groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.array([len(w) + 1 for w in words])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            # words at once: the sums' memory must not grow with the languages, nor with the words' length but for one word
            most = max(1, min(max(16, (1 << 13) // self.langs), (1 << 22) // (int(size) * self.langs)))
            for a in range(0, len(at), most):
                part = at[a:a + most]
                text = "".join(MARK + words[i] for i in part)
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                ids = self.vocabulary.places(codes.reshape(len(part), size))
                ids[:, :, 0][ids[:, :, 0] < 0] = len(self.p) - 2
                yield part, ids

    def _forward(self, ids: np.ndarray) -> np.ndarray:
        n, size, most = ids.shape
        f = np.zeros((size + 1, n, self.langs))
        f[0] = 1
        for j in range(1, size + 1):
            for k in range(1, min(j, most) + 1):
                if (got := ids[:, j - k, k - 1]).max() >= 0:
                    f[j] += f[j - k] * self.p[got]
        return f

    def _forward_scaled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward sums, each divided by itself, and the logarithms of these divisors: for words of any length."""
        n, size, most = ids.shape
        f, log = np.ones((size + 1, n, self.langs)), np.zeros((size + 1, n, self.langs))
        window = np.ones((1, n, self.langs))  # the last sums, relative to the newest
        for j in range(1, size + 1):
            now = np.zeros((n, self.langs))
            for k in range(1, min(j, most) + 1):
                if (got := ids[:, j - k, k - 1]).max() >= 0:
                    now += window[-k] * self.p[got]
            log[j] = log[j - 1] + np.log(now)
            window = np.concatenate([window[1 - most:] if most > 1 else window[:0], now[None]]) / now
        return f, log

    def _log_long(self, word: str) -> np.ndarray:
        """Natural logarithm of a long word's probability, by language; memory does not grow with the word."""
        codes = np.frombuffer((MARK + word).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        most = len(self.vocabulary.tables)
        window, log = np.ones((1, self.langs)), np.zeros(self.langs)
        for a in range(0, len(codes), STRIDE):
            first = max(0, a - most + 1)  # pieces that end in this stride may begin before it
            ids = self.vocabulary.places(codes[None, first:a + STRIDE])[0]
            ids[:, 0][ids[:, 0] < 0] = len(self.p) - 2
            for j in range(a + 1, min(a + STRIDE, len(codes)) + 1):
                k = np.arange(1, min(j, ids.shape[1], len(window)) + 1)
                got = ids[j - k - first, k - 1]
                use = got >= 0
                now = (window[-k[use]] * self.p[got[use]]).sum(0)
                log += np.log(now)
                window = np.concatenate([window[1 - most:], now[None]]) / now
        return log - len(codes) * np.log(SCALE)

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's probability, words by languages."""
        out = np.zeros((len(words), self.langs))
        short = [i for i, w in enumerate(words) if len(w) <= WORD_CHARS]
        for at, ids in self._groups([words[i] for i in short]):
            out[np.array(short)[at]] = np.log(self._forward(ids)[-1]) - ids.shape[1] * np.log(SCALE)
        for i, w in enumerate(words):
            if len(w) > WORD_CHARS:
                out[i] = self._log_long(w)
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, pieces by languages, for words that occur ``counts`` (words by languages) times."""
        out = np.zeros((len(self.p), self.langs))
        for at, ids in self._groups(words):
            n, size, most = ids.shape
            long = size > WORD_CHARS + 1
            f, log = self._forward_scaled(ids) if long else (self._forward(ids), None)
            b = np.zeros((size + 1, n, self.langs))
            b[size] = counts[at] if long else counts[at] / f[size]
            used, weight = [np.zeros(0, np.int64)], [np.zeros((0, self.langs))]
            for i in range(size - 1, -1, -1):
                for k in range(1, min(size - i, most) + 1):
                    got = ids[:, i, k - 1]
                    if (use := np.flatnonzero(got >= 0)).size:
                        flow = self.p[got[use]] * b[i + k][use]
                        if long:  # both sums are relative to their own place
                            flow *= np.exp(log[i][use] - log[i + k][use])
                        b[i][use] += flow
                        used.append(got[use])
                        weight.append(flow * f[i][use])
            used, weight = np.concatenate(used), np.concatenate(weight)
            for g in range(self.langs):
                out[:, g] += np.bincount(used, weight[:, g], len(out))
        return out[:len(self.vocabulary.pieces)]


def fold(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


@dataclass
class Model:
    langs: list[str]
    probability: np.ndarray  # pieces by languages


def fit(docs: DataFrame, model_file: str, sample: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Fit piece probabilities on the labelled documents (columns doc_id, text, lang).

    Rows without a language are left out; null and empty texts add nothing, repeated rows count as often as they are there, and
    without any labelled row the model knows no language. The model has one number per piece and language, whatever the corpus.
    """
    bounded_batches(docs.sparkSession)
    rows = texts_of(docs, F.col("lang").cast("string").alias("lang")).where("lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    vocabulary = Vocabulary.load(model_file)
    p = np.full((len(vocabulary.pieces), len(langs)), 1.0 / len(vocabulary.pieces))
    if not langs:
        return Model([], p)
    share = F.create_map(*(F.lit(x) for g in langs for x in (g, min(1.0, sample / sizes[g]))))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    place = {g: i for i, g in enumerate(langs)}
    out = pa.schema([("piece", pa.int64()), ("lang", pa.int64()), ("n", pa.float64())])

    for _ in range(rounds):
        def expect(batches: Iterator[pa.RecordBatch], p: np.ndarray = p) -> Iterator[pa.RecordBatch]:
            seg = Segmenter(Vocabulary.load(model_file), p)
            total = np.zeros(p.shape)
            for batch in batches:
                for part in slices(batch, "text"):
                    known: dict[str, int] = {}
                    ids, langs_at = [], []
                    for text, g in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                        at = [known.setdefault(w, len(known)) for w in words_of(text) if len(w) <= FIT_CHARS]
                        ids.append(np.array(at, np.int64))
                        langs_at.append(np.full(len(at), place[g]))
                    if known:
                        flat = np.concatenate(ids) * len(place) + np.concatenate(langs_at)
                        counts = np.bincount(flat, minlength=len(known) * len(place)).reshape(len(known), len(place))
                        total += seg.expected(list(known), counts.astype(float))
            i, g = np.nonzero(total > 1e-9)
            yield pa.RecordBatch.from_pydict({"piece": i, "lang": g, "n": total[i, g]}, schema=out)
        got = drawn.mapInArrow(tidy(expect), "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        count = np.zeros(p.shape)
        table = got.toPandas()
        count[table["piece"], table["lang"]] = table["n"]
        pooled = count.sum(1, keepdims=True) + SMOOTH
        p = count + SMOOTH * len(p) * pooled / pooled.sum()
        p /= p.sum(0, keepdims=True)
    return Model(langs, p)


def predict(docs: DataFrame, model: Model, model_file: str, keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and the ``keep`` columns (and the text, if asked), one row per document, from its text alone.

    score is the posterior of the predicted language, all being equally likely before. ``und`` with score 0 where the text
    is null or has no letter, or where no language was learned. Equal posteriors go to the first language by name.
    """
    bounded_batches(docs.sparkSession)
    langs = model.langs
    p = docs.sparkSession.sparkContext.broadcast(model.probability)  # pieces x languages
    base = texts_of(docs, *keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if with_text or f.name != "text"),
                        "lang_pred string", "score double"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(Vocabulary.load(model_file), p.value) if langs else None
        known: dict[str, int] = {}
        table = np.zeros((0, len(langs)))
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [words_of(t) for t in part.column(1).to_pylist()] if langs else [[]] * part.num_rows
                if len(known) > CACHED_WORDS:
                    known, table = {}, table[:0]
                places = [np.fromiter((known.setdefault(w, len(known)) for w in ws), np.int64, len(ws)) for ws in texts]
                if len(known) > len(table):
                    new = [w for w, i in zip(known, range(len(known)), strict=True) if i >= len(table)]
                    table = np.concatenate([table, seg.log_probability(new)])
                pred, prob = [], []
                for at in places:
                    if not len(at):
                        pred.append(UND)
                        prob.append(0.0)
                        continue
                    total = table[at].sum(0)
                    post = np.exp(total - total.max())
                    best = int(np.argmax(post))
                    pred.append(langs[best])
                    prob.append(float(1.0 / post.sum()))
                names = [n for n in part.schema.names if with_text or n != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(pred, pa.string()), pa.array(prob, pa.float64())],
                                                 names=[*names, "lang_pred", "score"])
    return base.mapInArrow(tidy(score), schema)
