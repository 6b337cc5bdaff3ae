"""The corpus pipeline's stages on odd rows, and the registration of the queries."""
import collections
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
from tokenizers import Tokenizer

from tests.llm.conftest import make_docs, odd_rows
from tests.llm.test_dedup import brute_cut, brute_links, near_rows
from tidemark.llm.queries import QUERIES, SQL

STAGES = dict(corpus_pipeline.STAGES)


def test_stage_order_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "passage_dedup", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_the_columns(spark, odd, nothing, name):
    got = STAGES[name](spark, odd, "")
    assert got.columns == odd.columns
    assert got.count() > 0
    assert STAGES[name](spark, nothing, "").count() == 0


def test_language_stage_drops_what_has_no_letter(spark, odd):
    got = STAGES["language_id"](spark, odd, "")
    assert sorted(r.text for r in got.collect()) == sorted(t for i, t, _ in odd_rows() if i not in (1, 2, 3, 8))


def test_exact_stage_keeps_one_of_each(spark, odd):
    got = collections.Counter((r.text or "") for r in STAGES["exact_dedup"](spark, odd, "").collect())
    assert got == collections.Counter({t or "": 1 for _, t, _ in odd_rows()})


def test_near_stage_keeps_one_of_each_class(spark, odd):
    rows = near_rows(7)
    _, label = brute_links([t for _, t, _ in rows])
    got = {r.doc_id for r in STAGES["near_dedup"](spark, make_docs(spark, rows), "").collect()}
    assert got == {i for i, _, _ in rows if label[i] == i}
    odd_got = collections.Counter(r.doc_id for r in STAGES["near_dedup"](spark, odd, "").collect())
    assert odd_got[5] == 1 and odd_got[6] == 0 and odd_got[None] == 1 and all(odd_got[i] == 1 for i in (1, 2, 3, 4, 7, 8))


def test_passage_stage_cuts_texts(spark, odd):
    got = STAGES["passage_dedup"](spark, odd, "").collect()
    assert len(got) == len(odd_rows())
    short = [(t or "") for _, t, _ in odd_rows() if t is None or len(t) < 50_000]
    want = [w[3].decode("utf-8", "ignore") for w in brute_cut([t.encode() for t in short], 200)]
    assert sorted(r.text for r in got if r.doc_id not in (5, 6)) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in got)


def planted(columns):
    """The smallest table and, planted among it, copies, near copies, a passage that documents share, texts without letters."""
    rng = random.Random(12)
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    assert list(rows[0]) == columns
    texts = [r["text"] for r in rows]
    passage = " ".join(f"shared{i}" for i in range(60))
    more = [texts[3], texts[3], texts[17], None, "", "12 34 !!", "\u00fc\u6771", passage]
    for i in (20, 21, 22, 23):
        words = texts[i].split()
        words[rng.randrange(len(words))] = "changed"
        more.append(" ".join(words))
    more += [f"{t[:300]} {passage} {t[300:500]}" for t in texts[40:44]]
    top = max(r["doc_id"] for r in rows)
    return rows + [dict(rows[0], doc_id=top + 1 + i, text=t, lang=None) for i, t in enumerate(more)]


def test_run_matches_brute_force(spark, tmp_path):
    """The whole pipeline against plain loops: what stays, what is cut out of it, and its ids in gapless sequences."""
    rows = planted(["doc_id", "text", "lang", "source", "n_chars"])
    schema = pq.read_schema("/root/testdata/sf0.001/documents.parquet")
    pq.write_table(pa.Table.from_pylist(rows, schema), str(tmp_path / "documents.parquet"))
    docs = {r["doc_id"]: r["text"] for r in rows if regex.search(r"\p{L}", r["text"] or "")}
    last = {t: i for i, t in sorted(docs.items())}
    docs = {i: docs[i] for i in sorted(last.values())}
    _, label = brute_links(list(docs.values()))
    docs = {i: t for n, (i, t) in enumerate(docs.items()) if label[n] == n}
    assert len(docs) < len(last) < len(rows) - 3
    cut = brute_cut([t.encode() for t in docs.values()], 200)
    assert sum(c[1] for c in cut) > 4 * 300
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(c[3].decode("utf-8", "ignore"), add_special_tokens=False).ids, 1]
            for i, c in zip(docs, cut, strict=True)}

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        got[r.doc_id].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in got.values():
        parts.sort()
        assert [s for s, _ in parts] == [sum(len(x) for _, x in parts[:k]) for k in range(len(parts))]
    assert {i: [x for _, ids in parts for x in ids] for i, parts in got.items()} == want
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
