"""Url verdicts, license scans and the prefix forest."""
import hashlib
import pathlib
import textwrap

import numpy as np
import pytest

from tests.llm.conftest import odd_rows
from tidemark.llm import licenses, prefix_forest, url_filter
from tidemark.llm.components import connected_components


# --- components and urls ---

def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(40)] + [(500, 500), (7, 3), (None, 4), (600, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, **{200 + i: 100 for i in range(40)}, 500: 500}


PAGES = [
    (1, "https://a.example.com/en/x", ""), (2, "https://www.EXAMPLE.com/en/x#top", ""), (3, "http://h.net/es/1?q", None),
    (4, "http://h.net/de/1", '<link rel="canonical" href="http://h.net/es/1?q">'),         # alias of a blocked url
    (5, "http://o.org/1", '<META http-equiv=refresh content="0; URL=http://h.net/fr/9">'),  # redirects to a blocked url
    (6, "http://o.org/2", "<link href='http://o.org/1' rel='canonical'>"),                  # alias of that alias
    (7, "http://o.org/3", '<link rel="canonical" href="http://mix.net/fr/">'),
    (8, "http://o.org/4", '<link rel="canonical" href="http://o.org/3">'),
    (9, "http://plain.com/ok", '<link rel="canonical" href="http://o.org/4">'),             # allowed: the group has an allow
    (10, "http://example.com", ""), (11, "mailto:x@y.net", ""), (12, None, None), (13, "", ""), (14, "http://o.org/z", ""),
    (14, "http://o.org/z", ""), (None, "http://net/es/", ""), (15, "http://anet/es/", ""),
    (16, "http://" + "a." * 3000 + "net/es/" + "p" * 5000, ""),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "c", 1, "r", True) for p in PAGES],
                                 "page_id long, url string, html string, component string, rule int, host string, blocked boolean").repartition(3)


def test_verdicts(pages):
    got = {}
    for r in url_filter.judge(pages).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    assert got[1] == [("a.example.com", "/en/x", "example.com/en/", "block")]
    assert got[2] == [("www.example.com", "/en/x", "www.example.com/en/", "allow")]
    assert got[3] == [("h.net", "/es/1", "net/es/", "block")]
    assert got[4] == [("h.net", "/de/1", None, "block")]
    assert got[5][0][2:] == (None, "block") and got[6][0][2:] == (None, "block")
    assert got[7][0][2:] == (None, "allow") and got[8][0][2:] == (None, "allow")
    assert got[9][0][2:] == ("com/", "allow")
    assert got[10] == [("example.com", "", None, "allow")]
    assert got[11] == got[12] == got[13] == [("", "", None, "allow")]
    assert got[14] == [("o.org", "/z", None, "allow")] * 2
    assert got[None] == [("net", "/es/", "net/es/", "block")]
    assert got[15] == [("anet", "/es/", None, "allow")]
    assert got[16][0][2:] == ("net/es/", "block")
    assert len(got) == 17


MARKUP = {
    "https://s.org/a": '<link rel="canonical" ' + 'data-x="' + "y" * 900 + '" href="http://t.net/1">', "https://s.org/b": '<link rel=canonical href="/1?a=1&amp;b=2">',
    "https://s.org/c": '<link rel="x canonical" href="//t.net/1">', "https://s.org/d/e": "<link href=../f rel=canonical>",
    "https://s.org/g": '<base href="https://u.org/v/"><LINK REL=canonical data-q="a>b" HREF=w>',
    "https://s.org/h": '<meta http-equiv="refresh" content="0; url=/i?x=1&#38;y=2">', "https://s.org/j": """<meta content='3;URL="k"' http-equiv=Refresh>""",
    "https://s.org/l": '<meta http-equiv="refresh" content="30">', "https://s.org/m": '<link rel="canonical-x" href="http://t.net/2">',
    "https://s.org/n": '<link rel="canonical" href="mailto:x@y">', "https://s.org/o": '<link rel="canonical" title="href=/no" href="/yes">',
    "https://s.org/p": "<link " + "x='1' " * 5000 + 'rel="canonical" href="http://t.net/3">',
    "https://s.org/q": "<link " + 'x="a>b" ' * 400 + 'rel="canonical" href="http://t.net/4">',
    "https://s.org/r": '<!-- <link rel="canonical" href="http://t.net/5"> --><script>"<link rel=canonical href=http://t.net/6>"</script>',
    "https://s.org/s": '<style>/* <link rel="canonical" href="/no"> */</style><!-- open <link rel="canonical" href="/no">',
    "https://s.org/t": '<link rel="canonical" href="HTTP://T.Net/Path?Q">', "https://s.org/u": '<link rel="canonical" href="http://t.net/7"',
    "https://s.org/v": '<link rel="canonical" href= "/w" / disabled><link rel=canonical href=/second rel=other>',
}


def test_targets_in_mark_up(spark):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(MARKUP.items())], "page_id long, url string, html string")
    assert {(r.src.removeprefix("https://s.org/"), r.dst) for r in url_filter.page_edges(pages).collect()} == {
        ("a", "http://t.net/1"), ("b", "https://s.org/1?a=1&b=2"), ("c", "https://t.net/1"), ("d/e", "https://s.org/f"), ("g", "https://u.org/v/w"),
        ("h", "https://s.org/i?x=1&y=2"), ("j", "https://s.org/k"), ("o", "https://s.org/yes"), ("p", "http://t.net/3"),
        ("q", "http://t.net/4"), ("t", "http://t.net/Path?Q"), ("v", "https://s.org/w"), ("v", "https://s.org/second")}


def test_letter_case_of_scheme_and_host(spark):
    pages = spark.createDataFrame([(1, "HTTP://O.Org/x", '<link rel="canonical" href="http://h.net/es/1">'), (2, "http://o.org/x", ""),
                                   (3, "http://o.org/X", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.component) for r in url_filter.judge(pages).collect()}
    assert got == {1: ("block", "http://h.net/es/1"), 2: ("block", "http://h.net/es/1"), 3: ("allow", None)}


def test_redirect_log_and_empty_table(spark, pages):
    log = spark.createDataFrame([("http://o.org/z", "http://h.net/es/1?q"), (None, "x")], "src string, dst string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, log).collect()}
    assert got[14] == "block"
    assert url_filter.judge(pages.where("page_id < 0")).count() == 0


# --- licenses ---

def test_equivalent_forms_have_one_digest(spark):
    mit = dict(licenses.TEXTS)["BSD-3-Clause"]
    noisy = "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit.replace(" ", "  ").replace("HOLDER", "holder").upper()
    rows = [(1, mit), (2, noisy), (3, mit + " more"), (4, None), (5, ""), (6, "Some text\nReleased under the MIT Licence!\nmore"),
            (6, "Some text\nReleased under the MIT Licence!\nmore"), (7, "© 2021 x\n"), (None, "SPDX-License-Identifier: MIT"),
            (8, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\n" + "word " * 50_000)]
    docs = spark.createDataFrame([(*r, "l", "f", 3) for r in rows], "doc_id long, text string, license string, form string, canonical_sha256 int")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.notices, r.canonical_sha256))
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1] == got[2] and got[1][0][0] == "BSD-3-Clause"
    assert got[3][0][:2] == (None, "")
    assert got[4] == got[5] == got[7] == [(None, "", empty)]
    assert [g[:2] for g in got[6]] == [(None, "MIT")] * 2
    assert got[None][0][1] == "MIT" and got[8][0][1] == "CC-BY-NC-4.0,MIT"
    assert licenses.scan(docs.where("doc_id < 0")).count() == 0


HOLDERS = ["Copyright (c) Microsoft Corporation.", "Copyright Joyent, Inc. and other Node contributors.", "Copyright: 2020 x",
           "Portions Copyright (c) 2019 x", "// Copyright The Go Authors. All rights reserved.", "(c) Jane Doe", "© Jane Doe",
           "Copyright by Jane Doe", "Copyright (c) 2020 A very long name of a\nholder, Inc. All rights reserved.", "(C) 2020 x"]


def test_lines_of_holders_go_and_own_sentences_stay(spark):
    bsd = dict(licenses.TEXTS)["BSD-3-Clause"]
    thin = "\n".join(textwrap.fill(p, 20) for p in bsd.split("\n\n"))  # lines begin with "copyright holder", "copyright notice"
    own = ["(c) You must retain, in the Source form, all copyright", "copyright notice, this list", "COPYRIGHT OWNER OR", "copyright, patent",
           "copyright license to reproduce", "Copyright and Related Rights", "copyright the software, and"]
    rows = [*((i, h + "\n\n" + bsd) for i, h in enumerate(HOLDERS)), (50, thin), *((100 + i, o) for i, o in enumerate(own))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.license for i, r in got.items() if i <= 50} == dict.fromkeys([*range(len(HOLDERS)), 50], "BSD-3-Clause")
    empty = hashlib.sha256(b"").hexdigest()
    assert all(got[100 + i].canonical_sha256 != empty for i in range(len(own)))


def test_usual_licenses_titles_and_notices(spark):
    held = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1",
            "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2",
            "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause"}
    folder = pathlib.Path("/usr/share/common-licenses")
    want = [(k, (folder / f).read_text()) for f, k in held.items() if (folder / f).exists()]
    apache = next((t for k, t in want if k == "Apache-2.0"), None)
    if apache:
        want.append(("Apache-2.0", apache[:apache.index("APPENDIX")]))
    bare = {k: t for k, t in licenses.TEXTS if "License\n\n" not in t}
    want += [(k, f"{title}\n\nCopyright (c) 2020 X\n\n{bare[k]}") for k, title in (
        ("MIT", "The MIT License (MIT)"), ("MIT", "The MIT License"), ("ISC", "The ISC License"), ("ISC", "ISC License (ISC)"),
        ("BSD-2-Clause", 'BSD 2-Clause "Simplified" License'), ("BSD-3-Clause", "The 3-Clause BSD License"), ("0BSD", "BSD Zero Clause License"))]
    want.append(("MIT-0", dict(licenses.TEXTS)["MIT-0"].removeprefix("MIT No Attribution\n\n")))
    said = [("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"), ("ISC", "Licensed under the ISC License."),
            ("LGPL-2.1", "Released under the GNU Lesser General Public License, version 2.1"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(want)] + [(1000 + i, t) for i, (_, t) in enumerate(said)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[i].license for i in range(len(want))] == [k for k, _ in want]
    assert [got[1000 + i].notices for i in range(len(said))] == [k for k, _ in said]
    assert len(got) == len(want) + len(said)


def test_scan_runs_no_python(odd):
    plan = licenses.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert licenses.scan(odd).count() == len(odd_rows())


# --- prefix forest ---

def vectors(spark, x, ids=None, extra=()):
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)] + list(extra)
    return spark.createDataFrame([(*r, 1, "q", 2) for r in rows], "vec_id long, embedding array<double>, tree int, query_id string, v int").repartition(3)


def brute(x, ids, q, k):
    s = (x * x[q]).sum(1)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return {int(ids[i]) for i in order}


@pytest.mark.parametrize("ranges", [{}, {"range_rows": 50, "range_queries": 3}])
def test_recall_and_scores(spark, ranges):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(8, 24))
    x = (centre[rng.integers(0, 8, 600)] + 0.5 * rng.normal(size=(600, 24))) * rng.uniform(0.5, 2, (600, 1))
    ids = rng.permutation(600)
    got = {}
    for r in prefix_forest.search(vectors(spark, x, ids), k=10, **ranges).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    at = {int(i): n for n, i in enumerate(ids)}
    assert set(got) == {i for i in range(600) if i % 20 == 0}
    hit = 0
    for q, rows in got.items():
        assert [r[0] for r in rows] == list(range(1, 11))
        assert all(abs(s - x[at[q]] @ x[at[v]]) < 1e-9 for _, v, s in rows)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        hit += len({v for _, v, _ in rows} & brute(x, ids, at[q], 10))
    assert hit / (10 * len(got)) >= 0.9


def test_single_precision_components_give_the_same_rows(spark):
    from pyspark.sql import functions as F
    x = np.random.default_rng(5).normal(size=(300, 12)).astype(np.float32).astype(float)
    x[0] = float(np.float32(3e38))  # squares and products leave single precision
    both = vectors(spark, x), vectors(spark, x).withColumn("embedding", F.col("embedding").cast("array<float>"))
    a, b = (sorted(map(tuple, prefix_forest.search(v, k=7, range_rows=50).collect())) for v in both)
    assert a == b and len(a) == 15 * 7


def test_copies_ties_and_unusable_vectors(spark):
    x = np.tile([[1.0, 0.0, 0.0]], (200, 1))
    bad = [(300, None), (320, [0.0, 0.0, 0.0]), (340, [1.0, None, 0.0]), (360, [float("nan"), 1.0, 0.0]), (380, [float("inf"), 0.0, 0.0]),
           (400, []), (420, [1.0, 2.0]), (None, [1.0, 0.0, 0.0]), (20, [1.0, 0.0, 0.0])]
    got = {}
    for r in prefix_forest.search(vectors(spark, x, extra=bad), k=5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {i for i in range(200) if i % 20 == 0}
    assert [got[0][r][0] for r in range(1, 6)] == [1, 2, 3, 4, 5] and [got[20][r][0] for r in range(1, 6)] == [0, 1, 2, 3, 4]
    assert all(s == 1.0 for g in got.values() for _, s in g.values())


def test_few_rows_and_none(spark):
    x = np.eye(3)
    got = prefix_forest.search(vectors(spark, x), k=20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0)]
    none = vectors(spark, x).where("vec_id < 0")
    assert prefix_forest.search(none).count() == 0


def near_copies(rng):
    return 1.0 + 1e-7 * rng.normal(size=(1500, 8))


@pytest.mark.parametrize("make", [lambda rng: rng.integers(0, 2, (1500, 24)).astype(float), near_copies,
                                  lambda rng: 1e20 * rng.normal(size=(600, 8)), lambda rng: rng.choice([-1.0, 1.0], (1500, 24))],
                         ids=["bits", "near_copies", "large", "signs"])
def test_all_visited_rows_are_ranked_in_double(spark, make):
    x = make(np.random.default_rng(5))
    x[0] = 1.0
    ids = np.random.default_rng(6).permutation(len(x))
    at = {int(i): n for n, i in enumerate(ids)}
    got = {}
    for r in prefix_forest.search(vectors(spark, x, ids), every=100, k=20, trees=2, target=1.1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i in range(len(x)) if i % 100 == 0}
    for q, rows in got.items():
        s = (x * x[at[q]]).sum(1)
        assert rows == [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]


def test_products_past_the_largest_double_are_ranked(spark):
    x = np.array([[1e200, 1e200], [1e200, -1e200], [-1e200, -1e200], [1.0, 1.0], [3.0, -1.0]])
    got = prefix_forest.search(vectors(spark, x), target=1.1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, 2e200), (4, 2e200), (1, 0.0), (2, -np.inf)]
