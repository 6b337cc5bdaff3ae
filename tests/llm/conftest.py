import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, mark double, score string, word int, ids string"


def make_docs(spark, rows, parts=3):
    """A documents table with further columns whose names operators use inside."""
    full = [(i, t, g, "src", len(t) if t is not None else None, "x", 0.5, None, 7, "y") for i, t, g in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def odd_rows():
    rng = random.Random(4)
    words = ["the", "und", "qui", "Ünïcode", "naïve", "don't", "x" * 60, "3.14", "!!", "日本語", "a"]
    say = lambda n: " ".join(rng.choices(words, k=n))
    long_text = say(12_000)
    rows = [(1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, "one two three", "en"), (5, long_text, "de"),
            (6, long_text, "de"), (6, long_text, "de"), (7, "a" * 30_000, "en"), (8, "!!! 123 ...", "fr"),
            (None, "no id here at all today", "en"), (None, "no id here at all today", "en"), (9, say(80), None),
            (9, say(80), "fr"), (10, " é\r\nx\x0b\x0cy", "fr"), (20, "tail " * 300, "en")]
    rows += [(100 + i, say(40), "en") for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return make_docs(spark, odd_rows()).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return make_docs(spark, [(1, "x", "en")]).where("doc_id < 0")
