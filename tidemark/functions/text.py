"""Text and path expressions (F-08, F-11..F-14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.drift import FALSE_WORDS, TRUE_WORDS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bool_from_words(c) -> Column:
    """F-08: ``lower(trim(x))`` in the true / false word lists, else NULL."""
    w = F.lower(F.trim(_c(c)))
    return F.when(w.isin(TRUE_WORDS), F.lit(True)).when(w.isin(FALSE_WORDS), F.lit(False))


def underscore_name(c) -> Column:
    """F-12: non ``[A-Za-z0-9_]`` -> ``_``, collapse runs, strip ``_`` at both ends."""
    s = F.regexp_replace(F.regexp_replace(_c(c), r"[^A-Za-z0-9_]", "_"), r"_+", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


def file_name(c) -> Column:
    """F-13: last path segment."""
    return F.element_at(F.split(_c(c), "/"), -1)


def file_stem(c, ext: str = ".jsonl") -> Column:
    """F-13: file name without ``ext``."""
    return F.regexp_replace(file_name(c), "\\" + ext + "$" if ext.startswith(".") else ext + "$", "")


def join_uri(base: str, c) -> Column:
    """F-13: ``base`` + ``/`` + value, with exactly one slash between."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(_c(c), "^/+", ""))


def truncate(c, n: int = 100) -> Column:
    """F-14: first ``n`` characters."""
    return F.substring(_c(c), 1, n)
