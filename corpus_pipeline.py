"""The corpus pipeline: language ID, exact dedup, near dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Null texts
count as empty, repeated rows are documents of their own, empty tables give empty results, and extra columns are carried
along whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, language_id, ngram_join, packing, suffix_dedup
from tidemark.llm.common import one_of_each, read_table, stage, staged_only

PIECES, TOKENIZER = "piece_bpe_32k.model", "byte_bpe_50k.json"


def _aside(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with doc_id, text and lang, its other columns under names that no operator uses."""
    names = [f"carried_{i}" for i in range(len(docs.columns))]
    cols = [F.col(f"`{c}`") for c in docs.columns]
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id"), F.col("text"), lang.alias("lang"),
                       *(c.alias(n) for c, n in zip(cols, names, strict=True))), names


def _back(rows: DataFrame, docs: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns of ``docs`` under their own names, those in ``new`` replaced."""
    return rows.select(*(new.get(c, F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter (``und``) go, and a null ``lang`` becomes the one told."""
    pieces = public_tokenizers.path(PIECES)
    rows, names = _aside(docs)
    model = language_id.fit(rows.where(language_id.fold(F.col("doc_id")) != 0), pieces)
    carried = [n for n, c in zip(names, docs.columns, strict=True) if c != "text"]
    told = language_id.predict(rows, model, pieces, keep=tuple(carried), with_text=True)
    if not model.langs:
        return _back(told.where(F.col("text").rlike(r"\p{L}")), docs, names, text=F.col("text"))
    new = {"text": F.col("text")}
    if "lang" in docs.columns:
        held = F.col(names[docs.columns.index("lang")])
        new["lang"] = F.coalesce(held, F.col("lang_pred").try_cast(docs.schema["lang"].dataType))
    return _back(told.where(F.col("lang_pred") != language_id.UND), docs, names, **new)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    rows, names = _aside(docs)
    return _back(exact_dedup.keep_one(rows), docs, names)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id; documents without words all stay."""
    rows, names = _aside(docs)
    near = stage(ngram_join.near_duplicates(rows), "near")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("least")
    stays = (near.where("n_grams > 0").groupBy("group_key").agg(least).select("least.doc_id", "least.mark").distinct()
             .union(near.where("n_grams = 0").select("doc_id", "mark").distinct())
             .select(F.col("doc_id").alias("row_id"), F.col("mark").alias("row_mark")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = rows.withColumns({"row_id": F.col("doc_id").cast("long"), "row_mark": F.xxhash64(text),
                               "wordless": ~text.rlike(r"[^\x20\x09-\x0D]")})
    return _back(one_of_each(marked, stays, ["row_id", "row_mark"], but=F.col("wordless")), docs, names)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; bytes of a character that was cut through go as well. n_chars follows."""
    rows, names = _aside(docs)
    carried = [n for n, c in zip(names, docs.columns, strict=True) if c != "text"]
    done = suffix_dedup.remove_repeats(rows, keep=tuple(carried), as_text=True)
    text = F.col("text")
    return _back(done, docs, names, text=text, n_chars=F.length(text).cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences, a row per piece."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
                                   ("passage_dedup", passage_stage), ("packing", packing_stage)]

#: Segmentation sums, MinHash candidates and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as a table in the shared folder and read again. What a stage has staged
    itself is removed once its output is written; the outputs stay, as the result is read from the last of them."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        with staged_only() as keep:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}", codec="snappy")
            keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
