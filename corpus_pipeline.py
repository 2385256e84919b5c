"""The corpus pipeline: documents in, packed training sequences out.

STAGES lists (name, function) in order. Each function takes (spark, docs, sf_dir) and returns a DataFrame;
all but the last return the columns of `documents`, the last returns the pieces of the sequences. Columns
that a stage doesn't change are handed through, whatever their names. Empty tables, null texts and repeated
rows pass as each stage says.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panewise.llm import line_chunks, near_join, packing, secrets, word_lang
from panewise.llm.common import fresh, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near duplicates: shingles of five words, similarity of 0.8 or more.
WORDS, NUM, DEN = 5, 80, 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null texts and texts without a letter are `und` and go.

    The model learns from this stage's labelled rows that aren't held out. A null `lang` is filled in.
    Without a single labelled row nothing can be told, and all documents are `und`.
    """
    return word_lang.known(docs, word_lang.train(word_lang.stretches(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of lines that are found before, in this or another document, are cut out; every document
    stays, with an empty text if all its lines go, and with `n_chars` of what is left."""
    told = fresh("line_dedup", docs.columns)
    found = line_chunks.dedup(docs, told=told)
    changed = F.col(f"{told}.n_removed") > 0
    sized = F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars")
    return found.select(*(sized if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links join, the one with the smallest id; documents without a word stay."""
    return near_join.first_of_each(docs, WORDS, NUM, DEN)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark, with `n_chars` of the new text; no document goes."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens; a null text is an empty document."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), most=2048, end=0)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("redact_secrets", redact_secrets),
    ("pack", pack),
]

#: A model and a tokenizer decide, which SQL can't express; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row, each stage's documents written and read again."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = written(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
