"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panewise.llm import (
    host_rules, line_chunks, merkle, near_join, packing, pieces, pii, positions, secrets, sql, token_counts, topk,
    whitening, word_lang,
)
from panewise.llm.common import table, working_dir

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[name] = Query(run, sql)
        return run

    return add


@register("op1_crf_language")
def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taught by documents that aren't held out; every text is labelled."""
    docs = table(spark, sf_dir, "documents")
    found = word_lang.identify(docs, word_lang.train(word_lang.stretches(docs)))
    return found.withColumn("held_out", word_lang.held_out(F.col("doc_id")))


@register("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op3_line_chunks", sql.LINE_CHUNKS)
def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_chunks.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "text", F.col("line_dedup.n_lines"), F.col("line_dedup.n_removed"))


@register("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own per run, so that every count is made here."""
    docs = table(spark, sf_dir, "documents")
    cache = working_dir(spark, "token-counts")
    return token_counts.count_tokens(docs, cache, public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@register("op5_token_group_join")
def op5_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.join(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


@register("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), most=2048, end=0)


@register("op7_pii_boosting")
def op7_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    return secrets.digest_columns(found, pii.KINDS)


@register("op8_host_rules", sql.HOST_RULES)
def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents"))


@register("op9_secret_lexing")
def op9_secret_lexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return secrets.digest_columns(found, secrets.KINDS)


_WHOLE = """select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
    where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"""


@register(
    "op10_pivot_top_k",
    f"""with w as ({_WHOLE}),
    s as (select q.vec_id query_id, x.vec_id vec_id,
            coalesce(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])), 0)::bigint score
        from w q join w x on q.vec_id % 50 = 0 and q.vec_id <> x.vec_id)
    select query_id, rank, vec_id, score from (
        select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
    where rank <= 5""",
)
def op10_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, every 50th id, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.filter("vec_id % 50 = 0"), k=5)


@register("op11_positional_index", sql.CONTAMINATION)
def op11_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = positions.contamination(docs, items, size=10)
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed, "contaminated")


@register("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=16)


@register("op13_merkle_manifest", sql.MANIFEST)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES["pipeline"] = Query(corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
