"""Token counts from a cache keyed by digests of content and tokenizer.

Counts are stored under a digest of the text, its white space normalised as far as the tokenizer's own
rules do, and a digest of the tokenizer file. A run joins its texts to the stored counts, encodes each
distinct missing text once and appends its count.

A null text counts as an empty one; texts of any length are counted whole. Repeated rows and rows without an id keep a row each. Other columns
of the documents are not read, so their names don't matter. The cache only ever grows by whole, committed
files; a text that two runs append at the same time is there twice with the same count, and read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from panewise.llm.common import ASCII_SPACE, by_size, in_batches, same, written
from panewise.llm.segments import Encoder, Vocabulary

CACHE = StructType([StructField("content", BinaryType()), StructField("n_tokens", LongType())])


def content_digest(text: Column, vocabulary: Vocabulary) -> Column:
    text = F.coalesce(text, F.lit(""))
    if vocabulary.collapses_space():
        text = F.trim(F.regexp_replace(text, f"{ASCII_SPACE}+", " "))
    return F.unhex(F.sha2(text, 256))


def stored(spark: SparkSession, cache: str, vocabulary: Vocabulary) -> DataFrame:
    """`content, n_tokens` of the cache for this tokenizer, one row each; none if there is no cache yet."""
    path = _folder(cache, vocabulary)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _folder(cache: str, vocabulary: Vocabulary) -> str:
    return f"{cache.rstrip('/')}/tokenizer={vocabulary.digest}"


def _counter(vocabulary: Vocabulary):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in by_size(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            counts = pa.array(encoder.counts(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("content"), counts], names=["content", "n_tokens"])

    return count


def count_tokens(
    docs: DataFrame, cache: str, tokenizer: str, limit: int = 2048, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`id, n_bytes, n_tokens, over_limit` per row; missing counts are appended to the cache first.

    `tokenizer` is the path of a tokenizers file on the driver. The texts that are encoded pass one
    shuffle, by digest and id, so thousands of copies send one text.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary.read(tokenizer)
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    texts = texts.withColumn("content", content_digest(F.col("text"), vocabulary))
    rows = written(
        texts.select("id", "content", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")),
        "digests",
    )
    first = rows.groupBy("content").agg(F.min("id").alias("id"))
    missing = first.join(stored(spark, cache, vocabulary), "content", "left_anti")
    chosen = texts.alias("t").join(
        missing.alias("m"),
        (F.col("t.content") == F.col("m.content")) & same(F.col("t.id"), F.col("m.id")),
        "left_semi",
    )
    counted = in_batches(chosen.select("content", "text"), _counter(vocabulary), CACHE)
    counted.write.mode("append").parquet(_folder(cache, vocabulary))
    # Written, so that the last join has two plain sides and a digest with many rows can be split.
    counts = written(first.select("content").join(stored(spark, cache, vocabulary), "content"), "counts")
    return rows.join(counts, "content", "left").select(
        F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
