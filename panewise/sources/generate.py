"""Seeded tables: Zipf words, keyed payload lines, and a rate-controlled word stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panewise.functions.checks import positive
from panewise.functions.draws import Draw, below, hash_draw, letters
from panewise.operators.zipf import draw_words, word_table

# Fixed value: payloads are drawn from a pool of this many strings.
POOL = 1000

# A pool up to this many bytes is sent to every executor; longer payloads are made in each row.
BROADCAST_POOL_BYTES = 32 << 20

# Keys are read back as 32-bit integers, by this library's parser too.
MAX_KEYS = (1 << 31) - 1


def zipf_words(spark: SparkSession, rows: int, words: int, skew: float, seed: int = 0) -> DataFrame:
    """`value STRING`: `rows` Zipf-distributed words out of "1".."words"."""
    positive(rows=rows)
    drawn = draw_words(spark.range(rows), "id", words, skew, seed)
    return drawn.select(F.col("word").alias("value"))


def key_payloads(
    rows: DataFrame, id_: str, keys: int, length: int, seed: int = 0, draw: Draw = hash_draw
) -> DataFrame:
    """`id_, value`: a `key payload` line per row, the key uniform in [0, keys)."""
    positive(keys=keys)
    if length < 0 or keys > MAX_KEYS:
        raise ValueError(f"length must be at least 0 and keys at most {MAX_KEYS}")
    drawn = rows.select(
        id_,
        below(draw(F.col(id_), seed), keys).alias("__key"),
        below(draw(F.col(id_), seed + 1), POOL).alias("__pool"),
    )
    line = F.concat_ws(" ", F.col("__key").cast("string"), "__payload")
    if POOL * length > BROADCAST_POOL_BYTES:
        payload = letters(F.col("__pool"), length, seed + 2, draw)
        return drawn.withColumn("__payload", payload).select(id_, line.alias("value"))
    pool = rows.sparkSession.range(POOL).select(
        F.col("id").alias("__pool"), letters(F.col("id"), length, seed + 2, draw).alias("__payload")
    )
    return drawn.join(F.broadcast(pool), "__pool").select(id_, line.alias("value"))


def key_payload_lines(spark: SparkSession, rows: int, keys: int, length: int, seed: int = 0) -> DataFrame:
    """`value STRING`: `rows` lines `key payload`."""
    positive(rows=rows)
    return key_payloads(spark.range(rows), "id", keys, length, seed).select("value")


def word_stream(
    spark: SparkSession, rate: int, threads: int, words: int, skew: float, seed: int = 0
) -> DataFrame:
    """A stream `timestamp, value`: Zipf words, a batch each trigger.

    Each of `threads` senders has the whole-number share rate / threads, so a batch has
    threads * (rate // threads) words; start it with `trigger(processingTime="1 second")`.
    """
    positive(rate=rate, threads=threads)
    share = rate // threads
    positive(share_of_each_thread=share)
    ticks = (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", share * threads)
        .option("advanceMillisPerBatch", 1000)
        .load()
    )
    drawn = draw_words(ticks, "value", words, skew, seed, table=word_table(spark, words, skew, seed))
    return drawn.select("timestamp", F.col("word").alias("value"))
