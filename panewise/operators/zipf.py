"""Zipf-distributed words: the probability table, and a word for every row of a table.

Word of rank i is drawn with a probability proportional to i^-skew. Probabilities are whole-number
weights, so their running sums tile [0, total) exactly and in any order of addition: every draw falls
in one interval [lo, hi), never before the first or past the last.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panewise.functions.arith import div
from panewise.functions.checks import positive
from panewise.functions.draws import Draw, below, hash_draw
from panewise.operators.ranges import explode_range
from panewise.operators.running import UPPER_BITS, running_sum
from panewise.sources.io import written

# Up to this many words the table, cut into bins, is at most 2,000,000 rows of four numbers (about
# 100 MB): worth sending to every executor, as the other way shuffles every draw.
BROADCAST_WORDS = 1_000_000

# Ranks are mixed with a prime that must be larger than their number: one of 31 bits while products with it
# fit a BIGINT, one of 61 bits beyond.
_PRIME_31 = (1 << 31) - 1
_PRIME_61 = (1 << 61) - 1

# Weights tile a range that a draw of 52 bits can reach every part of, so there can't be more words.
MAX_WORDS = 1 << 50

_TOTAL_BITS = 51


def weight_scale(words: int, skew: float) -> float:
    """Weight of rank 1 such that all weights sum to less than 2^51, exact in a DOUBLE."""
    if skew == 1.0:
        tail = log(words)
    else:
        tail = (words ** (1.0 - skew) - 1.0) / (1.0 - skew)
    return float(1 << (_TOTAL_BITS - ceil(log(1.0 + max(tail, 0.0), 2)) - 1))


def check_skew(skew: float) -> None:
    if not skew >= 0.0 or skew == float("inf"):
        raise ValueError(f"skew must be a number of at least 0, got {skew!r}")


def zipf_weights(ranks: DataFrame, rank: str, skew: float, scale: float) -> DataFrame:
    """Add `weight BIGINT` = floor(scale / rank^skew), 1 at least: no rank is too rare to be drawn."""
    exact = F.floor(F.lit(scale) / F.pow(F.col(rank).cast("double"), F.lit(float(skew)))).cast("bigint")
    return ranks.withColumn("weight", F.greatest(exact, F.lit(1).cast("bigint")))


def zipf_ranks(
    spark: SparkSession, words: int, skew: float, scale: float | None = None
) -> DataFrame:
    """`rank, weight` for ranks 1..words."""
    positive(words=words)
    check_skew(skew)
    if words > MAX_WORDS:
        raise ValueError(f"words must be at most {MAX_WORDS}, got {words}")
    ranks = spark.range(1, words + 1).withColumnRenamed("id", "rank")
    return zipf_weights(ranks, "rank", skew, scale or weight_scale(words, skew))


def zipf_cdf(
    spark: SparkSession, words: int, skew: float, seed: int = 0, scale: float | None = None
) -> DataFrame:
    """`rank, lo, hi, word` for ranks 1..words; words are "1".."words" in a seeded order."""
    weighted = zipf_ranks(spark, words, skew, scale)
    summed = running_sum(weighted, "rank", F.col("weight"), "hi", bits=(UPPER_BITS,))
    return summed.select(
        "rank", (F.col("hi") - F.col("weight")).alias("lo"), "hi", word_of_rank("rank", words, seed)
    )


def word_of_rank(rank: str, words: int, seed: int) -> Column:
    """`word`: a number of 1..words as text, each used once.

    Ranks are spread by a step that shares no factor with `words`: a power of a larger prime.
    """
    if words < _PRIME_31:
        step = pow(_PRIME_31, seed + 1, words)
        place = F.pmod(F.col(rank).cast("bigint") * step + seed % words, F.lit(words).cast("bigint"))
    else:
        step = F.lit(str(pow(_PRIME_61, seed + 1, words))).cast("decimal(19,0)")
        product = F.col(rank).cast("decimal(18,0)") * step + F.lit(seed % words).cast("decimal(18,0)")
        place = F.pmod(product, F.lit(str(words)).cast("decimal(18,0)")).cast("bigint")
    return (place + 1).cast("string").alias("word")


@dataclass(frozen=True)
class WordTable:
    """The intervals of all words by bin, written once, and the numbers a draw needs to find its bin."""

    binned: DataFrame
    total: int
    width: int
    words: int


def word_table(
    spark: SparkSession, words: int, skew: float, seed: int = 0, scale: float | None = None
) -> WordTable:
    """For streams: `draw_words` with it works out no weights again in each micro-batch."""
    total = zipf_ranks(spark, words, skew, scale).agg(F.sum("weight")).first()[0]
    width = (total + words - 1) // words
    return WordTable(written(_binned(zipf_cdf(spark, words, skew, seed, scale), F.lit(width)), "words"), total, width, words)


def _binned(cdf: DataFrame, width: Column) -> DataFrame:
    return explode_range(cdf, div(F.col("lo"), width), div(F.col("hi") - 1, width), "__bin")


def draw_words(
    rows: DataFrame,
    id_: str,
    words: int,
    skew: float,
    seed: int = 0,
    draw: Draw = hash_draw,
    scale: float | None = None,
    table: WordTable | None = None,
) -> DataFrame:
    """Add `rank` and `word` to every row (batch or stream), drawn by its id.

    Draws and intervals meet on a bin of [0, total): bins are as many as words, so a bin has two
    intervals on average, and draws are uniform over bins however skewed the words are.
    """
    spark = rows.sparkSession
    if table is None:
        total = zipf_ranks(spark, words, skew, scale).agg(F.sum("weight")).scalar()
        width = div(total + (words - 1), words)
        binned = _binned(zipf_cdf(spark, words, skew, seed, scale), width)
    else:
        binned, total, width = table.binned, F.lit(table.total), F.lit(table.width).cast("bigint")
    at = F.col("__at")
    drawn = rows.withColumn("__at", below(draw(F.col(id_), seed), total))
    drawn = drawn.withColumn("__bin", div(at, width))
    if words <= BROADCAST_WORDS:
        binned = F.broadcast(binned)
    else:
        binned = binned.hint("merge")
    return (
        drawn.join(binned, "__bin")
        .where((at >= F.col("lo")) & (at < F.col("hi")))
        .drop("__bin", "__at", "lo", "hi")
    )
