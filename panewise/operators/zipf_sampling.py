"""Zipf ranks drawn row by row: no table of words, no join, any number of words.

The weights k^-skew of ranks lie under a curve whose area has a closed form. A uniform draw from that area, turned
back into a place on the axis, gives a rank; it is accepted if the draw lies in the rank's own column, else the
next draw of the row decides (rejection-inversion). At least four of five draws are accepted whatever the
skew and the number of words, so a row needs about one.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, functions as F

from panewise.functions.checks import positive
from panewise.functions.draws import Draw, hash_draw
from panewise.functions.permute import Noise, hash_noise, permuted
from panewise.operators.zipf import check_skew

#: Draws of a row; that all of them are rejected has a chance below 1 in 2^70.
TRIES = 32
# Beyond this a whole number and its half are no longer apart in a DOUBLE.
MAX_WORDS = 1 << 51


def area(x: float, skew: float) -> float:
    """The area under t^-skew from 1 to x."""
    return log(x) if skew == 1.0 else (x ** (1.0 - skew) - 1.0) / (1.0 - skew)


def place(y: float, skew: float) -> float:
    """The x whose area is y."""
    return exp(y) if skew == 1.0 else (1.0 + y * (1.0 - skew)) ** (1.0 / (1.0 - skew))


def bounds(words: int, skew: float) -> tuple[float, float, float]:
    """The areas that draws lie between, and the distance to the left of a rank that needs no test."""
    return area(1.5, skew) - 1.0, area(words + 0.5, skew), 2.0 - place(area(2.5, skew) - 2.0**-skew, skew)


def sampled_rank(id_: Column, words: int, skew: float, seed: int = 0, draw: Draw = hash_draw) -> Column:
    """A rank of 1..words for an id, with a chance proportional to rank^-skew; the same on every read."""
    positive(words=words)
    check_skew(skew)
    if words > MAX_WORDS:
        raise ValueError(f"words must be at most {MAX_WORDS}, got {words}")
    least, most, sure = bounds(words, skew)

    def one(t: int) -> Column:
        y = F.lit(most) + draw(id_, seed * TRIES + t) * F.lit(least - most)

        def tried(y: Column) -> Column:
            if skew == 1.0:
                x = F.exp(y)
            else:
                x = F.pow(F.lit(1.0) + y * F.lit(1.0 - skew), F.lit(1.0 / (1.0 - skew)))
            return F.get(F.transform(F.array(x), lambda x: accepted(x, y)), F.lit(0))

        def accepted(x: Column, y: Column) -> Column:
            rank = F.least(F.greatest(F.floor(x + 0.5), F.lit(1).cast("bigint")), F.lit(words).cast("bigint"))
            return F.get(F.transform(F.array(rank), lambda k: F.when((k - x <= F.lit(sure)) | (y >= column(k)), k)), F.lit(0))

        def column(k: Column) -> Column:
            """The area up to the middle between a rank and the next, less the rank's own weight."""
            k = k.cast("double")
            if skew == 1.0:
                return F.log(k + 0.5) - 1.0 / k
            upto = (F.pow(k + 0.5, F.lit(1.0 - skew)) - 1.0) / F.lit(1.0 - skew)
            return upto - F.pow(k, F.lit(-float(skew)))

        return F.get(F.transform(F.array(y), tried), F.lit(0))

    none = F.raise_error(F.lit(f"no draw of {TRIES} was accepted")).cast("bigint")
    return F.coalesce(*[one(t) for t in range(TRIES)], none)


def sample_words(
    rows: DataFrame, id_: str, words: int, skew: float, seed: int = 0, draw: Draw = hash_draw, noise: Noise = hash_noise
) -> DataFrame:
    """Add `rank` and `word` to every row of a table or stream, drawn by its id: words are "1".."words", ranked in
    a seeded random order. Nothing is joined or shuffled."""
    ranked = rows.withColumn("rank", sampled_rank(F.col(id_), words, float(skew), seed, draw))
    return ranked.withColumn("word", (permuted(F.col("rank") - 1, words, seed, noise) + 1).cast("string"))
