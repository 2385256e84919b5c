"""Seeded random draws that depend on a row's id alone.

`rand()` depends on how the rows are partitioned, so a retried or repartitioned stage would draw
other values. These draws hash the id and give the same table under any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

Draw = Callable[[Column, int], Column]

_LETTERS = 26


def hash_draw(id_: Column, seed: int) -> Column:
    """Uniform DOUBLE in [0, 1) from the id and a seed: 53 bits of a 64-bit hash."""
    bits = F.shiftrightunsigned(F.xxhash64(id_.cast("bigint"), F.lit(seed).cast("bigint")), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def md5_draw(id_: Column, seed: int) -> Column:
    """As `hash_draw`, from 52 bits of an MD5: slower, but other SQL engines can repeat it."""
    digest = F.md5(F.concat_ws(":", id_.cast("string"), F.lit(str(seed))).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return bits.cast("double") / F.lit(float(1 << 52))


def below(draw: Column, bound: Column | int) -> Column:
    """A [0, 1) draw as a BIGINT in [0, bound)."""
    bound = F.lit(bound).cast("bigint") if isinstance(bound, int) else bound.cast("bigint")
    return F.least(F.floor(draw * bound).cast("bigint"), bound - 1)


def letters(id_: Column, length: int, seed: int, draw: Draw = hash_draw) -> Column:
    """A string of `length` lowercase letters drawn for the id."""
    if length == 0:
        return F.lit("")
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(length - 1).cast("bigint"))

    def letter(place: Column) -> Column:
        return F.char(F.lit(ord("a")) + below(draw(id_ * length + place, seed), _LETTERS))

    return F.array_join(F.transform(places, letter), "")
