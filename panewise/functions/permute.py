"""A seeded random order of 0..n-1 that is worked out number by number, without a table or a sort.

A number is a place in a grid of about sqrt(n) x sqrt(n). Each round moves it along one side by an amount that is a
hash of its place on the other, which can be undone, so all rounds together put every place of the grid
somewhere else (a Feistel network on two sides of any lengths). The grid is at most one row larger than n; a
number that lands outside is moved on until it is inside, which keeps every number in one place.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, functions as F

from panewise.functions.arith import div
from panewise.functions.checks import positive

ROUNDS = 6
#: Moves of a number that lands outside. A grid has fewer places outside than a side, so sides of up to this
#: length never need more, and longer ones with a chance of one in a side's length for each move.
WALKS = 64

#: BIGINT of at least 0 from a place and the key of a round.
Noise = Callable[[Column, int], Column]


def hash_noise(place: Column, key: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(place.cast("bigint"), F.lit(key).cast("bigint")), 11)


def md5_noise(place: Column, key: int) -> Column:
    """As `hash_noise`, slower; other SQL engines can repeat it."""
    digest = F.md5(F.concat_ws(":", place.cast("string"), F.lit(str(key))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def grid(n: int) -> tuple[int, int]:
    """The sides of the grid: their product is at least n, and less than n plus the first side."""
    rows = isqrt(n - 1) + 1
    return rows, -(-n // rows)


def permuted(number: Column, n: int, seed: int = 0, noise: Noise = hash_noise, rounds: int = ROUNDS) -> Column:
    """The place of a number of 0..n-1 in the order, again of 0..n-1; every place once."""
    positive(n=n, rounds=rounds)
    high, low = grid(n)

    def round_of(i: int) -> Callable[[Column], Column]:
        key = seed * rounds + i
        if i % 2:
            return lambda p: F.struct(p["a"].alias("a"), ((p["b"] + noise(p["a"], key) % low) % low).alias("b"))
        return lambda p: F.struct(((p["a"] + noise(p["b"], key) % high) % high).alias("a"), p["b"].alias("b"))

    def moved(x: Column) -> Column:
        place = F.struct(div(x, low).alias("a"), (x % low).alias("b"))
        for i in range(rounds):
            # Each round's place is worked out once, however often the next one names it.
            place = F.get(F.transform(F.array(place), round_of(i)), F.lit(0))
        return F.get(F.transform(F.array(place), lambda p: p["a"] * low + p["b"]), F.lit(0))

    start = moved(number.cast("bigint"))
    if high * low == n:
        return start
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, lambda y, _: F.when(y < n, y).otherwise(moved(y)))
    lost = F.raise_error(F.lit(f"no place inside after {WALKS} moves")).cast("bigint")
    return F.get(F.transform(F.array(walked), lambda y: F.when(y < n, y).otherwise(lost)), F.lit(0))
