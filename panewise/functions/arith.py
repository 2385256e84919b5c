"""Integer arithmetic that stays in BIGINT."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def div(value: Column, by: Column | int) -> Column:
    """Whole quotient of a value of at least 0."""
    by = F.lit(by).cast("bigint") if isinstance(by, int) else by
    return F.call_function("div", value, by)


def floor_div(value: Column, by: int) -> Column:
    """Quotient rounded down, also below 0."""
    by = F.lit(by).cast("bigint")
    return F.call_function("div", value - F.pmod(value, by), by)
