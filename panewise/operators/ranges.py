"""Expanding a row into one row per integer of a range, however long the range is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panewise.functions.arith import div

BLOCK = 1 << 16


def explode_range(
    rows: DataFrame, first: Column, last: Column, into: str, block: int = BLOCK
) -> DataFrame:
    """One row per integer in [first, last]; rows with an empty range are dropped.

    A single `explode(sequence(...))` would build the whole range as one array in one task. Ranges of one
    block are expanded where they are; long ones are cut into blocks, spread over the cluster and expanded
    there.
    """
    columns = rows.columns
    bounded = rows.withColumn("__first", first.cast("bigint")).withColumn("__last", last.cast("bigint"))
    last_block = div(F.col("__last") - F.col("__first"), block)
    bounded = bounded.where(F.col("__first") <= F.col("__last"))
    short = bounded.where(last_block == 0)
    blocks = (
        bounded.where(last_block > 0)
        .withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
        .withColumn("__first", F.col("__first") + F.col("__block") * block)
        .withColumn("__last", F.least(F.col("__last"), F.col("__first") + (block - 1)))
    )
    spread = blocks.repartition(F.col("__first"), *[F.col(c) for c in columns]).drop("__block")
    return short.unionByName(spread).select(
        *columns, F.explode(F.sequence(F.col("__first"), F.col("__last"))).alias(into)
    )
