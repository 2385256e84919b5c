"""Per-key running counter with the last payload as state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panewise.operators.running import BITS, HOT_ROWS, number_rows

# Sorts before any real row, so a state carried in never wins over a newer payload.
_BEFORE_ALL = -(1 << 63)


def running_counter(
    rows: DataFrame,
    key: str,
    order_by: str,
    payload: str,
    initial: DataFrame | None = None,
    strict: bool = False,
    hot_rows: int | None = HOT_ROWS,
    bits: Sequence[int] = BITS,
) -> DataFrame:
    """One row `key, n, payload` per input row: n counts the key's rows so far, by `order_by`.

    initial  state to start from, as `final_state` returns it; a key without one starts at 0
    strict   emit 0 in place of the key, as a counter that never fills in its key field does
    """
    needed = rows.select(key, order_by, payload)
    state = None if initial is None else initial.select(key, "n")
    counted = number_rows(needed, [key], order_by, "n", state, hot_rows, bits)
    shown = F.lit(0).cast(rows.schema[key].dataType) if strict else F.col(key)
    return counted.select(shown.alias(key), "n", payload)


def final_state(
    rows: DataFrame, key: str, order_by: str, payload: str, initial: DataFrame | None = None
) -> DataFrame:
    """`key, n, payload` per key: its row count and last payload once all rows are read."""
    step = rows.select(
        key, F.lit(1).cast("bigint").alias("n"), F.col(order_by).cast("bigint").alias("__at"), payload
    )
    if initial is not None:
        before = F.lit(_BEFORE_ALL).cast("bigint").alias("__at")
        step = step.unionByName(initial.select(key, "n", before, payload))
    return step.groupBy(key).agg(
        F.sum("n").alias("n"), F.max_by(payload, "__at").alias(payload)
    )


def keep_key(rows: DataFrame, column: str, value, strict: bool = False) -> DataFrame:
    """Rows whose key equals `value`; strict keeps none, as a test of a number against a text does."""
    return rows.where(F.lit(False)) if strict else rows.where(F.col(column) == F.lit(value))
