"""Keyed streaming state: running counter and count windows.

These keep one state per key and answer each micro-batch with small, steady state. Without `order_by` rows
of a micro-batch are taken in the order they arrive, which Spark does not promise; with it, all rows a key
has in the micro-batch are sorted first, in runs of bounded size that are merged from the task's disk. The
forms in `microbatch` also split hot keys.
"""

from __future__ import annotations

import heapq
import os
import sys
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from panewise.functions.checks import one_of, positive

# Send the classes below to Python workers as code, as workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Panes per output batch, so that a hot key's panes never sit in memory together.
_OUT_ROWS = 100_000
# Rows that are sorted in memory; more make a run on disk.
RUN_ROWS = 200_000

REDUCE = ("sum", "min", "max", "count")


def in_order(batches: Iterator[pd.DataFrame], order_by: str | None, most: int = RUN_ROWS) -> Iterator[pd.DataFrame]:
    """The rows of all batches by `order_by`; nulls last, ties as they came."""
    if order_by is None:
        yield from batches
        return
    batches = iter(batches)  # what is left of it when runs begin is read there
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= most:
            yield from _merged(held, batches, order_by, most)
            return
    # Most keys have few rows: they need no folder, and no sort if they came in order.
    if held:
        yield _sorted(held, order_by)


def _merged(
    held: list[pd.DataFrame], batches: Iterator[pd.DataFrame], order_by: str, most: int
) -> Iterator[pd.DataFrame]:
    """The rows of what is held and of the batches left, sorted in runs on disk."""
    with tempfile.TemporaryDirectory() as folder:
        runs = [os.path.join(folder, "0")]
        _spill(_sorted(held, order_by), runs[-1])
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= most:
                runs.append(os.path.join(folder, str(len(runs))))
                _spill(_sorted(held, order_by), runs[-1])
                held, rows = [], 0
        streams = [_rows(_read(run), order_by, i) for i, run in enumerate(runs)]
        if held:
            streams.append(_rows(iter([_sorted(held, order_by)]), order_by, len(runs)))
        block, columns = [], None
        for _, _, _, row, columns in heapq.merge(*streams, key=lambda r: r[:3]):
            block.append(row)
            if len(block) == _OUT_ROWS:
                yield pd.DataFrame(block, columns=columns).convert_dtypes(convert_string=False, convert_floating=False)
                block = []
        if block:
            yield pd.DataFrame(block, columns=columns).convert_dtypes(convert_string=False, convert_floating=False)


def _sorted(batches: list[pd.DataFrame], order_by: str) -> pd.DataFrame:
    rows = batches[0] if len(batches) == 1 else pd.concat(batches, ignore_index=True)
    order = rows[order_by].to_numpy()
    if order.dtype.kind in "iu" and (order[1:] >= order[:-1]).all():
        return rows
    return rows.sort_values(order_by, kind="stable", ignore_index=True)


def _spill(rows: pd.DataFrame, path: str) -> None:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.OSFile(path, "wb") as out, pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table, max_chunksize=8192)


def _read(path: str) -> Iterator[pd.DataFrame]:
    with pa.OSFile(path) as source, pa.ipc.open_stream(source) as reader:
        for batch in reader:
            yield batch.to_pandas()


def _rows(blocks: Iterator[pd.DataFrame], order_by: str, run: int):
    for block in blocks:
        at = block.columns.get_loc(order_by)
        for row in block.itertuples(index=False, name=None):
            value = row[at]
            missing = pd.isna(value)
            yield missing, 0 if missing else value, run, row, block.columns


class CounterState(StatefulProcessor):
    """n and the last payload per key; a key starts from (0, "")."""

    def __init__(self, key: str, payload: str, order_by: str | None):
        self._key, self._payload, self._order_by = key, payload, order_by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("counter", "n BIGINT, last STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last = self._state.get() or (0, "")
        for batch in in_order(rows, self._order_by):
            payloads = batch[self._payload]
            yield pd.DataFrame(
                {
                    self._key: [key[0]] * len(batch),
                    "n": np.arange(n + 1, n + len(batch) + 1),
                    self._payload: payloads.array,
                }
            )
            n, last = n + len(batch), payloads.iloc[-1]
        self._state.update((n, None if pd.isna(last) else str(last)))


def running_counter(
    stream: DataFrame, key: str, payload: str, order_by: str | None = None
) -> DataFrame:
    """One row `key, n, payload` per input row, the payload a STRING.

    `order_by` sorts all rows a key has in a micro-batch.
    """
    columns = [key, payload] + ([order_by] if order_by else [])
    fields = stream.schema
    out = StructType([fields[key], StructField("n", LongType()), fields[payload]])
    return (
        stream.select(*columns)
        .groupBy(key)
        .transformWithStateInPandas(CounterState(key, payload, order_by), out, "append", "none")
    )


class CountPaneState(StatefulProcessor):
    """Rows seen per key; fires the count of every pane whose end the new rows reach."""

    def __init__(self, key: str, size: int, slide: int):
        self._key, self._size, self._slide = key, size, slide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("seen", "n BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (before,) = self._state.get() or (0,)
        now = before + sum(int(batch["rows_seen"].sum()) for batch in rows)
        self._state.update((now,))
        first, last = before // self._slide + 1, now // self._slide
        for start in range(first, last + 1, _OUT_ROWS):
            n = np.arange(start, min(last + 1, start + _OUT_ROWS)) * self._slide
            yield pd.DataFrame(
                {self._key: [key[0]] * len(n), "n": n, "cnt": np.minimum(n, self._size)}
            )


def _partial_counts(key: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = batch.groupby(key, dropna=False, sort=False).size()
            yield counts.rename("rows_seen").reset_index()

    return count


def count_window_counts(stream: DataFrame, key: str, size: int, slide: int) -> DataFrame:
    """`key, n, cnt` per pane, as in the batch form.

    Rows are counted per key before they are shuffled, so a hot key sends counts, not rows.
    """
    positive(size=size, slide=slide)
    field = stream.schema[key]
    rows = StructType([field, StructField("rows_seen", LongType())])
    out = StructType([field, StructField("n", LongType()), StructField("cnt", LongType())])
    counted = stream.select(key).mapInPandas(_partial_counts(key), rows)
    return counted.groupBy(key).transformWithStateInPandas(
        CountPaneState(key, size, slide), out, "append", "none"
    )


class ReducePaneState(StatefulProcessor):
    """Rows seen and the last `size` - 1 values per key; fires the reduced value of every pane.

    Values come as BIGINT with a flag, null as 0 and false, so that no value goes through a DOUBLE. The tail
    is kept as bytes: the values, then the flags.
    """

    def __init__(self, key, how, size, slide, order_by, into):
        self._key, self._how, self._into = key, how, into
        self._size, self._slide, self._order_by = size, slide, order_by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("window", "n BIGINT, tail BINARY, known BINARY")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, tail, known = self._state.get() or (0, b"", b"")
        tail, known = np.frombuffer(tail, np.int64), np.frombuffer(known, np.bool_)
        for batch in in_order(rows, self._order_by):
            values = np.concatenate([tail, batch["value"].to_numpy(dtype=np.int64)])
            valid = np.concatenate([known, batch["known"].to_numpy(dtype=np.bool_)])
            start = n - len(tail)
            first, n = n // self._slide + 1, n + len(batch)
            for at in range(first, n // self._slide + 1, _OUT_ROWS):
                ends = np.arange(at, min(n // self._slide + 1, at + _OUT_ROWS)) * self._slide
                reduced, there = pane_values(values, valid, ends - start, self._size, self._how)
                yield pd.DataFrame(
                    {self._key: [key[0]] * len(ends), "n": ends, self._into: pd.arrays.IntegerArray(reduced, ~there)}
                )
            keep = self._size - 1
            tail, known = (values[-keep:], valid[-keep:]) if keep else (values[:0], valid[:0])
        self._state.update((n, tail.tobytes(), known.tobytes()))


def pane_values(values: np.ndarray, valid: np.ndarray, ends: np.ndarray, size: int, how: str) -> tuple[np.ndarray, np.ndarray]:
    """(reduced value, whether there is one) of the last `size` values before each end, nulls left out."""
    begins = np.maximum(0, ends - size)
    counted = np.concatenate([[0], np.cumsum(valid)])
    count = counted[ends] - counted[begins]
    if how == "count":
        return count, np.ones(len(ends), bool)
    if how == "sum":
        summed = np.concatenate([[0], np.cumsum(np.where(valid, values, 0))])
        return summed[ends] - summed[begins], count > 0
    least, none = (np.minimum, np.iinfo(np.int64).max) if how == "min" else (np.maximum, np.iinfo(np.int64).min)
    filled = np.append(np.where(valid, values, none), none)
    return least.reduceat(filled, np.column_stack([begins, ends]).ravel())[::2], count > 0


def count_window_reduce(
    stream: DataFrame,
    key: str,
    value: str,
    how: str,
    size: int,
    slide: int,
    order_by: str | None = None,
    into: str | None = None,
) -> DataFrame:
    """`key, n, into` per pane: sum, min, max or count of a BIGINT column, without its nulls.

    A pane of nulls only has a null, or a count of 0. `order_by` sorts all rows a key has in a micro-batch.
    """
    positive(size=size, slide=slide)
    one_of("how", how, REDUCE)
    into = into or how
    whole = F.col(value).cast("bigint")
    columns = [F.coalesce(whole, F.lit(0)).cast("bigint").alias("value"), whole.isNotNull().alias("known")]
    order = [] if order_by is None else [F.col(order_by).alias("place")]
    field = stream.schema[key]
    out = StructType([field, StructField("n", LongType()), StructField(into, LongType())])
    processor = ReducePaneState(key, how, size, slide, "place" if order else None, into)
    rows = stream.select(F.col(key).alias("key"), *columns, *order)
    return rows.groupBy("key").transformWithStateInPandas(processor, out, "append", "none")


def final_state(stream: DataFrame, key: str, order_by: str, payload: str) -> DataFrame:
    """`key, n, payload` per key; Spark's own incremental aggregate, combined before the shuffle."""
    return stream.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max_by(payload, order_by).alias(payload)
    )
