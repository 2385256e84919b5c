"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panewise.session import forget, working_dir
from panewise.sources.io import written  # noqa: F401

# The white space of the contracts' words, as a Java or Python character class.
ASCII_SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same(left: Column, right: Column) -> Column:
    """Equality that also holds between nulls; Spark joins on it like on any equality."""
    return left.eqNullSafe(right)


def by_size(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one take about `most` bytes; one longer text stays whole."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if batch.num_rows > start:
            yield batch.slice(start)


def in_batches(rows: DataFrame, work: Callable, schema) -> DataFrame:
    """`rows.mapInArrow(work, schema)` whose tasks give their memory back when they end.

    Spark hands a Python worker from task to task and from stage to stage: what a stage has freed would stay with
    the worker's allocators, beside what the next stage needs.
    """

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return rows.mapInArrow(freed, schema)


def give_back() -> None:
    """Return free memory to the system, where its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this kind of C library


def partitions_for(rows: int, per_task: int) -> int:
    return max(1, -(-rows // per_task))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where inner functions use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbers(first: Column, last: Column) -> Column:
    """first, first + 1, ..., last; empty if last < first."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def fresh(name: str, columns: list[str]) -> str:
    """A column name like `name` that isn't among `columns`."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile deletes its shuffle files when it ends. Else they stay until the driver happens to collect
    its garbage, beside those of all that runs after it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Tables that an operator writes on its way, in the shared working folder, and deletes when it is done
    with them: once what is made of them is written too, a lost executor needs them no more."""

    def __init__(self, spark: SparkSession, purpose: str):
        self._spark, self._base, self._number = spark, working_dir(spark, purpose), 0
        self._paths: dict[int, str] = {}
        self._held: dict[int, DataFrame] = {}

    def write(self, *parts: DataFrame) -> DataFrame:
        """One table of the rows of all parts, which are worked out one after the other."""
        self._number += 1
        path = f"{self._base}/{self._number}"
        for rows in parts:
            with dropping_shuffles(self._spark):
                rows.write.mode("append").parquet(path)
        table = self._spark.read.schema(parts[0].schema).parquet(path)
        self._paths[id(table)] = path
        self._held[id(table)] = table  # so that its id isn't given to another
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            del self._held[id(table)]
            forget(self._spark, self._paths.pop(id(table)))
