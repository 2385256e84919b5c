"""Running sums and row numbers that no hot key and no global order can pin to one task.

A plain `Window.partitionBy(key).orderBy(order)` sorts each key in one task, and a window without a
key sorts the whole table in one. Here a group is cut into chunks of the order column. Every chunk
is a window group of its own, and the sum of all rows before it reaches it as one extra row that
sorts first (a carry), so there is no join back and the rows are shuffled once.

The order column must be an integer, not null and unique within its group. Uniqueness is what bounds
the work: a chunk spans 2^20 order values, so it has at most 2^20 rows; chunk totals are summed the
same way, 2^21 to a chunk; and what is left above that has at most 2^21 rows per group for orders
below 2^62.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_BITS = 20
UPPER_BITS = 21
BITS = (CHUNK_BITS, UPPER_BITS)

# Keys with about more rows than this are cut into chunks; the others stay whole.
HOT_ROWS = 2_000_000
# Up to this many hot keys are sent to every executor; more are met by a shuffled join, which Spark splits
# where it is skewed. There are at most rows / HOT_ROWS of them.
BROADCAST_KEYS = 100_000
# Rows of a hot key that are enough to tell it is one.
EVIDENCE = 1000


def _scratch(name: str, level: int) -> str:
    return f"__{name}{level}"


def _ordered(rows: DataFrame, order_by: str) -> DataFrame:
    """Fail on a row without an order, which would be taken for a carry and lost."""
    missing = F.raise_error(F.lit(f"null in the order column {order_by}"))
    order = F.coalesce(F.col(order_by), missing.cast(rows.schema[order_by].dataType))
    return rows.withColumn(order_by, order)


def running_sum(
    rows: DataFrame,
    order_by: str,
    weight: Column,
    into: str,
    keys: Sequence[str] = (),
    split: Column | None = None,
    initial: DataFrame | None = None,
    bits: Sequence[int] = BITS,
) -> DataFrame:
    """Add `into`: the sum of `weight` over the group's rows up to and including this one.

    keys     the group; none means the whole table
    split    which rows are cut into chunks (default all); must be the same for a whole group
    initial  rows `keys..., into` with the sum a group starts from
    bits     a chunk spans 2^bits[0] order values, a chunk of chunk totals 2^bits[1] of those, and
             so on; empty is the plain window
    """
    return _running_sum(
        _ordered(rows, order_by), order_by, weight, into, list(keys), split, initial, bits
    )


def _running_sum(
    rows: DataFrame,
    order_by: str,
    weight: Column,
    into: str,
    keys: list[str],
    split: Column | None,
    initial: DataFrame | None,
    bits: Sequence[int],
) -> DataFrame:
    levels = len(bits)
    own, chunk = _scratch("weight", levels), _scratch("chunk", levels)
    weighted = rows.withColumn(own, weight.cast("bigint"))
    carries = []
    if not bits:
        weighted = weighted.withColumn(chunk, F.lit(None).cast("bigint"))
    else:
        weighted = weighted.withColumn(chunk, _chunk(order_by, split, bits[0]))
        totals = chunk_totals(rows, order_by, weight, keys, split, bits[0], chunk)
        upto = _running_sum(
            totals, chunk, F.col("__total"), into, keys, None, initial, bits[1:]
        )
        carries.append(upto.select(*keys, chunk, (F.col(into) - F.col("__total")).alias(own)))
    if initial is not None and (not bits or split is not None):
        first = F.lit(None).cast("bigint").alias(chunk)
        carries.append(initial.select(*keys, first, F.col(into).cast("bigint").alias(own)))

    # Carries have no order value: they sort before the rows and are dropped after the window.
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), carries, weighted)
    window = (
        Window.partitionBy(*keys, *([chunk] if bits else []))
        .orderBy(F.col(order_by).asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        both.withColumn(into, F.sum(own).over(window))
        .where(F.col(order_by).isNotNull())
        .drop(own, chunk)
    )


def _chunk(order_by: str, split: Column | None, bits: int) -> Column:
    place = F.shiftright(F.col(order_by).cast("bigint"), bits)
    return place if split is None else F.when(split, place)


def chunk_totals(
    rows: DataFrame,
    order_by: str,
    weight: Column,
    keys: Sequence[str],
    split: Column | None,
    bits: int,
    chunk: str,
) -> DataFrame:
    """`keys..., chunk, __total`: the weight of every chunk.

    Everything above it builds on this one aggregate in the same form, so Spark runs it once and
    reuses its exchange: the levels of a running sum cost no further pass over the rows.
    """
    cut = rows if split is None else rows.where(split)
    place = _chunk(order_by, None, bits).alias(chunk)
    return cut.groupBy(*keys, place).agg(F.sum(weight.cast("bigint")).alias("__total"))


def total_weight(
    rows: DataFrame, order_by: str, weight: Column, bits: Sequence[int] = BITS
) -> Column:
    """The weight of the whole table as a scalar subquery, from the chunk totals of `running_sum`."""
    rows = _ordered(rows, order_by)
    totals = chunk_totals(rows, order_by, weight, [], None, bits[0], _scratch("chunk", len(bits)))
    return totals.agg(F.sum("__total")).scalar()


def hot_keys(
    rows: DataFrame,
    keys: Sequence[str],
    order_by: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All keys with about more than `hot_rows` rows.

    Which keys are cut changes only where their rows are summed, never the sums. So it is enough to
    count one row in `hot_rows / EVIDENCE`, picked by a hash of the unique order: every read picks
    the same ones, and the many small keys are hardly shuffled. Small `hot_rows` are counted exactly.
    """
    one_in = max(1, hot_rows // EVIDENCE)
    if one_in > 1:
        rows = rows.where(F.pmod(F.xxhash64(order_by), F.lit(one_in)) == 0)
    return (
        rows.groupBy(*keys)
        .agg((F.count(F.lit(1)) * one_in).alias("__rows"))
        .where(F.col("__rows") > hot_rows)
        .select(*keys)
    )


def mark_hot(
    rows: DataFrame, keys: Sequence[str], order_by: str, into: str, hot_rows: int = HOT_ROWS
) -> DataFrame | None:
    """Add the BOOLEAN `into`: whether the row's key is one of `hot_keys`; None if there are no such keys.

    Hot keys are found here and now, so that their number decides how they meet the rows: up to BROADCAST_KEYS
    go through the driver to every executor. Nothing is kept on executors.
    """
    hot = hot_keys(rows, keys, order_by, hot_rows)
    few = hot.limit(BROADCAST_KEYS + 1).collect()
    if not few:
        return None
    if len(few) <= BROADCAST_KEYS:
        hot = F.broadcast(rows.sparkSession.createDataFrame(few, hot.schema))
    hot = hot.select(*[F.col(k).alias(f"__hot_{k}") for k in keys], F.lit(True).alias(into))
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__hot_{k}")) for k in keys]
    )
    return rows.join(hot, same, "left").select(
        *rows.columns, F.coalesce(F.col(into), F.lit(False)).alias(into)
    )


def number_rows(
    rows: DataFrame,
    keys: Sequence[str],
    order_by: str,
    into: str = "n",
    initial: DataFrame | None = None,
    hot_rows: int | None = HOT_ROWS,
    bits: Sequence[int] = BITS,
) -> DataFrame:
    """Add `into`: 1, 2, 3, ... within each key, by `order_by`; after `initial` where it has the key.

    `hot_rows=None` promises that no key is large and leaves all keys whole; else a first look at the key
    and order columns finds the large ones.
    """
    marked = None if hot_rows is None else mark_hot(rows, keys, order_by, "__hot", hot_rows)
    if marked is None:
        return running_sum(rows, order_by, F.lit(1), into, keys, None, initial, bits=())
    numbered = running_sum(marked, order_by, F.lit(1), into, keys, F.col("__hot"), initial, bits)
    return numbered.drop("__hot")


def number_all_rows(
    rows: DataFrame, order_by: str, into: str = "seq", bits: Sequence[int] = BITS
) -> DataFrame:
    """Add `into`: 1, 2, 3, ... over the whole table, by `order_by`."""
    return running_sum(rows, order_by, F.lit(1), into, bits=bits)


def rows_at(
    rows: DataFrame,
    order_by: str,
    positions: Sequence[int],
    into: str = "seq",
    bits: Sequence[int] = BITS,
) -> DataFrame:
    """The rows at the given 1-based positions of the whole order, with their position as `into`.

    Chunk totals tell which chunks hold the positions (at most one each), so only those few chunks
    are sorted and the table itself is never shuffled.
    """
    rows = _ordered(rows, order_by)
    chunked = rows.withColumn("__chunk", F.shiftright(F.col(order_by).cast("bigint"), bits[0]))
    totals = chunk_totals(rows, order_by, F.lit(1), [], None, bits[0], "__chunk")
    upto = _running_sum(totals, "__chunk", F.col("__total"), "__upto", [], None, None, bits[1:])
    before = F.col("__upto") - F.col("__total")
    wanted = [(before < p) & (F.col("__upto") >= p) for p in positions]
    few = upto.where(reduce(lambda a, b: a | b, wanted)).select("__chunk", before.alias("__before"))
    by_order = Window.partitionBy("__chunk").orderBy(order_by)
    return (
        chunked.join(F.broadcast(few), "__chunk")
        .withColumn(into, (F.col("__before") + F.row_number().over(by_order)).cast("bigint"))
        .where(F.col(into).isin(list(positions)))
        .drop("__chunk", "__before")
    )
