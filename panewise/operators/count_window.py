"""Windows over the last `size` rows of a key, fired at every `slide`-th row of that key.

The pane fired at a key's row n (n a multiple of `slide`) holds its last min(n, size) rows. Early
panes are short, and rows after the last multiple never fire. `slide == size` is the tumbling window,
`slide > size` samples the stream and skips rows between panes.

Three forms, by what is asked of a pane:

* `count_window_counts`: only how many rows it has. Needs no order, only a count per key.
* `count_window`: any Spark aggregate. With few panes per row each row is sent to them. With many, aggregates
  that are monoids (see `monoids`) are joined from two partial states per pane, at a cost per row that does
  not grow with the size; others are seen through a frame over the last rows, or sent to their panes.
* `count_window_reduce`: sum, min, max or count of one column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panewise.functions.arith import div
from panewise.functions.checks import one_of, positive
from panewise.operators import monoids
from panewise.operators.ranges import explode_range
from panewise.operators.running import BITS, HOT_ROWS, number_rows

# Up to this many panes per row, sending each row to its panes is cheaper than a second shuffle.
FEW_PANES = 16

# Rows of a key in one window group of the long form, or the size of the window if that is more.
FRAME_BLOCK = 1 << 18

REDUCERS = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
# How parts of a pane are put together.
MERGERS = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}


def count_window_counts(
    rows: DataFrame, keys: Sequence[str], size: int, slide: int, into: str = "cnt"
) -> DataFrame:
    """`keys..., n, into`: the rows in every pane of every key.

    Counts do not depend on the order of rows, so panes follow from the number of rows per key.
    """
    positive(size=size, slide=slide)
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    totals = totals.withColumn("__before", F.lit(0).cast("bigint"))
    return panes_between(totals, keys, "__before", "__rows", size, slide, into)


def panes_between(
    seen: DataFrame,
    keys: Sequence[str],
    before: str,
    now: str,
    size: int,
    slide: int,
    into: str = "cnt",
) -> DataFrame:
    """`keys..., n, into`: the panes that fire as each key's rows grow from `before` to `now`."""
    first, last = div(F.col(before), slide) + 1, div(F.col(now), slide)
    growth = seen.where(first <= last).select(*keys, first.alias("__from"), last.alias("__to"))
    fired = explode_range(growth, F.col("__from"), F.col("__to"), "__pane")
    n = F.col("__pane") * slide
    return fired.select(*keys, n.alias("n"), F.least(n, F.lit(size)).cast("bigint").alias(into))


def to_panes(numbered: DataFrame, size: int, slide: int, n: str = "n", into: str = "pane") -> DataFrame:
    """One row per row and pane it belongs to; pane j ends at the key's row j * slide."""
    at = F.col(n)
    first = div(at + (slide - 1), slide)
    last = div(at + (size - 1), slide)
    if size == slide:
        return numbered.withColumn(into, first)
    panes = F.when(first <= last, F.sequence(first, last))
    return numbered.withColumn(into, F.explode(panes))


def count_window(
    rows: DataFrame,
    keys: Sequence[str],
    order_by: str,
    size: int,
    slide: int,
    aggs: Sequence[Column],
    hot_rows: int | None = HOT_ROWS,
    bits: Sequence[int] = BITS,
) -> DataFrame:
    """`keys..., n` and the given aggregates of every pane.

    Aggregates may use the column `n`, the row's number within its key, e.g. `max_by(x, "n")`. What decides how
    more than FEW_PANES panes per row are made is the kind of aggregate: if all are monoids, a row costs the
    same for any size. Else, if all are single functions, a frame works out each pane from its rows, `size` of
    them for each; calculations on aggregates, and distinct ones, get a copy of each row for each pane.
    """
    positive(size=size, slide=slide)
    numbered = number_rows(rows, keys, order_by, "n", hot_rows=hot_rows, bits=bits)
    if size > FEW_PANES * slide:
        calls = [monoids.read(a) for a in aggs]
        known = [monoids.of(c) for c in calls]
        if all(known):
            return _joined(numbered, list(keys), size, slide, aggs, known)
        if all(c.name is not None and not c.distinct for c in calls):
            return _framed(numbered, list(keys), size, slide, aggs, calls)
    panes = to_panes(numbered, size, slide, into="__pane")
    grouped = panes.groupBy(*keys, "__pane").agg(F.max("n").alias("__end"), *aggs)
    # A pane is complete once the row it ends at is there.
    complete = grouped.where(F.col("__end") == F.col("__pane") * slide)
    return complete.withColumnRenamed("__end", "n").drop("__pane")


def _shown(numbered: DataFrame, keys: list[str], aggs: Sequence[Column]) -> list:
    """Names and types of the aggregates."""
    return numbered.limit(0).groupBy(*keys).agg(*aggs).schema.fields[len(keys) :]


def _joined(
    numbered: DataFrame, keys: list[str], size: int, slide: int, aggs: Sequence[Column], known: Sequence[monoids.Monoid]
) -> DataFrame:
    """Panes from partial states.

    A key's rows are cut into blocks of `size`. A pane is the end of one block and the start of the next, and
    both are states that grow row by row within a block, from its start and from its end: two states per pane
    instead of `size` rows. Blocks also split a hot key.
    """
    shown = _shown(numbered, keys, aggs)
    blocked = numbered.withColumn("__block", div(F.col("n") - 1, size))
    block = Window.partitionBy(*keys, "__block")
    upto = block.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = block.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def states(window) -> Column:
        return F.struct(
            *[F.struct(*[p.over(window).alias(x) for x, p in m.parts.items()]).alias(f"a{i}") for i, m in enumerate(known)]
        )

    running = blocked.select(*keys, "n", states(upto).alias("__upto"), states(onward).alias("__onward"))
    n = F.col("n")
    end = n + (size - 1)
    ends_here = n % slide == 0
    # A pane that starts a block is that whole block: its end already holds all of it.
    starts_here = (end % slide == 0) & ((n - 1) % size != 0)
    none = F.lit(None).cast(running.schema["__upto"].dataType)
    late = F.struct(n.alias("end"), F.col("__upto").alias("late"), none.alias("early"))
    early = F.struct(end.alias("end"), none.alias("late"), F.col("__onward").alias("early"))
    parts = running.where(ends_here | starts_here).select(
        *keys, F.explode(F.array_compact(F.array(F.when(ends_here, late), F.when(starts_here, early)))).alias("p")
    )
    met = parts.groupBy(*keys, F.col("p.end").alias("n")).agg(
        F.any_value("p.late", True).alias("late"), F.any_value("p.early", True).alias("early")
    )

    def result(m: monoids.Monoid, i: int) -> Column:
        state = F.struct(*[c.alias(x) for x, c in m.join(F.col(f"early.a{i}"), F.col(f"late.a{i}")).items()])
        return m.finish(state).cast(shown[i].dataType).alias(shown[i].name)

    return met.where(F.col("late").isNotNull()).select(*keys, "n", *[result(m, i) for i, m in enumerate(known)])


def _framed(
    numbered: DataFrame, keys: list[str], size: int, slide: int, aggs: Sequence[Column], calls: Sequence[monoids.Call]
) -> DataFrame:
    """The aggregates over a frame of the last `size` rows.

    A key's rows are cut into blocks of at least `size`, and a block is handed the last `size` - 1 rows
    before it: a row is there twice at most, and no key makes a group of more than two blocks. Spark works each
    frame out from its rows.
    """
    length = max(size, FRAME_BLOCK)
    own = div(F.col("n") - 1, length)
    led = F.when(F.col("n") > (own + 1) * length - (size - 1), own + 1)
    blocks = numbered.withColumn("__own", own).withColumn("__block", F.explode(F.array_compact(F.array(F.col("__own"), led))))
    frame = Window.partitionBy(*keys, "__block").orderBy("n").rowsBetween(1 - size, Window.currentRow)
    names = [f"__agg{i}" for i in range(len(aggs))]
    framed = blocks.select("*", *[c.bare.over(frame).alias(x) for c, x in zip(calls, names)])
    fired = framed.where((F.col("__block") == F.col("__own")) & (F.col("n") % slide == 0))
    shown = _shown(numbered, keys, aggs)
    return fired.select(*keys, "n", *[F.col(x).alias(f.name) for x, f in zip(names, shown)])


def count_window_reduce(
    rows: DataFrame,
    keys: Sequence[str],
    order_by: str,
    value: str,
    how: str,
    size: int,
    slide: int,
    into: str | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """`keys..., n, into`: sum, min, max or count of `value` in every pane."""
    positive(size=size, slide=slide)
    one_of("how", how, tuple(REDUCERS))
    # The value gets a name of its own, as it may be the order column or a key too.
    needed = rows.select(*keys, order_by, F.col(value).alias("__value"))
    return count_window(needed, keys, order_by, size, slide, [REDUCERS[how]("__value").alias(into or how)], hot_rows)
