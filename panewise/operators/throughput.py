"""Throughput measures over tables of timestamped rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panewise.functions.arith import div, floor_div
from panewise.functions.checks import positive
from panewise.functions.time import micros_between, micros_since_1970, seconds_between
from panewise.operators.running import rows_at

# Six runs are measured and the first is dropped; a stream is idle after ten empty
# polls of one second.
RUNS = 6
WARM_UP_RUNS = 1
IDLE_MS = 10 * 1000

_BUCKETS_PER_STRETCH = 1 << 16


def rate(count: Column | str, seconds: Column) -> Column:
    """Rows per second; null if no time has passed."""
    return F.try_divide(_col(count).cast("double"), seconds)


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _in_ms(ms: int) -> str:
    return f"{ms} milliseconds"


def fixed_time(rows: DataFrame, ts: str, ms: int) -> DataFrame:
    """`start, n, thp`: rows and rows per second in every stretch of `ms` that has rows.

    On a stream, `ts` must be a TIMESTAMP column with a watermark.
    """
    positive(ms=ms)
    counts = rows.groupBy(F.window(ts, _in_ms(ms))).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        F.col("window.start").alias("start"), "n", (F.col("n") / F.lit(ms / 1000.0)).alias("thp")
    )


def warm_mean(measured: DataFrame, ms: int, runs: int = RUNS, warm_up: int = WARM_UP_RUNS) -> DataFrame:
    """`thp`: mean rate of runs warm_up+1 .. runs, where run i is the i-th stretch of `fixed_time`.

    Runs are equally long, so their mean rate is their rows over their time. They follow each other
    without a break: a stretch without rows is a run at rate 0, up to the last with rows. With fewer runs
    the mean is over those there are; null if the warm-up is all there is.
    """
    positive(ms=ms, runs=runs, warm_up=warm_up, measured_runs=runs - warm_up)
    # The measured runs are among the first `runs` stretches, however many there are.
    first = measured.orderBy("start").limit(runs)
    since = micros_between(F.min("start").over(Window.partitionBy()), "start")
    numbered = first.select("n", (div(since, ms * 1000) + 1).alias("__run"))
    timed = (F.col("__run") > warm_up) & (F.col("__run") <= runs)
    counted = F.sum(F.when(timed, F.col("n")).otherwise(F.lit(0)))
    there = F.least(F.max("__run"), F.lit(runs)) - warm_up
    seconds = F.when(there > 0, there * F.lit(ms / 1000.0))
    return numbered.agg(rate(counted, seconds).alias("thp"))


def until_idle(
    rows: DataFrame,
    ts: str,
    idle_ms: int = IDLE_MS,
    by: Sequence[str] = (),
    given: int | None = None,
) -> DataFrame:
    """`by..., start, end, n, thp`: stretches of rows with no pause longer than `idle_ms`.

    The rate is that of `given` rows if set, else of the rows seen.

    Rows are first folded into buckets as long as the pause: rows of one bucket always belong
    together, so the session merge reads buckets, not rows. Buckets are then merged within long
    stretches of time. Only the first and last span of a stretch can go on in another one, so the
    merge over all time reads at most two spans per 65,536 pauses.
    """
    positive(idle_ms=idle_ms)
    pause = idle_ms * 1000
    by = list(by)
    bucket = floor_div(micros_since_1970(rows, ts), pause)
    buckets = (
        rows.groupBy(*by, bucket.alias("__bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    )
    stretch = floor_div(F.col("__bucket"), _BUCKETS_PER_STRETCH)
    spans = _merge(buckets.withColumn("__stretch", stretch), [*by, "__stretch"], pause)
    of_stretch = Window.partitionBy(*by, "__stretch")
    edge = (F.col("start") == F.min("start").over(of_stretch)) | (
        F.col("end") == F.max("end").over(of_stretch)
    )
    spans = spans.withColumn("__edge", edge)
    columns = [*by, "start", "end", "n"]
    inner = spans.where(~F.col("__edge")).select(*columns)
    sessions = inner.unionByName(_merge(spans.where("__edge"), by, pause).select(*columns))
    counted = F.lit(given) if given is not None else F.col("n")
    return sessions.select(
        *by, "start", "end", "n", rate(counted, seconds_between("start", "end")).alias("thp")
    )


def _merge(spans: DataFrame, by: list[str], pause: int) -> DataFrame:
    length = micros_between("start", "end") + F.lit(pause)
    gap = F.concat(length.cast("string"), F.lit(" microseconds"))
    return (
        spans.groupBy(*by, F.session_window("start", gap))
        .agg(F.sum("n").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("session_window")
    )


def until_idle_stream(rows: DataFrame, ts: str, by: str, idle_ms: int = IDLE_MS) -> DataFrame:
    """`until_idle` on a stream, per value of the column `by` (Spark needs one), with no rate given."""
    positive(idle_ms=idle_ms)
    return (
        rows.groupBy(F.session_window(ts, _in_ms(idle_ms)), by)
        .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
        .select(
            by, "start", "end", "n", rate("n", seconds_between("start", "end")).alias("thp")
        )
    )


def after_fill(rows: DataFrame, ts: str, order_by: str, fill: int, count: int) -> DataFrame:
    """`start, end, thp`: the first `fill` rows warm the state, the `count` after them are timed."""
    positive(fill=fill, count=count)
    ends = rows_at(rows.select(order_by, ts), order_by, [fill, fill + count], "__at")
    return between_rows(ends, ts, "__at", fill, count)


def between_rows(ends: DataFrame, ts: str, at: str, fill: int, count: int) -> DataFrame:
    """`start, end, thp` from the rows at the positions `fill` and `fill + count`."""
    timed = ends.agg(
        F.max(F.when(F.col(at) == fill, F.col(ts))).alias("start"),
        F.max(F.when(F.col(at) == fill + count, F.col(ts))).alias("end"),
    )
    return timed.withColumn("thp", rate(F.lit(count), seconds_between("start", "end")))
