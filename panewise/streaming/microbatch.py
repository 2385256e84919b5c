"""Keyed state over micro-batches with the batch operators: exact order, hot keys split, no Python rows.

Each micro-batch is answered by the batch operator, which starts from the state the batches before left. State is
a log (see `log_state`): a batch reads the rows of its keys and adds those it changed. Output goes to one folder per batch, replaced when the batch is run again: every row is there
once. The columns of a batch that are needed are fetched from its source once, into a table beside the
state that goes when the batch is done: nothing is kept on executors. Limit the input per batch at the source.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructType

from panewise.functions.checks import one_of, positive
from panewise.operators import counter, histogram, throughput
from panewise.operators.count_window import MERGERS, REDUCERS, panes_between, to_panes
from panewise.operators.running import HOT_ROWS, number_all_rows, number_rows, rows_at
from panewise.session import forget
from panewise.streaming.log_state import GONE, LogState

BATCH = "batch_id"

def _write_out(rows: DataFrame | None, output: str, batch_id: int) -> None:
    if rows is not None:
        rows.write.mode("overwrite").parquet(f"{output}/{BATCH}={batch_id}")


def read_output(spark: SparkSession, output: str) -> DataFrame:
    """All rows written so far."""
    return spark.read.parquet(output).drop(BATCH)


def _each_batch(
    stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], mode: str = "append"
) -> DataStreamWriter:
    return stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint)


def _fetched(checkpoint: str, step: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """The step on a written copy of each batch, as it reads a batch several times."""

    def run(batch: DataFrame, batch_id: int) -> None:
        path = f"{checkpoint}/tables/input"
        batch.write.mode("overwrite").parquet(path)
        step(batch.sparkSession.read.schema(batch.schema).parquet(path), batch_id)
        forget(batch.sparkSession, path)

    return run


def changed_rows(stream: DataFrame, output: str, checkpoint: str) -> DataStreamWriter:
    """Write the rows of an aggregation that each batch changes; `read_latest` gives the last of each key.

    State that a watermark has passed is freed.
    """

    def step(rows: DataFrame, batch_id: int) -> None:
        _write_out(rows, output, batch_id)

    return _each_batch(stream, checkpoint, step, "update")


def read_latest(spark: SparkSession, output: str, keys: Sequence[str]) -> DataFrame:
    """The last written row of each key."""
    rows = spark.read.parquet(output)
    rest = [c for c in rows.columns if c not in (*keys, BATCH)]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("__row"))
    return latest.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def replace_table(
    stream: DataFrame, output: str, checkpoint: str
) -> DataStreamWriter:
    """Write the whole result of an aggregation anew after every batch; `read_result` gives the last.

    Each batch has a folder of its own, so readers keep a whole result while the next is written; the last
    but one goes when the next is there.
    """

    def step(result: DataFrame, batch_id: int) -> None:
        _write_out(result, output, batch_id)
        forget(result.sparkSession, f"{output}/{BATCH}={batch_id - 2}")

    return _each_batch(stream, checkpoint, step, "complete")


def read_result(spark: SparkSession, output: str) -> DataFrame:
    """The last whole result."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(output).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(hadoop.Path(output))]
    done = [n for n in names if n.startswith(f"{BATCH}=") and fs.exists(hadoop.Path(f"{output}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{output}/{max(done, key=lambda n: int(n.split('=')[1]))}")


def running_counter(
    stream: DataFrame,
    key: str,
    order_by: str,
    payload: str,
    output: str,
    checkpoint: str,
    hot_rows: int | None = HOT_ROWS,
) -> DataStreamWriter:
    """Write `key, n, payload` per input row, as the batch form does; also keeps `final_state`."""
    rows = stream.select(key, order_by, payload)
    schema = (
        StructType().add(rows.schema[key]).add("n", LongType()).add(rows.schema[payload])
    )

    def step(batch: DataFrame, batch_id: int) -> None:
        state = LogState(batch.sparkSession, checkpoint, "counter", schema, key)
        before = state.read(batch_id, batch)
        _write_out(
            counter.running_counter(batch, key, order_by, payload, before, hot_rows=hot_rows),
            output, batch_id,
        )
        state.write(counter.final_state(batch, key, order_by, payload, before), batch_id)

    return _each_batch(rows, checkpoint, _fetched(checkpoint, step))


def count_window_counts(
    stream: DataFrame, key: str, size: int, slide: int, output: str, checkpoint: str
) -> DataStreamWriter:
    """Write `key, n, cnt` per pane, as the batch form does. State is the rows seen per key."""
    positive(size=size, slide=slide)
    rows = stream.select(key)
    schema = StructType().add(rows.schema[key]).add("n", LongType()).add("before", LongType())

    def step(batch: DataFrame, batch_id: int) -> None:
        state = LogState(batch.sparkSession, checkpoint, "seen", schema, key)
        old = state.read(batch_id, batch)
        counts = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        counts = counts.withColumn("before", F.lit(0).cast("bigint"))
        if old is not None:
            counts = counts.unionByName(old.withColumn("before", F.col("n"))).groupBy(key).agg(
                F.sum("n").alias("n"), F.sum("before").alias("before")
            )
        # Written once, and read back for the panes of this batch.
        seen = state.write(counts, batch_id)
        _write_out(panes_between(seen, [key], "before", "n", size, slide), output, batch_id)

    return _each_batch(rows, checkpoint, _fetched(checkpoint, step))


def count_window_reduce(
    stream: DataFrame,
    key: str,
    order_by: str,
    value: str,
    how: str,
    size: int,
    slide: int,
    output: str,
    checkpoint: str,
    into: str | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataStreamWriter:
    """Write `key, n, into` per pane: sum, min, max or count of `value`, as the batch form does.

    State is the rows seen per key, and of every pane begun but not ended the value so far.
    """
    positive(size=size, slide=slide)
    one_of("how", how, tuple(REDUCERS))
    into = into or how
    # Columns get names of their own, as one may be asked for twice.
    rows = stream.select(key, F.col(order_by).alias("__order"), F.col(value).alias("__value"))
    reduced = rows.groupBy(key).agg(REDUCERS[how]("__value").alias(into)).schema[into].dataType
    seen_schema = StructType().add(rows.schema[key]).add("n", LongType())
    pane_schema = (
        StructType().add(rows.schema[key]).add("__pane", LongType()).add("__end", LongType()).add(into, reduced)
    )

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen_state = LogState(spark, checkpoint, "seen", seen_schema, key)
        pane_state = LogState(spark, checkpoint, "panes", pane_schema, key, [key, "__pane"])
        seen, begun = seen_state.read(batch_id, batch), pane_state.read(batch_id, batch)

        numbered = number_rows(batch, [key], "__order", "n", seen, hot_rows)
        parts = (
            to_panes(numbered, size, slide, into="__pane")
            .groupBy(key, "__pane")
            .agg(F.max("n").alias("__end"), REDUCERS[how]("__value").alias(into))
        )
        if begun is not None:
            merged = parts.unionByName(begun).groupBy(key, "__pane").agg(
                F.max("__end").alias("__end"), MERGERS[how](into).alias(into)
            )
            parts = merged.withColumn(into, F.col(into).cast(reduced))
        # Written once: panes that have ended leave the state, and are read back as output.
        held = pane_state.write(parts.withColumn(GONE, F.col("__end") == F.col("__pane") * slide), batch_id)
        _write_out(held.where(GONE).select(key, F.col("__end").alias("n"), into), output, batch_id)

        counts = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        if seen is not None:
            counts = counts.unionByName(seen).groupBy(key).agg(F.sum("n").alias("n"))
        seen_state.write(counts, batch_id)

    return _each_batch(rows, checkpoint, _fetched(checkpoint, step))


# The stream as a whole -------------------------------------------------------------------------------


def _seen(state: LogState, batch_id: int) -> int:
    return state.note(batch_id - 1).get("seen", 0)


def pane_histogram(
    stream: DataFrame, word: str, order_by: str, size: int, slide: int, output: str, checkpoint: str
) -> DataStreamWriter:
    """Write `pane, word, cnt`, as `histogram.stream_histogram` does on a table; a pane comes with the batch it
    ends in.

    Rows are numbered through all batches. State is the number of rows so far, and the word counts of the slices
    that a pane to come still looks back on: each batch adds its own, and slices that all panes have passed
    go when runs are merged.
    """
    positive(size=size, slide=slide)
    run = histogram.slice_rows(size, slide)
    rows = stream.select(F.col(order_by).alias("__order"), F.col(word).alias("__word"))
    schema = StructType().add("__slice", LongType()).add(rows.schema["__word"]).add("__cnt", LongType())

    def added(slices: DataFrame) -> DataFrame:
        return slices.groupBy("__slice", "__word").agg(F.sum("__cnt").alias("__cnt"))

    def step(batch: DataFrame, batch_id: int) -> None:
        state = LogState(batch.sparkSession, checkpoint, "slices", schema, "__slice", ["__slice", "__word"], added)
        seen = _seen(state, batch_id)
        now = seen + batch.count()
        numbered = number_all_rows(batch, "__order", "__seq")
        numbered = numbered.select((F.col("__seq") + seen).alias("__seq"), "__word")
        first, last = seen // slide + 1, now // slide
        # No pane after the last one looks back beyond this row.
        passed = (F.col("__slice") + 1) * run <= (last + 1) * slide - size
        new = state.write(histogram.slices_of(numbered, "__word", run, "__seq"), batch_id, {"seen": now}, ~passed)
        if first <= last:
            held, old = new.drop(GONE), state.read(batch_id)
            held = held if old is None else held.unionByName(old)
            panes = histogram.panes_of_slices(held, "__word", run, size, slide, F.lit(first), F.lit(last))
            _write_out(panes.withColumnRenamed("__word", word), output, batch_id)

    return _each_batch(rows, checkpoint, _fetched(checkpoint, step))


def after_fill(
    stream: DataFrame, ts: str, order_by: str, fill: int, count: int, output: str, checkpoint: str
) -> DataStreamWriter:
    """Write `start, end, thp` once both rows are there, as `throughput.after_fill` gives them.

    State is the number of rows so far and the one time that was met; a batch sorts rows only if it holds the
    row at `fill` or at `fill + count`.
    """
    positive(fill=fill, count=count)
    rows = stream.select(F.col(order_by).alias("__order"), F.col(ts).alias("__ts"))
    schema = StructType().add("__at", LongType()).add(rows.schema["__ts"])

    def step(batch: DataFrame, batch_id: int) -> None:
        state = LogState(batch.sparkSession, checkpoint, "times", schema, "__at")
        seen = _seen(state, batch_id)
        now = seen + batch.count()
        wanted = [p - seen for p in (fill, fill + count) if seen < p <= now]
        if wanted:
            found = rows_at(batch, "__order", wanted, "__at").select((F.col("__at") + seen).alias("__at"), "__ts")
        else:
            found = batch.sparkSession.createDataFrame([], schema)
        new, old = state.write(found, batch_id, {"seen": now}).drop(GONE), state.read(batch_id)
        if seen < fill + count <= now:
            held = new if old is None else new.unionByName(old)
            _write_out(throughput.between_rows(held, "__ts", "__at", fill, count), output, batch_id)

    return _each_batch(rows, checkpoint, _fetched(checkpoint, step))
