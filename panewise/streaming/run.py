"""Run a stream to the end of its input and measure it."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from panewise.operators.throughput import rate
from panewise.streaming.state import session_settings, state_profile


class Totals(StreamingQueryListener):
    """Running totals of every query's batches, by its run; no report is kept."""

    def __init__(self):
        self._runs: dict[str, dict] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _of(self, run: str) -> tuple[dict, threading.Event]:
        with self._lock:
            empty = {"batches": 0, "rows": 0, "state_rows": 0, "state_bytes": 0}
            return self._runs.setdefault(run, empty), self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._of(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        totals, _ = self._of(str(progress.runId))
        totals["batches"] += 1
        totals["rows"] += max(0, progress.numInputRows)
        totals["state_rows"] = sum(s.numRowsTotal for s in progress.stateOperators)
        totals["state_bytes"] = sum(s.memoryUsedBytes for s in progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._of(str(event.runId))[1].set()

    def take(self, run: str, seconds: float = 60) -> dict:
        """The totals of a run that has ended, once its last report is in."""
        totals, ended = self._of(run)
        if not ended.wait(seconds):
            raise TimeoutError(f"no end of the stream run {run} was reported")
        return totals


def run_to_end(
    spark: SparkSession,
    writer: DataStreamWriter,
    profile: str = "rocksdb",
    given: int | None = None,
    **profile_options: int,
) -> DataFrame:
    """Process all input there is now, wait for the end, return one row of measures.

    thp is `given` rows (else the rows read) over the time from start to end, start-up included. Rows are
    added up as batches end, however many there are.
    """
    totals = Totals()
    spark.streams.addListener(totals)
    try:
        begin = time.monotonic()
        with session_settings(spark, state_profile(profile, **profile_options)):
            query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        seconds = time.monotonic() - begin
        seen = totals.take(str(query.runId))
    finally:
        spark.streams.removeListener(totals)
    counted = given if given is not None else seen["rows"]
    return _measure(spark, seen["batches"], seen["rows"], seconds, counted, seen["state_rows"], seen["state_bytes"])


def _measure(
    spark: SparkSession,
    batches: int,
    rows: int,
    seconds: float,
    counted: int,
    state_rows: int = 0,
    state_bytes: int = 0,
) -> DataFrame:
    time_taken = F.lit(seconds).cast("double")
    return spark.range(1).select(
        F.lit(batches).cast("bigint").alias("batches"),
        F.lit(rows).cast("bigint").alias("rows"),
        time_taken.alias("seconds"),
        rate(F.lit(counted), time_taken).alias("thp"),
        F.lit(state_rows).cast("bigint").alias("state_rows"),
        F.lit(state_bytes).cast("bigint").alias("state_bytes"),
    )


def timed_write(spark: SparkSession, rows: int, write) -> DataFrame:
    """Run `write()`, a batch write of `rows` rows, and return its measures."""
    begin = time.monotonic()
    write()
    seconds = time.monotonic() - begin
    return _measure(spark, 1, rows, seconds, rows)
