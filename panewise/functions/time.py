"""Time differences that mean the same in every session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def micros_between(start: Column | str, end: Column | str) -> Column:
    """Microseconds as BIGINT, for TIMESTAMP and TIMESTAMP_NTZ alike.

    Functions that want a TIMESTAMP would read a zoneless one in the session's zone, where clocks may
    jump; the difference of two zoneless timestamps does not.
    """
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    span = end - start

    def whole(field: str, micros: int) -> Column:
        return F.extract(F.lit(field), span).cast("bigint") * F.lit(micros).cast("bigint")

    # Seconds come with their fraction, as DECIMAL(8,6).
    seconds = (F.extract(F.lit("SECOND"), span) * F.lit(1_000_000)).cast("bigint")
    return (
        whole("DAY", 86_400_000_000) + whole("HOUR", 3_600_000_000) + whole("MINUTE", 60_000_000)
        + seconds
    )


def micros_since_1970(rows: DataFrame, ts: str) -> Column:
    return micros_between(F.lit("1970-01-01 00:00:00").cast(rows.schema[ts].dataType), ts)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return micros_between(start, end).cast("double") / F.lit(1e6)
