"""Lines to words, lines to keyed records, records to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panewise.functions.checks import one_of

# The whitespace a word ends at, as characters and as a pattern (ASCII only, so a
# no-break space does not split).
WHITESPACE = " \t\n\x0b\f\r"
WHITESPACE_CHAR = r"\s"

# Fixed value: what a key may look like before it is read as a 32-bit integer.
INTEGER_KEY = r"^[+-]?[0-9]+\z"


def split_words(line: Column | str) -> Column:
    """Array of the words of a line, split at every single whitespace character.

    Empty words at the end are dropped, those at the start and in between are kept. An empty line is
    one empty word; a line of whitespace only has no words.
    """
    line = F.col(line) if isinstance(line, str) else line
    body = F.rtrim(line, F.lit(WHITESPACE))
    blank = (body == "") & (line != "")
    return F.when(blank, F.array().cast("array<string>")).otherwise(F.split(body, WHITESPACE_CHAR))


def tokenize(lines: DataFrame, column: str = "value", into: str = "word") -> DataFrame:
    """One row per word."""
    return lines.select(F.explode(split_words(column)).alias(into))


def parse_key_payload(
    lines: DataFrame, column: str = "value", keep: tuple[str, ...] = (), on_error: str = "fail"
) -> DataFrame:
    """`key payload [ignored ...]` lines as `key INT, payload STRING` plus the columns in `keep`.

    A line with no integer key or with fewer than two words, and a null one, fails the query, or is dropped
    with `on_error="drop"`. Every output column checks the whole line, so that a bad line also fails where
    only some columns are read or rows are filtered by one.
    """
    one_of("on_error", on_error, ("fail", "drop"))
    parts = split_words(column)
    key = F.get(parts, F.lit(0))
    number = F.when(key.rlike(INTEGER_KEY), key.try_cast("int"))
    payload = F.get(parts, F.lit(1))
    if on_error == "drop":
        return lines.select(*keep, number.alias("key"), payload.alias("payload")).where(
            F.col("key").isNotNull() & F.col("payload").isNotNull()
        )
    good = number.isNotNull() & payload.isNotNull()
    complaint = F.raise_error(F.concat(F.lit("not a `key payload` line: "), as_text(column)))

    def checked(value: Column, kind) -> Column:
        return F.when(good, value).otherwise(complaint.cast(kind))

    return lines.select(
        *[checked(F.col(c), lines.schema[c].dataType).alias(c) for c in keep],
        checked(number, "int").alias("key"),
        checked(payload, "string").alias("payload"),
    )


def as_text(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("null"))


def tuple_text(*columns: Column | str) -> Column:
    """A record printed as `(a,b,c)`."""
    return F.concat(F.lit("("), F.concat_ws(",", *[as_text(c) for c in columns]), F.lit(")"))


def word_with_count(word: Column | str, count: Column | str) -> Column:
    """The named record `struct<word STRING, count BIGINT>`."""
    word = F.col(word) if isinstance(word, str) else word
    count = F.col(count) if isinstance(count, str) else count
    return F.struct(word.cast("string").alias("word"), count.cast("bigint").alias("count"))


def word_with_count_text(record: Column) -> Column:
    """The record of `word_with_count` printed as `word : count`."""
    return F.concat(as_text(record["word"]), F.lit(" : "), as_text(record["count"]))
