"""The two jobs end to end: lines in, printed records out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panewise.functions.text import parse_key_payload, split_words, tokenize, tuple_text
from panewise.operators.count_window import count_window_counts
from panewise.operators.counter import keep_key, running_counter
from panewise.streaming import stateful

# The word and the key whose records the jobs let through.
WATCHED_WORD = "1"
WATCHED_KEY = 1


def window_word_count(
    lines: DataFrame, size: int, slide: int, word: str | None = WATCHED_WORD, column: str = "value"
) -> DataFrame:
    """`value`: `(word,count)` of every count window of the word (of all words with None)."""
    counts = count_window_counts(tokenize(lines, column), ["word"], size, slide)
    if word is not None:
        counts = keep_key(counts, "word", word)
    return counts.select(tuple_text("word", "cnt").alias("value"))


def keyed_counter(
    lines: DataFrame,
    order_by: str,
    key: int | None = WATCHED_KEY,
    strict: bool = False,
    column: str = "value",
    on_error: str = "fail",
) -> DataFrame:
    """`value`: `(key,n,payload)` of every `key payload` line of the key (of all keys with None).

    strict  print 0 for every key, and let nothing through when a key is asked for
    """
    records = parse_key_payload(lines, column, (order_by,), on_error)
    counted = running_counter(records, "key", order_by, "payload", strict=strict)
    if key is not None:
        counted = keep_key(counted, "key", key, strict)
    return counted.select(tuple_text("key", "n", "payload").alias("value"))


def stream_window_word_count(
    lines: DataFrame, size: int, slide: int, word: str | None = WATCHED_WORD, column: str = "value"
) -> DataFrame:
    """`window_word_count` on a stream. A word asked for is filtered before the state, not after:
    panes of one word do not depend on the others."""
    words = lines.select(F.explode(split_words(column)).alias("word"))
    if word is not None:
        words = keep_key(words, "word", word)
    counts = stateful.count_window_counts(words, "word", size, slide)
    return counts.select(tuple_text("word", "cnt").alias("value"))


def stream_keyed_counter(
    lines: DataFrame,
    key: int | None = WATCHED_KEY,
    strict: bool = False,
    column: str = "value",
    on_error: str = "fail",
    order_by: str | None = None,
) -> DataFrame:
    """`keyed_counter` on a stream: in arrival order, or each key's rows of a micro-batch by `order_by`."""
    records = parse_key_payload(lines, column, (order_by,) if order_by else (), on_error)
    if key is not None:
        records = keep_key(records, "key", key, strict)
    counted = stateful.running_counter(records, "key", "payload", order_by)
    shown = F.lit(0) if strict else F.col("key")
    return counted.select(tuple_text(shown, "n", "payload").alias("value"))
