import pytest

from panewise.operators.counter import final_state, keep_key, running_counter
from panewise.plans.jobs import keyed_counter, window_word_count

LINES = ["1 x", "2 y", "1 z extra", "1 x"]


@pytest.fixture(scope="module")
def records(spark):
    rows = [(1, 0, "x"), (2, 1, "y"), (1, 2, "z"), (1, 3, "x")]
    return spark.createDataFrame(rows, "key int, o bigint, payload string")


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(list(enumerate(LINES)), "o bigint, value string")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("hot_rows", [None, 1, 100])
def test_counter(records, hot_rows):
    counted = running_counter(records, "key", "o", "payload", hot_rows=hot_rows)
    assert rows(counted) == [(1, 1, "x"), (1, 2, "z"), (1, 3, "x"), (2, 1, "y")]
    assert rows(keep_key(counted, "key", 1)) == [(1, 1, "x"), (1, 2, "z"), (1, 3, "x")]


def test_strict(records):
    counted = running_counter(records, "key", "o", "payload", strict=True)
    assert rows(counted) == [(0, 1, "x"), (0, 1, "y"), (0, 2, "z"), (0, 3, "x")]
    assert counted.schema["key"].dataType.simpleString() == "int"
    assert rows(keep_key(counted, "key", 1, strict=True)) == []


def test_final_state(spark, records):
    state = final_state(records, "key", "o", "payload")
    assert rows(state) == [(1, 3, "x"), (2, 1, "y")]
    more = spark.createDataFrame([(2, 10, "q"), (3, 11, "r")], "key int, o bigint, payload string")
    assert rows(final_state(more, "key", "o", "payload", state)) == [(1, 3, "x"), (2, 2, "q"), (3, 1, "r")]
    counted = running_counter(more, "key", "o", "payload", state)
    assert rows(counted) == [(2, 2, "q"), (3, 1, "r")]


def test_counter_job(lines):
    assert rows(keyed_counter(lines, "o")) == [("(1,1,x)",), ("(1,2,z)",), ("(1,3,x)",)]
    assert len(rows(keyed_counter(lines, "o", key=None))) == 4
    assert rows(keyed_counter(lines, "o", strict=True)) == []
    assert ("(0,2,z)",) in rows(keyed_counter(lines, "o", key=None, strict=True))


def test_window_job(spark):
    words = spark.createDataFrame([(line,) for line in ["1 2 1", "", "1 1 2 1"]], "value string")
    assert rows(window_word_count(words, 3, 2)) == [("(1,2)",), ("(1,3)",)]
    assert rows(window_word_count(words, 3, 2, word=None)) == [("(1,2)",), ("(1,3)",), ("(2,2)",)]
