import pytest
from pyspark.sql import functions as F

from panewise.plans import jobs
from panewise.functions.text import (
    parse_key_payload,
    split_words,
    tokenize,
    tuple_text,
    word_with_count,
    word_with_count_text,
)

LINES = {
    "": [""],
    "   ": [],
    "\r": [],
    " a": ["", "a"],
    "a ": ["a"],
    "a  b": ["a", "", "b"],
    "a b c  ": ["a", "b", "c"],
    "a\tb\x0bc": ["a", "b", "c"],
    "a\u00a0b": ["a\u00a0b"],
    "x": ["x"],
}


def test_split_words(spark):
    df = spark.createDataFrame([(line,) for line in LINES], "value string")
    got = {r.value: r.w for r in df.select("value", split_words("value").alias("w")).collect()}
    assert got == LINES


def test_tokenize_drops_nothing_but_blank_lines(spark):
    df = spark.createDataFrame([(line,) for line in [*LINES, None]], "value string")
    words = sorted(r.word for r in tokenize(df).collect())
    assert words == sorted(w for ws in LINES.values() for w in ws)


BAD = ["x y", "1.5 y", "2147483648 y", "5", "5 ", " 5 y", "", "   ", "- y", "5\x01 y"]
GOOD = {"+5 y": (5, "y"), "-7 y": (-7, "y"), "1 z extra": (1, "z"), "2147483647 a": (2147483647, "a")}


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_parse_drop(spark):
    got = parse_key_payload(lines(spark, BAD + list(GOOD)), on_error="drop").collect()
    assert sorted(tuple(r) for r in got) == sorted(GOOD.values())


def test_parse_keep(spark):
    got = parse_key_payload(lines(spark, GOOD), keep=("value",)).collect()
    assert {r.value: (r.key, r.payload) for r in got} == GOOD


@pytest.mark.parametrize("line", BAD)
def test_parse_fails(spark, line):
    with pytest.raises(Exception, match="not a `key payload` line"):
        parse_key_payload(lines(spark, [line])).collect()


@pytest.mark.parametrize("bad", ["2", None])
def test_a_bad_line_fails_whatever_is_read_of_it(spark, bad):
    df = spark.createDataFrame([(0, "1 a"), (1, bad), (2, "1 b")], "i bigint, value string")
    records = parse_key_payload(df, keep=("i",))
    for read in (records.select("key"), records.select("payload"), records.select("i"), records.where("key = 1")):
        with pytest.raises(Exception, match="not a `key payload` line"):
            read.collect()
    with pytest.raises(Exception, match="not a `key payload` line"):
        jobs.keyed_counter(df, "i", key=1).collect()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_parse_does_not_hang_on_ansi_mode(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="not a `key payload` line"):
            parse_key_payload(lines(spark, ["2147483648 y"])).collect()
        assert parse_key_payload(lines(spark, ["2147483648 y"]), on_error="drop").count() == 0
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_parse_rejects_unknown_mode(spark):
    with pytest.raises(ValueError):
        parse_key_payload(lines(spark, ["1 a"]), on_error="ignore")


def test_printing(spark):
    df = spark.createDataFrame([("a", 5, None)], "word string, n bigint, none string")
    row = df.select(
        tuple_text("word", "n").alias("two"),
        tuple_text("word", "n", "none").alias("three"),
        word_with_count_text(word_with_count("word", "n")).alias("named"),
        F.to_json(word_with_count("word", "n")).alias("record"),
    ).first()
    assert tuple(row) == ("(a,5)", "(a,5,null)", "a : 5", '{"word":"a","count":5}')
