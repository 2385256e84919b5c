import random
from collections import Counter
from math import gcd

import pytest
from pyspark.sql import functions as F

from panewise.operators.histogram import (
    bottom_counts,
    candidates_of_groups,
    histogram,
    histogram_by_changes,
    number_words,
    pane_histogram,
    stream_histogram,
    top_words,
    top_words_of_lines,
    top_words_of_panes,
    total_words,
)

WORDS = ["a"] * 5 + ["b"] * 2 + ["c"] * 2 + ["d"]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w, i * 3) for i, w in enumerate(WORDS)], "w string, o bigint")


def test_histogram(words):
    assert {r.w: r.cnt for r in histogram(words, "w").collect()} == Counter(WORDS)


def test_top_and_bottom(words):
    panes = stream_histogram(words, "w", "o", 10, 10)
    assert [(r.w, r.cnt) for r in top_words(panes, "w", 2).orderBy("r").collect()] == [("a", 5), ("b", 2)]
    assert [(r.w, r.cnt) for r in bottom_counts(panes, "w", 2).orderBy("r").collect()] == [("d", 1), ("b", 2)]


@pytest.mark.parametrize("size,slide", [(4, 2), (3, 2), (5, 5), (2, 3), (10, 1), (6, 4), (11, 12)])
def test_panes(words, size, slide):
    got = {}
    for r in stream_histogram(words, "w", "o", size, slide).collect():
        got.setdefault(r.pane, {})[r.w] = r.cnt
    want = {
        j: Counter(WORDS[max(0, j * slide - size) : j * slide])
        for j in range(1, len(WORDS) // slide + 1)
    }
    assert got == want


def test_words_of_lines(spark):
    lines = ["x y", "", "  ", "y  z ", "x"]
    df = spark.createDataFrame(list(enumerate(lines)), "o bigint, value string").repartition(3)
    numbered = number_words(df, "value", "o")
    got = [(r.seq, r.word) for r in numbered.orderBy("seq").collect()]
    assert got == list(enumerate(["x", "y", "", "y", "", "z", "x"], 1))
    panes = pane_histogram(numbered, "word", 4, 3, total_words(df, "value", "o"))
    assert {(r.pane, r.word): r.cnt for r in panes.collect()} == {
        (1, "x"): 1, (1, "y"): 1, (1, ""): 1, (2, ""): 2, (2, "y"): 1, (2, "z"): 1
    }


def test_bad_arguments(words):
    with pytest.raises(ValueError):
        stream_histogram(words, "w", "o", 0, 1)
    with pytest.raises(ValueError):
        top_words(words.withColumn("pane", F.lit(1)).withColumn("cnt", F.lit(1)), "w", 0)


@pytest.mark.parametrize("bits", [1, 3, 20])
@pytest.mark.parametrize("size,slide", [(5, 1), (3, 2), (40, 3), (2, 5), (500, 7)])
def test_panes_from_changes_are_those_of_copies(spark, size, slide, bits):
    """Stretches of two and eight panes carry counts from one to the next, also past stretches without a change."""
    words = [random.Random(3).choice("aaab") for _ in range(150)] + ["c"] + ["a"] * 150
    rows = spark.createDataFrame([(i + 1, w if w != "b" else None) for i, w in enumerate(words)], "seq bigint, w string")
    got = histogram_by_changes(rows, "w", size, slide, F.lit(len(words)), "seq", bits)
    want = {
        j: Counter(w if w != "b" else None for w in words[max(0, j * slide - size) : j * slide])
        for j in range(1, len(words) // slide + 1)
    }
    found = {}
    for r in got.collect():
        assert r.w not in found.setdefault(r.pane, {})
        found[r.pane][r.w] = r.cnt
    assert found == want


@pytest.mark.parametrize("size,slide,k", [(100, 3, 2), (160, 1, 3), (64, 4, 1), (90, 10, 9), (30, 40, 2)])
def test_bounds_leave_the_top_words_alone(spark, size, slide, k):
    r = random.Random(size)
    words = [r.choice(["a"] * 9 + ["b"] * 6 + ["c"] * 6 + [None] + list("defghijklmn")) for _ in range(700)]
    rows = spark.createDataFrame([(i + 1, w) for i, w in enumerate(words)], "seq bigint, w string").repartition(3)
    total = F.lit(len(words))
    want = top_words(pane_histogram(rows, "w", size, slide, total), "w", k)
    got = top_words_of_panes(rows, "w", size, slide, total, k)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    if k < 3 and size > 8 * slide:  # most words are never sent to a pane
        slices = rows.groupBy(((F.col("seq") - 1) / gcd(size, slide)).cast("bigint").alias("__slice"), F.col("w").alias("__word")).agg(F.count("*").alias("__cnt"))
        sent = candidates_of_groups(slices, gcd(size, slide), size, slide, total, k)
        assert sent.select("__word").distinct().count() <= 10  # of 16


@pytest.mark.parametrize(
    "size,slide,k,stretch,listed",
    [(160, 10, 3, 100, 8), (200, 5, 2, 400, 4), (60, 30, 3, 100, 8), (70, 30, 1, 1, 32), (40, 40, 2, 90, 2), (9, 20, 2, 50, 4), (33, 4, 50, 100, 4)],
)
def test_top_words_of_lines(spark, size, slide, k, stretch, listed):
    rng = random.Random(size)
    lines = [" ".join(rng.choices(["the", "of", "", "and", *"abcdefghij"], [9, 6, 1, 4] + [1] * 10, k=rng.randint(0, 25))) for _ in range(60)]
    lines[20:20] = [None, "", "  ", " ".join(rng.choices("uvw", [3, 2, 1], k=300)), "x  y ", " ".join(f"w{i}" for i in range(200))]
    rows = spark.createDataFrame([(i * 7, t) for i, t in enumerate(lines)], "o bigint, value string").repartition(3)
    got = top_words_of_lines(rows, "value", "o", size, slide, k, stretch=stretch, listed=listed)
    panes = pane_histogram(number_words(rows, "value", "o"), "word", size, slide, total_words(rows, "value", "o"))
    want = top_words(panes, "word", k)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_top_words_of_lines_shuffles_words_as_lines(spark):
    rows = spark.createDataFrame([(1, "a b a")], "o bigint, value string")
    plan = top_words_of_lines(rows, "value", "o", 4, 2, 1)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert shuffled and not any("word#" in line.split("hashpartitioning(")[1].split("]")[0] for line in shuffled)
