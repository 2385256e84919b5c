import random

import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from models import panes
from panewise.operators import count_window as windows
from panewise.operators.count_window import count_window, count_window_counts, count_window_reduce

STREAM = "a a b a a b a".split()
CASES = {
    (3, 2): [("a", 2, 2), ("a", 4, 3), ("b", 2, 2)],
    (2, 2): [("a", 2, 2), ("a", 4, 2), ("b", 2, 2)],
    (1, 3): [("a", 3, 1)],
    (3, 1): [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 4, 3), ("a", 5, 3), ("b", 1, 1), ("b", 2, 2)],
    (5, 6): [],
}


@pytest.fixture(scope="module")
def stream(spark):
    rows = [(w, i) for i, w in enumerate(STREAM)]
    return spark.createDataFrame(rows, "word string, o bigint").repartition(3)


@pytest.mark.parametrize("size,slide", CASES)
def test_counts(stream, size, slide):
    got = count_window_counts(stream, ["word"], size, slide).collect()
    assert sorted(map(tuple, got)) == CASES[size, slide]


@pytest.mark.parametrize("hot_rows", [None, 1, 10**6])
@pytest.mark.parametrize("size,slide", CASES)
def test_rows(stream, size, slide, hot_rows):
    aggs = [F.count(F.lit(1)).alias("cnt")]
    got = count_window(stream, ["word"], "o", size, slide, aggs, hot_rows).collect()
    assert sorted((r.word, r.n, r.cnt) for r in got) == CASES[size, slide]


def test_sum(spark):
    df = spark.createDataFrame([("k", i, i) for i in range(1, 8)], "k string, o bigint, v bigint")
    got = count_window_reduce(df, ["k"], "o", "v", "sum", 3, 2).collect()
    assert sorted((r.n, r["sum"]) for r in got) == [(2, 3), (4, 9), (6, 15)]


@pytest.mark.parametrize("size,slide", [(0, 1), (1, 0), (-1, 2), (2.0, 1), (True, 1)])
def test_bad_sizes(stream, size, slide):
    with pytest.raises(ValueError):
        count_window_counts(stream, ["word"], size, slide)
    with pytest.raises(ValueError):
        count_window(stream, ["word"], "o", size, slide, [F.count("*")])
    with pytest.raises(ValueError):
        count_window_reduce(stream, ["word"], "o", "o", "sum", size, slide)


def test_unknown_reducer(stream):
    with pytest.raises(ValueError):
        count_window_reduce(stream, ["word"], "o", "o", "median", 2, 1)


@settings(
    max_examples=8, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.generate, Phase.explicit]
)
@given(
    size=st.integers(1, 60), slide=st.integers(1, 12), hot=st.sampled_from([None, 1, 40]),
    seed=st.integers(0, 99), how=st.sampled_from(["sum", "min", "max", "count"]),
)
def test_any_window_against_a_list(spark, size, slide, hot, seed, how):
    r = random.Random(seed)
    rows = [(r.choice(["x"] * 6 + ["y", "z", None]), o, r.randrange(-50, 50)) for o in range(250)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(3)
    expected = panes(rows, size, slide)
    reduce = {"sum": sum, "min": min, "max": max, "count": len}[how]

    got = count_window_reduce(df, ["k"], "o", "v", how, size, slide, "r", hot).collect()
    assert sorted(((r.k, r.n), r.r) for r in got if r.k) == sorted(
        (kn, reduce(p)) for kn, p in expected.items() if kn[0]
    )
    assert len(got) == len(expected)

    aggs = [F.sort_array(F.collect_list(F.struct("n", "v"))).alias("vs")]
    listed = count_window(df, ["k"], "o", size, slide, aggs, hot).collect()
    assert {(r.k, r.n): [x.v for x in r.vs] for r in listed} == expected

    counted = count_window_counts(df, ["k"], size, slide).collect()
    assert {(r.k, r.n): r.cnt for r in counted} == {kn: len(p) for kn, p in expected.items()}


@pytest.mark.parametrize("block", [1, 1 << 18])
def test_long_panes_through_a_frame(spark, monkeypatch, block):
    monkeypatch.setattr(windows, "FRAME_BLOCK", block)
    r = random.Random(4)
    rows = [(r.choice(["x"] * 6 + ["y", None]), o, r.choice([None, *range(9)])) for o in range(300)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(3)
    aggs = [F.collect_list("v").alias("vs"), F.count(F.lit(1)).alias("cnt"), F.min_by("v", "n").alias("oldest")]
    got = count_window(df, ["k"], "o", 40, 2, aggs, hot_rows=50, bits=(5, 4))
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    want = panes(rows, 40, 2)
    # The order inside a list is not promised.
    assert {(x.k, x.n): (sorted(x.vs), x.cnt, x.oldest) for x in got.collect()} == {
        kn: (sorted(v for v in p if v is not None), len(p), p[0]) for kn, p in want.items()
    }


@pytest.mark.parametrize("size,slide", [(3, 2), (40, 2)])
def test_decimals_and_repeated_columns(spark, size, slide):
    df = spark.createDataFrame([(i % 2, i, i) for i in range(100)], "k bigint, o bigint, v bigint")
    money = df.withColumn("v", F.col("v").cast("decimal(10,2)"))
    got = count_window_reduce(money, ["k"], "o", "v", "sum", size, slide)
    assert got.schema["sum"].dataType.simpleString() == "decimal(20,2)"
    plain = count_window_reduce(df, ["k"], "o", "v", "sum", size, slide)
    assert got.select("k", "n", F.col("sum").cast("bigint")).exceptAll(plain).count() == 0
    # The value may be the order column or a key.
    assert count_window_reduce(df, ["k"], "o", "o", "sum", size, slide).exceptAll(plain).count() == 0
    same = count_window_reduce(df, ["k"], "o", "k", "max", size, slide)
    assert same.where("k <> max").count() == 0 and same.count() == plain.count()
