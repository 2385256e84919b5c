import random

import pytest
from pyspark.sql import functions as F

from models import numbered
from panewise.operators import running
from panewise.operators.ranges import explode_range
from panewise.operators.running import (
    hot_keys,
    mark_hot,
    number_all_rows,
    number_rows,
    rows_at,
    running_sum,
)


def keyed(spark, rows):
    return spark.createDataFrame(rows, "key string, o bigint, v bigint").repartition(5)


def some_rows(orders, seed=1):
    r = random.Random(seed)
    keys = ["hot"] * 10 + [None] * 4 + ["a", "b", "c"]
    return [(r.choice(keys), o, r.randrange(100)) for o in orders]


ORDERS = {
    "dense": list(range(600)),
    "sparse": random.Random(3).sample(range(-(1 << 40), 1 << 40), 300),
    "two clumps": list(range(200)) + list(range(1 << 50, (1 << 50) + 200)),
}


@pytest.mark.parametrize("bits", [(), (3,), (3, 2), (5, 4, 3)], ids=str)
@pytest.mark.parametrize("orders", ORDERS)
def test_number_rows(spark, orders, bits):
    rows = some_rows(ORDERS[orders])
    got = number_rows(keyed(spark, rows), ["key"], "o", hot_rows=50, bits=bits).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(numbered(rows), key=repr)


def test_number_rows_is_the_same_split_or_not(spark):
    df = keyed(spark, some_rows(ORDERS["dense"]))
    plain = number_rows(df, ["key"], "o", hot_rows=None)
    for hot_rows in (1, 30, 10**9):
        split = number_rows(df, ["key"], "o", hot_rows=hot_rows, bits=(4, 3))
        assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0


def test_number_rows_continues_from_initial(spark):
    rows = some_rows(ORDERS["dense"])
    start = {"hot": 1000, "a": 7, None: 20, "not in rows": 5}
    initial = spark.createDataFrame(list(start.items()), "key string, n bigint")
    want = [(k, o, v, n + start.get(k, 0)) for k, o, v, n in numbered(rows)]
    for hot_rows in (None, 50, 10**9):
        got = number_rows(
            keyed(spark, rows), ["key"], "o", initial=initial, hot_rows=hot_rows, bits=(4, 2)
        )
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_two_key_columns(spark):
    rows = some_rows(ORDERS["dense"])
    df = keyed(spark, rows).withColumn("odd", F.col("v") % 2)
    got = number_rows(df, ["key", "odd"], "o", hot_rows=20, bits=(3, 3)).collect()
    want = numbered([((k, v % 2), o, v) for k, o, v in rows])
    assert sorted(((r.key, r.odd), r.o, r.v, r.n) for r in got if r.key) == sorted(
        w for w in want if w[0][0]
    )
    assert len(got) == len(rows)


def test_running_sum_of_weights(spark):
    rows = [(o, (o * 7) % 13) for o in random.Random(5).sample(range(1 << 45), 400)]
    df = spark.createDataFrame(rows, "o bigint, w bigint").repartition(6)
    got = {r.o: r.s for r in running_sum(df, "o", F.col("w"), "s", bits=(40, 3)).collect()}
    total, want = 0, {}
    for o, w in sorted(rows):
        total += w
        want[o] = total
    assert got == want


def test_number_all_rows(spark):
    df = keyed(spark, some_rows(ORDERS["two clumps"]))
    got = {r.o: r.seq for r in number_all_rows(df, "o", bits=(4, 6)).collect()}
    assert got == {o: i + 1 for i, o in enumerate(sorted(ORDERS["two clumps"]))}


def test_rows_at(spark):
    orders = ORDERS["sparse"]
    df = keyed(spark, some_rows(orders))
    got = {r.seq: r.o for r in rows_at(df, "o", [1, 150, 300, 301], bits=(33, 5)).collect()}
    ranked = sorted(orders)
    assert got == {1: ranked[0], 150: ranked[149], 300: ranked[299]}


@pytest.mark.parametrize("hot_rows", [None, 1, 10**6])
def test_a_row_without_an_order_is_not_lost_silently(spark, hot_rows):
    df = spark.createDataFrame([("a", 1), ("a", None)], "key string, o bigint")
    with pytest.raises(Exception, match="null in the order column o"):
        number_rows(df, ["key"], "o", hot_rows=hot_rows).collect()
    with pytest.raises(Exception, match="null in the order column o"):
        number_all_rows(df, "o").collect()
    with pytest.raises(Exception, match="null in the order column o"):
        rows_at(df, "o", [1]).collect()


def test_hot_keys_are_the_largest(spark):
    rows = some_rows(ORDERS["dense"])
    df = keyed(spark, rows)
    assert {r.key for r in hot_keys(df, ["key"], "o", 50).collect()} == {"hot", None}
    assert mark_hot(df, ["key"], "o", "is_hot", 10**6) is None
    marked = mark_hot(df, ["key"], "o", "is_hot", 50)
    assert {r.key for r in marked.where("is_hot").collect()} == {"hot", None}
    assert marked.count() == len(rows)


def test_hot_keys_from_some_rows(spark):
    key = F.when(F.col("id") % 3 == 0, "third").otherwise((F.col("id") % 5000).cast("string"))
    df = spark.range(200_000).select(F.col("id").alias("o"), key.alias("key"))
    hot = hot_keys(df, ["key"], "o", 20_000)
    assert [r.key for r in hot.collect()] == ["third"]
    numbered = number_rows(df, ["key"], "o", hot_rows=20_000, bits=(10, 4))
    assert numbered.exceptAll(number_rows(df, ["key"], "o", hot_rows=None)).count() == 0


def test_hot_keys_that_are_not_broadcast(spark, monkeypatch):
    rows = some_rows(ORDERS["dense"])
    monkeypatch.setattr(running, "BROADCAST_KEYS", 0)
    got = number_rows(keyed(spark, rows), ["key"], "o", hot_rows=50, bits=(4, 3))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(numbered(rows), key=repr)


@pytest.mark.parametrize("block", [1, 3, 100])
def test_explode_range(spark, block):
    df = spark.createDataFrame([("a", 1, 10), ("b", 5, 5), ("c", 3, 2)], "k string, f bigint, t bigint")
    got = explode_range(df, F.col("f"), F.col("t"), "i", block).collect()
    assert sorted((r.k, r.i) for r in got) == [("a", i) for i in range(1, 11)] + [("b", 5)]
