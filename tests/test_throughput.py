from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panewise.functions.time import micros_between
from panewise.operators.throughput import after_fill, fixed_time, rate, until_idle, warm_mean

START = datetime(2024, 3, 10, 0, 0, 0)


def at(spark, seconds, zone="timestamp_ntz"):
    rows = [(i, START + timedelta(seconds=s), "x" if i % 2 else "y") for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "i bigint, ts timestamp_ntz, topic string").repartition(3)
    return df.withColumn("ts", F.col("ts").cast(zone))


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_until_idle(spark):
    got = until_idle(at(spark, [0, 1, 2, 3, 20, 21]), "ts", 10_000).orderBy("start").collect()
    assert [(r.n, r.start, r.end) for r in got] == [
        (4, START, START + timedelta(seconds=3)),
        (2, START + timedelta(seconds=20), START + timedelta(seconds=21)),
    ]
    assert [r.thp for r in got] == [4 / 3, 2.0]


def test_until_idle_given_and_alone(spark):
    got = until_idle(at(spark, [0, 2, 50]), "ts", 10_000, given=10).orderBy("start").collect()
    assert [(r.n, r.thp) for r in got] == [(2, 5.0), (1, None)]


def test_until_idle_does_not_jump_with_the_clock(spark, zone):
    # Every 9 minutes through the night the clocks change in New York.
    seconds = [i * 540 for i in range(60)] + [60 * 540 + 600]
    got = until_idle(at(spark, seconds), "ts", 600_000).collect()
    assert [r.n for r in got] == [60, 1] or [r.n for r in got] == [1, 60]


@pytest.mark.parametrize("gap,sessions", [(9, 1), (10, 1), (10.000001, 2), (11, 2)])
def test_pause_boundary_is_that_of_session_window(spark, gap, sessions):
    df = at(spark, [0, gap])
    assert until_idle(df, "ts", 10_000).count() == sessions
    assert df.groupBy(F.session_window("ts", "10 seconds")).count().count() == sessions


def test_until_idle_against_a_loop(spark):
    import random

    r = random.Random(2)
    seconds = sorted(r.random() * 4000 for _ in range(900))
    df = at(spark, seconds)
    for by in ([], ["topic"]):
        got = until_idle(df, "ts", 7_000, by=by).collect()
        want = 0
        for topic in ("x", "y") if by else (None,):
            mine = [s for i, s in enumerate(seconds) if topic is None or topic == ("x" if i % 2 else "y")]
            want += 1 + sum(b - a > 7 for a, b in zip(mine, mine[1:]))
        assert len(got) == want and sum(x.n for x in got) == 900


def test_until_idle_across_stretches(spark, monkeypatch):
    from panewise.operators import throughput

    seconds = [i * 5 for i in range(100)] + [2000, 2003]
    monkeypatch.setattr(throughput, "_BUCKETS_PER_STRETCH", 2)
    got = until_idle(at(spark, seconds), "ts", 10_000).orderBy("start").collect()
    assert [r.n for r in got] == [100, 2]


def test_fixed_time_and_warm_mean(spark):
    # Runs of 10 s with 5, 1, 0, 2, 3, 4 and then 9 rows.
    sizes = [5, 1, 0, 2, 3, 4, 9]
    seconds = [run * 10 + j for run, size in enumerate(sizes) for j in range(size)]
    measured = fixed_time(at(spark, seconds), "ts", 10_000)
    assert [(r.n, r.thp) for r in measured.orderBy("start").collect()] == [
        (s, s / 10) for s in sizes if s
    ]
    assert warm_mean(measured, 10_000).first().thp == (1 + 0 + 2 + 3 + 4) / 50
    assert warm_mean(measured, 10_000, runs=2).first().thp == 0.1
    assert warm_mean(measured, 10_000, runs=60).first().thp == (1 + 0 + 2 + 3 + 4 + 9) / 60
    few = fixed_time(at(spark, [0, 1, 2, 20, 21]), "ts", 10_000)
    assert warm_mean(few, 10_000).first().thp == 2 / 20
    assert warm_mean(few.limit(0), 10_000).first().thp is None
    assert warm_mean(few.where("n = 3"), 10_000).first().thp is None


def test_after_fill(spark):
    got = after_fill(at(spark, [0, 1, 2, 3, 20, 21]), "ts", "i", 2, 2).first()
    assert (got.start, got.end, got.thp) == (START + timedelta(seconds=1), START + timedelta(seconds=3), 1.0)


def test_after_fill_past_the_end(spark):
    got = after_fill(at(spark, [0, 1, 2]), "ts", "i", 2, 5).first()
    assert got.end is None and got.thp is None


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_micros_between(spark, kind):
    df = spark.sql(
        f"select cast('2024-01-01 00:00:00.000001' as {kind}) a, cast('2025-03-02 04:05:06.7' as {kind}) b"
    )
    span = datetime(2025, 3, 2, 4, 5, 6, 700000) - datetime(2024, 1, 1, 0, 0, 0, 1)
    want = span // timedelta(microseconds=1)
    assert df.select(micros_between("a", "b"), micros_between("b", "a")).first() == (want, -want)


def test_rate_of_no_time(spark):
    assert spark.range(1).select(rate(F.lit(5), F.lit(0.0))).first()[0] is None


def test_bad_arguments(spark):
    df = at(spark, [0])
    for call in (
        lambda: fixed_time(df, "ts", 0),
        lambda: until_idle(df, "ts", 0),
        lambda: after_fill(df, "ts", "i", 0, 1),
        lambda: warm_mean(df, 10, runs=1),
    ):
        with pytest.raises(ValueError):
            call()
