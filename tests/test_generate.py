import bisect
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panewise.functions.draws import below, hash_draw, letters, md5_draw
from panewise.functions import permute
from panewise.operators import zipf, zipf_sampling
from panewise.operators.zipf import draw_words, weight_scale, zipf_cdf, zipf_ranks
from panewise.sources import generate
from panewise.sources.generate import key_payload_lines, key_payloads, word_stream, zipf_words


@pytest.mark.parametrize("words,skew", [(1, 1.0), (2, 0.0), (500, 1.0), (3000, 0.7), (1000, 3.5)])
def test_intervals_tile_the_whole_range(spark, words, skew):
    cdf = zipf_cdf(spark, words, skew, seed=4).orderBy("rank").collect()
    assert [r["rank"] for r in cdf] == list(range(1, words + 1))
    assert cdf[0].lo == 0 and all(a.hi == b.lo for a, b in zip(cdf, cdf[1:]))
    assert cdf[-1].hi < 1 << 52
    assert sorted(int(r.word) for r in cdf) == list(range(1, words + 1))
    total, norm = cdf[-1].hi, sum(i**-skew for i in range(1, words + 1))
    for r in cdf[:20]:
        assert (r.hi - r.lo) / total == pytest.approx(r["rank"] ** -skew / norm, rel=1e-6)


def test_weights_stay_exact_for_the_largest_tables():
    for words in (1, 10, 10**6, 2**31 - 2):
        for skew in (0.0, 0.5, 1.0, 2.0):
            assert 1 <= weight_scale(words, skew) <= 1 << 51


def test_running_sum_is_cut_into_chunks(spark, monkeypatch):
    whole = zipf_cdf(spark, 300, 1.2)
    monkeypatch.setattr(zipf, "UPPER_BITS", 3)
    cut = zipf_cdf(spark, 300, 1.2)
    assert whole.exceptAll(cut).count() == 0


def test_every_row_gets_one_word(spark):
    ids = spark.range(20_000)
    drawn = draw_words(ids, "id", 5000, 0.9, seed=1)
    assert drawn.count() == 20_000 and drawn.select("id").distinct().count() == 20_000


@pytest.mark.parametrize("words", [3, 1000])
def test_same_table_for_any_partitioning_and_join(spark, words, monkeypatch):
    def table(partitions):
        return draw_words(spark.range(0, 5000, 1, partitions), "id", words, 1.0, seed=9)

    one = table(1)
    assert one.exceptAll(table(16)).count() == 0
    monkeypatch.setattr(zipf, "BROADCAST_WORDS", 0)
    merged = table(4)
    assert "SortMergeJoin" in merged._jdf.queryExecution().toString()
    assert one.exceptAll(merged).count() == 0
    assert one.exceptAll(draw_words(spark.range(5000), "id", words, 1.0, seed=10)).count() > 0


def test_frequencies(spark):
    n, words, skew = 200_000, 1000, 1.0
    counts = {
        r["rank"]: r["count"]
        for r in draw_words(spark.range(n), "id", words, skew).groupBy("rank").count().collect()
    }
    norm = sum(i**-skew for i in range(1, words + 1))
    for rank in (1, 2, 3, 10, 50):
        expected = n * rank**-skew / norm
        assert abs(counts[rank] - expected) < 5 * expected**0.5


def test_extreme_draws(spark):
    ends = spark.createDataFrame([(0, 0.0), (1, 1.0 - 2**-53)], "id bigint, u double")
    drawn = draw_words(ends, "id", 100, 1.0, draw=lambda id_, seed: F.col("u")).collect()
    assert {r.id: r["rank"] for r in drawn} == {0: 1, 1: 100}


def test_zipf_words(spark):
    words = zipf_words(spark, 1000, 10, 1.0)
    assert words.columns == ["value"] and words.count() == 1000
    assert {int(r.value) for r in words.distinct().collect()} <= set(range(1, 11))


@pytest.mark.parametrize("skew", [-1.0, float("nan"), float("inf")])
def test_bad_skew(spark, skew):
    with pytest.raises(ValueError):
        zipf_ranks(spark, 10, skew)


def test_bad_words(spark):
    for words in (0, (1 << 50) + 1):
        with pytest.raises(ValueError):
            zipf_ranks(spark, words, 1.0)


def test_rare_ranks_have_a_weight(spark):
    ranks = spark.createDataFrame([(1,), (24_000_000,), (99_999_999,)], "rank bigint")
    got = zipf.zipf_weights(ranks, "rank", 2.0, weight_scale(10**8, 2.0)).collect()
    assert [r.weight >= 1 for r in got] == [True] * 3 and got[0].weight > 1 << 48


@pytest.mark.parametrize("words", [7, (1 << 31) - 1, (1 << 40) + 3])
def test_words_of_many_ranks(spark, words):
    some = sorted({1, 2, 3, words // 2, words - 1, words})
    ranks = spark.createDataFrame([(r,) for r in some], "rank bigint")
    got = [int(r.word) for r in ranks.select(zipf.word_of_rank("rank", words, 5)).collect()]
    assert len(set(got)) == len(some) and all(1 <= w <= words for w in got)
    prime = (1 << 31) - 1 if words < (1 << 31) - 1 else (1 << 61) - 1
    assert got == [(r * pow(prime, 6, words) + 5 % words) % words + 1 for r in some]


def test_long_payloads_are_made_in_place(spark, monkeypatch):
    short = key_payloads(spark.range(500), "id", 10, 5)
    monkeypatch.setattr(generate, "BROADCAST_POOL_BYTES", 0)
    long = key_payloads(spark.range(500), "id", 10, 5)
    assert "Join" not in long._jdf.queryExecution().optimizedPlan().toString()
    assert short.exceptAll(long).count() == 0


def test_key_payload_lines(spark):
    lines = key_payload_lines(spark, 20_000, 50, 8, seed=3)
    assert lines.where(F.col("value").rlike(r"^\d+ [a-z]{8}$")).count() == 20_000
    keys = lines.select(F.split("value", " ")[0].cast("int").alias("k")).groupBy("k").count().collect()
    assert sorted(r.k for r in keys) == list(range(50))
    assert all(abs(r["count"] - 400) < 5 * 20 for r in keys)
    assert lines.select(F.split("value", " ")[1]).distinct().count() == 1000


def test_key_payloads_do_not_depend_on_partitions(spark):
    one = key_payloads(spark.range(0, 3000, 1, 1), "id", 10, 5)
    many = key_payloads(spark.range(0, 3000, 1, 16), "id", 10, 5)
    assert one.exceptAll(many).count() == 0


def test_empty_payload(spark):
    assert key_payload_lines(spark, 3, 1, 0).collect() == [("0 ",)] * 3


def test_draws_are_uniform(spark):
    for draw in (hash_draw, md5_draw):
        got = spark.range(100_000).select(below(draw(F.col("id"), 1), 10).alias("d")).groupBy("d").count()
        counts = {r.d: r["count"] for r in got.collect()}
        assert sorted(counts) == list(range(10))
        assert all(abs(c - 10_000) < 500 for c in counts.values())
    used = spark.range(2000).select(F.explode(F.split(letters(F.col("id"), 3, 1), "")).alias("c"))
    assert sorted(r.c for r in used.where("c <> ''").distinct().collect()) == [chr(97 + i) for i in range(26)]


def test_word_stream_shares_the_rate(spark):
    stream = word_stream(spark, 10, 3, 5, 1.0)
    assert stream.isStreaming and stream.columns == ["timestamp", "value"]
    with pytest.raises(ValueError):
        word_stream(spark, 2, 3, 5, 1.0)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 100, 1001, 4096])
@pytest.mark.parametrize("noise", [permute.hash_noise, permute.md5_noise])
def test_a_random_order_uses_every_place_once(spark, n, noise):
    got = [r[0] for r in spark.range(n).select(permute.permuted(F.col("id"), n, 3, noise)).collect()]
    assert sorted(got) == list(range(n))
    if n > 90:
        other = [r[0] for r in spark.range(n).select(permute.permuted(F.col("id"), n, 4, noise)).collect()]
        assert sum(a == b for a, b in zip(got, other)) < n // 8
        # No step between neighbours is common, as it is in an affine order.
        steps = Counter((b - a) % n for a, b in zip(got, got[1:]))
        assert max(steps.values()) < 8 + n // 100


def test_a_random_order_of_very_many(spark):
    n = (1 << 50) + 7
    got = spark.range(n - 500, n).select(permute.permuted(F.col("id"), n).alias("p"))
    places = [r.p for r in got.collect()]
    assert len(set(places)) == 500 and 0 <= min(places) < n // 20 and max(places) < n and max(places) > n - n // 20


@pytest.mark.parametrize("words,skew", [(1, 1.0), (7, 0.0), (7, 3.0), (1000, 0.5), (1000, 1.0), (10**9, 0.0), (10**9, 1.0), (10**9, 1.2)])
def test_sampled_ranks_have_zipf_chances(spark, skew, words):
    """Chi-square over ranks 1 to 20 and powers of four beyond, against exact chances."""
    n = 40_000
    edges = sorted({*range(1, min(words, 20) + 1), *(min(words, 4**i) for i in range(3, 16)), words})
    rows = spark.range(n).select(zipf_sampling.sampled_rank(F.col("id"), words, skew, 5).alias("rank"))
    counts = Counter()
    for r in rows.groupBy("rank").count().collect():
        assert 1 <= r.rank <= words
        counts[bisect.bisect_left(edges, r.rank)] += r["count"]

    def mass(first, last):
        """The sum of k^-skew, its middle by the integral with midpoints, which is exact to 1e-9 there."""
        near = sum(k**-skew for k in range(first, min(last, 5000) + 1))
        if last <= 5000:
            return near
        start = max(first, 5001)
        return near + zipf_sampling.area(last + 0.5, skew) - zipf_sampling.area(start - 0.5, skew)

    masses = [mass(a + 1, b) for a, b in zip([0, *edges], edges)]
    square, freedom = 0.0, -1
    for i, m in enumerate(masses):
        expected = n * m / sum(masses)
        if expected >= 5:
            square, freedom = square + (counts[i] - expected) ** 2 / expected, freedom + 1
    assert square <= freedom + 4.5 * (2 * max(freedom, 1)) ** 0.5 + 8
    again = spark.range(n).repartition(7).select(zipf_sampling.sampled_rank(F.col("id"), words, skew, 5).alias("rank"))
    assert rows.exceptAll(again).count() == 0


def test_sampled_words_of_a_stream(spark, tmp_path):
    spark.range(500).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    query = zipf_sampling.sample_words(source, "id", 10**9, 1.1).writeStream.format("memory").queryName("sampled")
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.table("sampled")
    assert got.count() == 500 and got.exceptAll(zipf_sampling.sample_words(spark.range(500), "id", 10**9, 1.1)).count() == 0
    with pytest.raises(ValueError):
        zipf_sampling.sampled_rank(F.lit(1), 1 << 52, 1.0)
