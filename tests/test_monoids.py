"""Long panes through partial states against frames over the rows themselves."""

import random

import pytest
from pyspark.sql import Window, functions as F

from panewise.operators import monoids
from panewise.operators.count_window import count_window

def all_aggs():
    return {
        "count": F.count(F.lit(1)), "counted": F.count("v"), "sum": F.sum("v"), "avg": F.avg("v"), "mean": F.mean("d"),
        "min": F.min("v"), "max": F.max("d"), "and": F.bool_and(F.col("v") > 1), "or": F.bool_or(F.col("v") > 7),
        "bits": F.bit_or("v"), "bits_and": F.bit_and("v"), "bits_xor": F.bit_xor("v"), "some": F.count_if(F.col("v") > 3),
        "var_pop": F.var_pop("v"), "var_samp": F.var_samp("f"), "std": F.stddev("v"), "std_pop": F.stddev_pop("f"),
        "oldest": F.min_by("s", "n"), "newest": F.max_by("s", "n"), "best": F.max_by("s", "o"),
    }


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(8)
    values = [
        (r.choice(["x"] * 6 + ["y", "z", None]), o, r.choice([None, *range(9)]), 1e9 + r.random(), f"s{r.randrange(50)}")
        for o in range(1500)
    ]
    df = spark.createDataFrame(values, "k string, o bigint, v bigint, f double, s string").repartition(3)
    return df.withColumn("d", F.col("v").cast("decimal(10,2)")).cache()


@pytest.mark.parametrize("size,slide", [(40, 1), (64, 3), (300, 7), (2000, 11)])
@pytest.mark.parametrize("hot", [None, 40])
def test_any_monoid_against_a_frame(rows, size, slide, hot):
    made = all_aggs()
    aggs = [a.alias(name) for name, a in made.items()]
    got = count_window(rows, ["k"], "o", size, slide, aggs, hot, bits=(5, 4))
    assert "rowsbetween" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    frame = Window.partitionBy("k").orderBy("n").rowsBetween(1 - size, 0)
    want = numbered.select("k", "n", *[a.over(frame).alias(name) for name, a in made.items()]).where(F.col("n") % slide == 0)
    types = {f.name: f.dataType for f in numbered.groupBy("k").agg(*aggs).schema}
    assert {f.name: f.dataType for f in got.schema if f.name in made} == {name: types[name] for name in made}
    left = {(x.k, x.n): x.asDict() for x in got.collect()}
    right = {(x.k, x.n): x.asDict() for x in want.collect()}
    assert left.keys() == right.keys()
    for place, values in right.items():
        for name, value in values.items():
            same = pytest.approx(value, rel=1e-9, abs=1e-6) if isinstance(value, float) else value
            assert left[place][name] == same, (place, name)


def test_kinds_of_aggregates(spark):
    known = lambda a: monoids.of(monoids.read(a))
    assert all(known(a) is not None for a in all_aggs().values())
    assert known(F.collect_list("v")) is None and monoids.read(F.collect_list("v")).name == "collect_list"
    assert known(F.count_distinct("v")) is None and monoids.read(F.sum_distinct("v")).distinct
    assert monoids.read(F.sum("v") + 1).name is None
    assert known((F.sum("v") / 2).alias("half")) is None and known(F.sum("v").alias("named")) is not None


def test_what_is_no_monoid_has_the_same_panes(rows):
    aggs = [F.sum("v").alias("total"), (F.sum("v") + 1).alias("more"), F.count_distinct("v").alias("kinds")]
    got = count_window(rows, ["k"], "o", 40, 2, aggs)
    plain = count_window(rows, ["k"], "o", 40, 2, aggs[:1])
    assert got.select("k", "n", "total").exceptAll(plain).count() == 0 and got.count() == plain.count()
    assert got.where("more <> total + 1 or kinds > 9").count() == 0


def test_an_unknown_column_is_told(rows):
    with pytest.raises(Exception, match="nowhere"):
        count_window(rows, ["k"], "o", 40, 2, [F.avg("nowhere")]).collect()
