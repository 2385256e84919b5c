import os
import random
import subprocess
import sys
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from panewise.operators import count_window as windows
from panewise.operators import counter, histogram, throughput
from panewise.plans import jobs
from panewise.sources import io
from panewise.sources.generate import word_stream
from panewise.streaming import log_state as log_state_module
from panewise.streaming import microbatch, stateful
from panewise.streaming.log_state import GONE, LogState
from panewise.streaming.run import run_to_end, timed_write
from panewise.streaming.state import IN_MEMORY, ROCKSDB, counter_table, session_settings, state_profile

FILES = 4
HOT = 50


@pytest.fixture(scope="module")
def events(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/events.parquet")
    rows = rows.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    # A key with a third of all rows.
    return rows.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")))


def add_file(events, folder, i):
    """File i of the event order, older than file i + 1."""
    part = f"{folder}-part{i}"
    share = events.count() // FILES
    bounds = (F.col("event_id") >= i * share) & (F.col("event_id") < (i + 1) * share)
    events.where(bounds).coalesce(1).write.parquet(part)
    (name,) = [n for n in os.listdir(part) if n.endswith(".parquet")]
    os.makedirs(folder, exist_ok=True)
    os.link(f"{part}/{name}", f"{folder}/{i}.parquet")
    os.utime(f"{folder}/{i}.parquet", (1_700_000_000 + i * 10,) * 2)


@pytest.fixture(scope="module")
def folder(events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    for i in range(FILES):
        add_file(events, path, i)
    return path


def stream(spark, events, folder):
    return (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    )


def same(got, want):
    want = want.select(got.columns)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def written(spark, rows, tmp_path, **options):
    out = str(tmp_path / "out")
    writer = io.sink(rows, "parquet", str(tmp_path / "checkpoint"), path=out)
    measure = run_to_end(spark, writer, **options).first()
    return spark.read.schema(rows.schema).parquet(out), measure


def test_state_counter(spark, events, folder, tmp_path):
    rows = stateful.running_counter(stream(spark, events, folder), "user_id", "event_type", "event_id")
    got, measure = written(spark, rows, tmp_path, given=500)
    same(got, counter.running_counter(events, "user_id", "event_id", "event_type"))
    assert measure.rows == events.count() and measure.batches == FILES
    assert measure.thp == pytest.approx(500 / measure.seconds)
    assert measure.state_rows == events.select("user_id").distinct().count()


def test_state_count_window(spark, events, folder, tmp_path):
    rows = stateful.count_window_counts(stream(spark, events, folder), "user_id", 10, 3)
    got, _ = written(spark, rows, tmp_path, block_cache_mb=0, write_buffer_mb=16)
    same(got, windows.count_window_counts(events, ["user_id"], 10, 3))


@pytest.mark.parametrize("how,size,slide", [("sum", 10, 3), ("max", 1, 2), ("min", 40, 1)])
def test_state_reduce(spark, events, folder, tmp_path, how, size, slide):
    rows = stateful.count_window_reduce(
        stream(spark, events, folder), "user_id", "cents", how, size, slide, "event_id"
    )
    got, _ = written(spark, rows, tmp_path)
    same(got, windows.count_window_reduce(events, ["user_id"], "event_id", "cents", how, size, slide))


def test_final_state(spark, events, folder, tmp_path):
    for profile in ("mem", "rocksdb"):
        state = stateful.final_state(stream(spark, events, folder), "user_id", "event_id", "event_type")
        out = str(tmp_path / profile)
        run_to_end(spark, microbatch.replace_table(state, out, out + "-checkpoint"), profile)
        same(microbatch.read_result(spark, out), counter.final_state(events, "user_id", "event_id", "event_type"))


def counter_writer(spark, events, folder, tmp_path):
    return microbatch.running_counter(
        stream(spark, events, folder), "user_id", "event_id", "event_type",
        str(tmp_path / "out"), str(tmp_path / "checkpoint"), HOT,
    )


def test_microbatch_counter(spark, events, folder, tmp_path):
    measure = run_to_end(spark, counter_writer(spark, events, folder, tmp_path)).first()
    same(
        microbatch.read_output(spark, str(tmp_path / "out")),
        counter.running_counter(events, "user_id", "event_id", "event_type"),
    )
    assert measure.rows == events.count()


def test_restart_goes_on_from_the_checkpoint(spark, events, tmp_path):
    folder = str(tmp_path / "in")
    (tmp_path / "state").mkdir()
    for half in ((0, 1), (2, 3)):
        for i in half:
            add_file(events, folder, i)
        run_to_end(spark, counter_writer(spark, events, folder, tmp_path))
        rows = stateful.running_counter(stream(spark, events, folder), "user_id", "event_type", "event_id")
        got, _ = written(spark, rows, tmp_path / "state")
        seen = events.where(F.col("event_id") < (half[1] + 1) * (events.count() // FILES))
        want = counter.running_counter(seen, "user_id", "event_id", "event_type")
        same(microbatch.read_output(spark, str(tmp_path / "out")), want)
        same(got, want)


def test_failed_batch_is_run_again_from_the_same_state(spark, events, folder, tmp_path, monkeypatch):
    """Fail after the output and the run of the third batch are written but before its manifest is."""
    real, calls = LogState._commit, []

    def failing(self, batch_id, *rest):
        calls.append(batch_id)
        if calls.count(2) == 1 and batch_id == 2:
            raise RuntimeError("lost")
        return real(self, batch_id, *rest)

    monkeypatch.setattr(LogState, "_commit", failing)
    with pytest.raises(Exception, match="lost"):
        run_to_end(spark, counter_writer(spark, events, folder, tmp_path))
    run_to_end(spark, counter_writer(spark, events, folder, tmp_path))
    same(
        microbatch.read_output(spark, str(tmp_path / "out")),
        counter.running_counter(events, "user_id", "event_id", "event_type"),
    )


# The log of states -----------------------------------------------------------------------------------


def log_state(spark, tmp_path, **options):
    schema = spark.createDataFrame([], "k bigint, n bigint").schema
    return LogState(spark, str(tmp_path), "s", schema, "k", **options)


def pairs(rows):
    return {} if rows is None else {r.k: r.n for r in rows.collect()}


@pytest.mark.parametrize("bucket_rows", [5, 1 << 20])
def test_state_is_that_of_a_dictionary(spark, tmp_path, monkeypatch, bucket_rows):
    """Many batches with changes, keys that go and come again, null keys, and batches that are run twice."""
    monkeypatch.setattr(log_state_module, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(log_state_module, "LEVEL_ROWS", 4)
    r, held, state = random.Random(2), {}, log_state(spark, tmp_path)
    for batch in range(18):
        changed = {r.choice([None, *range(40)]): r.randrange(1000) for _ in range(r.randrange(0, 12))}
        gone = {k: r.random() < 0.2 for k in changed}
        rows = spark.createDataFrame([(k, n, gone[k]) for k, n in changed.items()], f"k bigint, n bigint, {GONE} boolean")
        asked = spark.createDataFrame([(k,) for k in [None, *range(0, 40, 3)]], "k bigint")
        want = {k: n for k, n in held.items() if k in (None, *range(0, 40, 3))}
        assert pairs(state.read(batch, asked)) == want and pairs(state.read(batch)) == held
        for _ in range(1 + batch % 2):
            assert state.write(rows, batch, {"batch": batch}).count() == len(changed)
        held = {k: n for k, n in (held | changed).items() if not gone.get(k)}
        assert state.note(batch) == {"batch": batch}
    assert len(state.runs(17)) < 14 and any(x.level >= 2 for x in state.runs(17))
    assert any(x.buckets > 1 for x in state.runs(17)) == (bucket_rows == 5)
    # What no manifest leads to any more is gone: the runs there are belong to this one or the one before.
    named = {x.name for x in [*state.runs(17), *state.runs(16)]}
    assert {n for n in os.listdir(tmp_path / "tables" / "s") if n.startswith("run-")} == named
    assert sorted(n for n in os.listdir(tmp_path / "tables" / "s" / "manifest") if n.endswith(".json")) == ["16.json", "17.json"]


def test_bytes_written_follow_the_batch(spark, tmp_path):
    """A batch of a few keys beside a state of many writes a few rows."""
    state = log_state(spark, tmp_path)
    state.write(spark.range(200_000).selectExpr("id k", "1L n"), 0)
    folder = tmp_path / "tables" / "s"

    def size(name):
        return sum(f.stat().st_size for f in (folder / name).rglob("*.parquet"))

    for batch in range(1, 7):
        state.write(spark.range(50).selectExpr("id k", f"{batch}L n"), batch)
        assert size(f"run-{batch}") * 100 < size("run-0")
        few = batch if batch < 4 else batch - 3  # the large run is left alone when small ones are merged
        assert [x.rows for x in state.runs(batch)] == [200_000] + [50] * few and state.runs(batch)[0].name == "run-0"
    assert pairs(state.read(7, spark.range(49, 51).toDF("k"))) == {49: 6, 50: 1}


def test_combined_rows_and_rows_that_are_passed(spark, tmp_path):
    state = log_state(spark, tmp_path, combine=lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")))
    for batch in range(4):
        state.write(spark.createDataFrame([(1, 1), (batch, 10)], "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")), batch, keep=F.col("k") > 0)
    assert pairs(state.read(4)) == {1: 14, 2: 10, 3: 10}


# The whole stream ------------------------------------------------------------------------------------


@pytest.mark.parametrize("size,slide", [(100, 50), (7, 30), (200, 12), (60, 7), (400, 400)])
def test_stream_pane_histogram(spark, events, folder, tmp_path, size, slide):
    out = str(tmp_path / "out")
    run_to_end(
        spark,
        microbatch.pane_histogram(
            stream(spark, events, folder), "event_type", "event_id", size, slide, out, str(tmp_path / "checkpoint")
        ),
    )
    same(microbatch.read_output(spark, out), histogram.stream_histogram(events, "event_type", "event_id", size, slide))


@pytest.mark.parametrize("fill,count", [(1, 1), (100, 500), (300, 100), (249, 1)])
def test_stream_after_fill(spark, events, folder, tmp_path, fill, count):
    out = str(tmp_path / "out")
    writer = microbatch.after_fill(
        stream(spark, events, folder), "ts", "event_id", fill, count, out, str(tmp_path / "checkpoint")
    )
    run_to_end(spark, writer)
    same(microbatch.read_output(spark, out), throughput.after_fill(events, "ts", "event_id", fill, count))


def test_state_as_a_table(spark, events, folder, tmp_path):
    """After the last batch, and after an earlier one, without the stream."""
    rows = stateful.running_counter(stream(spark, events, folder), "user_id", "event_type", "event_id")
    written(spark, rows, tmp_path)
    checkpoint = str(tmp_path / "checkpoint")
    same(counter_table(spark, checkpoint, "user_id", "event_type"), counter.final_state(events, "user_id", "event_id", "event_type"))
    early = events.where(F.col("event_id") < events.count() // FILES)
    same(
        counter_table(spark, checkpoint, "user_id", "event_type", batch_id=0),
        counter.final_state(early, "user_id", "event_id", "event_type"),
    )


def test_microbatch_decimals(spark, events, folder, tmp_path):
    """Sums of decimals keep one type over many batches."""
    money = F.col("cents").cast("decimal(10,2)")
    out = str(tmp_path / "out")
    writer = microbatch.count_window_reduce(
        stream(spark, events, folder).withColumn("cents", money), "user_id", "event_id", "cents", "sum", 40, 3,
        out, str(tmp_path / "checkpoint"),
    )
    run_to_end(spark, writer)
    want = windows.count_window_reduce(events.withColumn("cents", money), ["user_id"], "event_id", "cents", "sum", 40, 3)
    got = microbatch.read_output(spark, out)
    assert got.schema["sum"].dataType == want.schema["sum"].dataType
    same(got, want)


@pytest.mark.parametrize("how", ["sum", "min", "max", "count"])
def test_state_reduce_with_nulls(spark, events, folder, tmp_path, how):
    """Nulls are left out; large values stay exact."""
    value = F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("cents") + (1 << 53))
    value = F.when(F.col("user_id") == 1, None).otherwise(value)
    rows = stateful.count_window_reduce(
        stream(spark, events, folder).withColumn("cents", value), "user_id", "cents", how, 3, 2, "event_id"
    )
    got, _ = written(spark, rows, tmp_path)
    batch = events.withColumn("cents", value)
    same(got, windows.count_window_reduce(batch, ["user_id"], "event_id", "cents", how, 3, 2))


def test_state_order_over_arrow_batches(spark, tmp_path, monkeypatch):
    """One key with more rows in one micro-batch than an Arrow batch or a sorted run has, in falling order."""
    monkeypatch.setattr(stateful, "RUN_ROWS", 12_000)
    n = 25_000
    rows = spark.range(n).select(
        F.lit(1).cast("bigint").alias("k"), (n - F.col("id")).alias("o"),
        F.when(F.col("id") % 11 != 0, (n - F.col("id")).cast("string")).alias("p"), (F.col("id") % 97).alias("v"),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    (tmp_path / "counter").mkdir()
    got, _ = written(spark, stateful.running_counter(source, "k", "p", "o"), tmp_path / "counter")
    same(got, counter.running_counter(rows, "k", "o", "p"))
    panes, _ = written(spark, stateful.count_window_reduce(source, "k", "v", "sum", 10, 3, "o"), tmp_path)
    same(panes, windows.count_window_reduce(rows, ["k"], "o", "v", "sum", 10, 3))


@pytest.mark.parametrize("how,size,slide", [("sum", 10, 3), ("count", 3, 10), ("max", 25, 25)])
def test_microbatch_reduce(spark, events, folder, tmp_path, how, size, slide):
    out = str(tmp_path / "out")
    writer = microbatch.count_window_reduce(
        stream(spark, events, folder), "user_id", "event_id", "cents", how, size, slide,
        out, str(tmp_path / "checkpoint"), hot_rows=HOT,
    )
    run_to_end(spark, writer)
    want = windows.count_window_reduce(events, ["user_id"], "event_id", "cents", how, size, slide)
    same(microbatch.read_output(spark, out), want)


@pytest.mark.parametrize("size,slide", [(10, 3), (3, 10)])
def test_microbatch_counts(spark, events, folder, tmp_path, size, slide):
    out = str(tmp_path / "out")
    writer = microbatch.count_window_counts(
        stream(spark, events, folder), "user_id", size, slide, out, str(tmp_path / "checkpoint")
    )
    run_to_end(spark, writer)
    want = windows.count_window_counts(events, ["user_id"], size, slide)
    same(microbatch.read_output(spark, out), want)


def timed(spark, events, folder):
    utc = F.col("ts").cast("timestamp")
    return stream(spark, events, folder).withColumn("ts", utc).withWatermark("ts", "1 hour")


def test_stream_throughput(spark, events, folder, tmp_path):
    rates = throughput.fixed_time(timed(spark, events, folder), "ts", 3_600_000)
    out = str(tmp_path / "out")
    run_to_end(spark, microbatch.replace_table(rates, out, str(tmp_path / "checkpoint")))
    plain = events.withColumn("ts", F.col("ts").cast("timestamp"))
    same(microbatch.read_result(spark, out), throughput.fixed_time(plain, "ts", 3_600_000))


def test_stream_until_idle(spark, events, folder, tmp_path):
    sessions = throughput.until_idle_stream(timed(spark, events, folder), "ts", "event_type", 3_600_000)
    out = str(tmp_path / "out")  # in complete mode, so that open sessions are there too
    run_to_end(spark, microbatch.replace_table(sessions, out, str(tmp_path / "checkpoint")))
    plain = events.withColumn("ts", F.col("ts").cast("timestamp"))
    same(microbatch.read_result(spark, out), throughput.until_idle(plain, "ts", 3_600_000, by=["event_type"]))


def test_jobs_on_text(spark, events, tmp_path):
    lines = events.select(F.concat_ws(" ", "user_id", "event_type").alias("value"))
    path = str(tmp_path / "lines")
    io.write_lines(lines.coalesce(1), path)
    batch = io.read_lines(spark, path, order="seq")

    def run(rows, name):
        (tmp_path / name).mkdir()
        return written(spark, rows, tmp_path / name)[0]

    got = run(jobs.stream_window_word_count(io.stream_lines(spark, path), 10, 3, word="click"), "window")
    same(got, jobs.window_word_count(batch, 10, 3, word="click"))
    got = run(jobs.stream_keyed_counter(io.stream_lines(spark, path), key=0), "counter")
    want = jobs.keyed_counter(batch, "seq", key=0)
    assert got.count() == want.count() == events.where("user_id = 0").count()
    strict = run(jobs.stream_keyed_counter(io.stream_lines(spark, path), strict=True), "strict")
    assert strict.count() == jobs.keyed_counter(batch, "seq", strict=True).count() == 0


def test_rate_stream(spark, tmp_path):
    words = word_stream(spark, 100, 3, 20, 1.0)
    query = (
        io.sink(words, "memory", str(tmp_path / "checkpoint"), queryName="rate_words")
        .trigger(processingTime="1 second").start()
    )
    deadline = time.monotonic() + 60
    while time.monotonic() < deadline and spark.table("rate_words").count() < 198:
        time.sleep(0.5)
    query.stop()
    got = spark.table("rate_words")
    per_tick = {r["count"] for r in got.groupBy("timestamp").count().collect()}
    assert per_tick == {99}
    assert got.where("value is null").count() == 0


def test_profiles(spark):
    assert set(state_profile("mem").values()) == {IN_MEMORY} == set(state_profile("file").values())
    for name in ("rocksdb", "rocksdb_nvme", "rocksdb_sata"):
        assert ROCKSDB in state_profile(name).values()
    sized = state_profile("rocksdb", block_cache_mb=2048, write_buffer_mb=128)
    assert sized["spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB"] == "2048"
    assert sized["spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB"] == "128"
    with pytest.raises(ValueError):
        state_profile("disk")


def test_settings_are_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with pytest.raises(RuntimeError), session_settings(spark, {name: ROCKSDB}):
        assert spark.conf.get(name) == ROCKSDB
        raise RuntimeError
    assert spark.conf.get(name, None) == before


def test_timed_write(spark, tmp_path):
    rows = spark.range(1000)
    got = timed_write(spark, 1000, lambda: rows.write.parquet(str(tmp_path / "out"))).first()
    assert got.rows == 1000 and got.thp == pytest.approx(1000 / got.seconds)


def test_workers_need_not_have_the_package(tmp_path):
    """A driver that found the package by `sys.path` alone, started from another folder."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "driver.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {repo!r})\n"
        "from panewise.session import local_session\n"
        "from panewise.plans.registry import QUERIES\n"
        "spark = local_session(2, memory='2g')\n"
        "for name in ('stream_count_window', 'stream_running_counter_state'):\n"
        f"    print(name, QUERIES[name].run(spark, {TESTDATA + '/sf0.001'!r}).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "stream_running_counter_state 1000" in done.stdout, done.stderr[-2000:]


def test_few_rows_of_a_key_are_sorted_without_a_folder(monkeypatch):
    def refuse(*args, **options):
        raise AssertionError("a folder")

    monkeypatch.setattr(stateful.tempfile, "TemporaryDirectory", refuse)
    frame = lambda *o: pd.DataFrame({"o": o, "p": [f"{i}" for i in range(len(o))]})
    for batches in ([frame(1, 2, 2, 5)], [frame(3, 1, 3)], [frame(4, 6), frame(5, 1, 6)], [frame(2, None, 1)]):
        want = pd.concat(batches).sort_values("o", kind="stable")
        (got,) = stateful.in_order(iter(batches), "o")
        assert list(got["p"]) == list(want["p"])
    assert list(stateful.in_order(iter([]), "o")) == []
