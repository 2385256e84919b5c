import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from panewise.sources import io


def test_lines_go_out_and_come_back(spark, tmp_path):
    path = str(tmp_path / "lines")
    old = spark.createDataFrame([(str(i),) for i in range(100)], "value string")
    io.write_lines(old, path)
    io.write_lines(spark.range(3).withColumn("n", F.col("id") * 2), path, "n")
    assert sorted(r.value for r in io.read_lines(spark, path).collect()) == ["0", "2", "4"]


def test_carriage_returns_and_other_line_ends(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_bytes(b"a\r\n\r\nb\rc\r\r\n d \n\nlast")
    got = io.read_lines(spark, str(path), order="seq").orderBy("seq").collect()
    assert [r.value for r in got] == ["a", "", "b\rc\r", " d ", "", "last"]


def test_order_follows_a_file(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("".join(f"{i}\n" for i in range(5000)))
    got = io.read_lines(spark, str(path), order="seq").orderBy("seq").collect()
    assert [int(r.value) for r in got] == list(range(5000))


def test_written_rows_keep_their_order_column(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("".join(f"{i}\n" for i in range(100)))
    rows = io.written(io.read_lines(spark, str(path), order="seq"))
    assert [int(r.value) for r in rows.orderBy("seq").collect()] == list(range(100))


def test_order_follows_files_of_any_size(spark, tmp_path):
    sizes = {"a.txt": 2, "b.txt": 4000, "c.txt": 1, "d.txt": 300}
    want = []
    for name, n in sizes.items():
        lines = [f"{name} {i}" for i in range(n)]
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
        want += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = io.read_lines(spark, str(tmp_path), order="seq").orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.value for r in got] == want and [r.seq for r in got] == list(range(len(want)))


def test_table_columns(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(10).withColumn("x", F.lit(1)).write.parquet(path)
    assert io.read_table(spark, path, "id").columns == ["id"]
    assert io.read_table(spark, path).columns == ["id", "x"]


def test_messages_are_text(spark):
    raw = spark.createDataFrame([(None, b"a"), (b"k", b"b")], "key binary, value binary")
    raw = raw.withColumn("offset", F.lit(1))
    assert [tuple(r) for r in io.messages(raw).collect()] == [(None, "a", 1), ("k", "b", 1)]


def test_message_options():
    options = io.message_options("host:1", "word", **{"kafka.acks": "1"})
    assert options["kafka.bootstrap.servers"] == "host:1" and options["topic"] == "word"
    assert options["kafka.acks"] == "1" and options["kafka.linger.ms"] == "1"


def test_connector_is_asked_for(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        io.stream_messages(spark, "host:1")
    with pytest.raises(Exception, match="(?i)kafka"):
        io.write_messages(spark.createDataFrame([("a",)], "value string"), "host:1")


def test_metric(spark, tmp_path):
    path = str(tmp_path / "thp")
    for thp in (1.5, 1234.5):
        metric = spark.createDataFrame([(thp, 1)], "thp double, n bigint")
        io.write_metric(metric, path)
        io.append_metric(metric, str(tmp_path / "history"))
    assert [r.value for r in spark.read.text(path).collect()] == ["1234.5"]
    assert io.read_metric(spark, path).first().thp == 1234.5
    assert spark.read.parquet(str(tmp_path / "history")).count() == 2


def test_shared_working_folders_go_with_the_driver(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
from panewise.sources.io import written
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config(
    "spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
rows = written(spark.range(5), "kept")
import os
print("rows", rows.count(), "there", sum(n.startswith("kept-") for n in os.listdir({str(tmp_path)!r})))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "rows 5 there 1" in done.stdout, done.stderr[-500:]
    assert not [n for n in os.listdir(tmp_path) if n.startswith("kept-")]
