"""Text files, message topics and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import DataStreamWriter

from panewise.session import working_dir

# Topics, consumer group and client settings of the measured set-up.
WORD_TOPIC = "word"
RESULT_TOPIC = "result"
CONSUMER = {"kafka.group.id": "test", "startingOffsets": "latest"}
PRODUCER = {
    "kafka.acks": "all",
    "kafka.retries": "0",
    "kafka.batch.size": "16384",
    "kafka.linger.ms": "1",
    "kafka.buffer.memory": "33554432",
}


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The named columns (default all) of a Parquet table."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def written(rows: DataFrame, purpose: str = "rows") -> DataFrame:
    """The rows read back from a table in the shared working folder: fixed, and without lineage."""
    path = working_dir(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _line(lines: DataFrame) -> DataFrame:
    value = F.col("value")
    bare = F.when(value.endswith("\r"), F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    return lines.withColumn("value", bare)


def read_lines(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """`value STRING`, one row per line, without a carriage return at its end.

    With `order`, a BIGINT of that name numbers the lines 0, 1, 2, ... by file path and place in the file,
    however the files are split and the splits dealt out: the lines of each split are counted, and each
    split starts where the ones before it end.
    """
    lines = _line(spark.read.text(path, lineSep="\n"))
    if order is None:
        return lines
    here = lines.select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("__id"))
    here = here.toDF("value", "__file", "__start", "__id")
    splits = here.groupBy("__file", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy().orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    # One row per split: the only thing that is ordered in one place.
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    place = F.col("__before") + F.col("__id") - F.col("__first")
    return here.join(splits, ["__file", "__start"]).select("value", place.cast("bigint").alias(order))


def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _line(reader.text(path))


def stream_messages(
    spark: SparkSession, servers: str, topic: str = RESULT_TOPIC, **options: str
) -> DataFrame:
    """`key, value STRING` and `timestamp` of a topic; needs the Kafka connector on the class path."""
    settings = {"kafka.bootstrap.servers": servers, "subscribe": topic, **CONSUMER, **options}
    return messages(spark.readStream.format("kafka").options(**settings).load())


def messages(records: DataFrame) -> DataFrame:
    """Binary keys and values as text; other columns are kept."""
    return records.withColumns(
        {c: F.col(c).cast("string") for c in ("key", "value") if c in records.columns}
    )


def message_options(servers: str, topic: str, **options: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic, **PRODUCER, **options}


def write_lines(rows: DataFrame, path: str, column: str = "value") -> None:
    """Text files with one row per line, in place of what was at the path."""
    rows.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_messages(
    rows: DataFrame, servers: str, topic: str = WORD_TOPIC, column: str = "value", **options: str
) -> None:
    """Send a column to a topic with no key; needs the Kafka connector on the class path."""
    settings = message_options(servers, topic, **options)
    rows.select(F.col(column).cast("string").alias("value")).write.format("kafka").options(**settings).save()


def sink(
    rows: DataFrame, fmt: str, checkpoint: str, mode: str = "append", **options: str
) -> DataStreamWriter:
    """A writer of a stream to `kafka`, `parquet`, `text`, `memory` or `noop`, yet to be started.

    For `kafka`, pass `message_options`.
    """
    return (
        rows.writeStream.format(fmt)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .options(**options)
    )


def write_metric(metric: DataFrame, path: str, column: str = "thp") -> None:
    """A one-line text file with the metric, in place of the last one."""
    write_lines(metric.select(column).coalesce(1), path, column)


def read_metric(spark: SparkSession, path: str, column: str = "thp") -> DataFrame:
    return spark.read.text(path).select(F.col("value").cast("double").alias(column))


def append_metric(metric: DataFrame, path: str) -> None:
    """Keep a history: add the metric as a row of a Parquet table."""
    metric.write.mode("append").parquet(path)
