"""Named state-store profiles as session settings."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

_PREFIX = "spark.sql.streaming.stateStore."
_PROVIDERS = "org.apache.spark.sql.execution.streaming.state."
IN_MEMORY = _PROVIDERS + "HDFSBackedStateStoreProvider"
ROCKSDB = _PROVIDERS + "RocksDBStateStoreProvider"

# Block size and number of write buffers of the measured RocksDB set-up.
BLOCK_SIZE_KB = 16
MAX_WRITE_BUFFERS = 16


def state_profile(
    name: str, block_cache_mb: int | None = None, write_buffer_mb: int | None = None
) -> dict[str, str]:
    """Session settings for a profile: `mem`, `file`, or any name that starts with `rocksdb`.

    `mem` and `file` keep state in executor memory with its changes logged in the checkpoint folder.
    RocksDB keeps it on the executor's disk (`spark.local.dir`), so state may exceed memory.
    """
    if name in ("mem", "file"):
        return {_PREFIX + "providerClass": IN_MEMORY}
    if not name.startswith("rocksdb"):
        raise ValueError(f"state profile must be mem, file or rocksdb..., got {name!r}")
    settings = {
        _PREFIX + "providerClass": ROCKSDB,
        _PREFIX + "rocksdb.blockSizeKB": str(BLOCK_SIZE_KB),
        _PREFIX + "rocksdb.maxWriteBufferNumber": str(MAX_WRITE_BUFFERS),
        _PREFIX + "rocksdb.changelogCheckpointing.enabled": "true",
    }
    if block_cache_mb is not None:
        settings[_PREFIX + "rocksdb.blockCacheSizeMB"] = str(block_cache_mb)
    if write_buffer_mb is not None:
        settings[_PREFIX + "rocksdb.writeBufferSizeMB"] = str(write_buffer_mb)
    return settings


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Set session settings while a query is started; a started query keeps its own copy."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def state_table(spark: SparkSession, checkpoint: str, variable: str, operator: int = 0, batch_id: int | None = None) -> DataFrame:
    """`key, value, partition_id` of a named variable of a stateful operator, from a stream's checkpoint: after its
    last batch, or after `batch_id`. Spark reads the store's files in parallel; no stream has to run.

    The settings of the store that the stream ran with have to hold while it is read.
    """
    reader = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(checkpoint)


def counter_table(spark: SparkSession, checkpoint: str, key: str, payload: str, batch_id: int | None = None) -> DataFrame:
    """`key, n, payload`: the state of `stateful.running_counter`."""
    rows = state_table(spark, checkpoint, "counter", batch_id=batch_id)
    return rows.select(F.col(f"key.{key}").alias(key), F.col("value.n").alias("n"), F.col("value.last").alias(payload))
