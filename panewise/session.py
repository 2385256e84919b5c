"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "panewise", memory: str = "16g") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    partitions = "8" if cores == "*" else str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.unix.domain.socket.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _local_base() -> str:
    """One temporary folder per driver, which goes when the driver ends."""
    base = tempfile.mkdtemp(prefix="panewise-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def forget(spark: SparkSession, path: str) -> None:
    """Delete a working folder, wherever it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


# Folders this driver was given under a shared folder.
_given: set[str] = set()


@functools.cache
def _clear_at_exit() -> None:
    def clear() -> None:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:  # else the session has ended before
            for path in _given:
                forget(spark, path)

    atexit.register(clear)


def working_dir(spark: SparkSession, purpose: str) -> str:
    """A new path for `purpose` under the shared folder the session names in `spark.checkpoint.dir`.

    Only a local master may go without that setting; it then gets a temporary folder. What is left in either
    goes when the driver ends with its session open: tables that results are still read from live that long.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_base()
        return f"{base}/{purpose}-{uuid.uuid4().hex}"
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _given.add(path)
    _clear_at_exit()
    return path
