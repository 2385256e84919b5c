"""Keyed state of a stream as a log: each batch adds a run of what it changed, reads merge runs, and runs are
put together as they become many.

A batch writes its own rows and nothing else, so what it costs follows the batch and not the number of keys. A
run's level goes by its size; when FAN runs of a level stand at the end of the log, with none of a higher one
between them, they are merged, so a row is written again about once per level: log(keys / rows of a batch) times
in all, and a large run is left alone by small ones. A run of many rows is cut into buckets by a hash of the key, and a batch reads those its keys are in.

Every batch leaves a manifest, which names the runs that hold and carries a note (a few numbers). A batch that is
run again starts from the manifest before it and writes its files anew; runs that no manifest can lead to any
more are deleted. All of it lives in the checkpoint folder, which drivers and executors share.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from panewise.session import forget

#: Runs of a level that are merged; each level has FAN times the rows of the one below.
FAN = 4
#: Rows of a run of the lowest level, at most.
LEVEL_ROWS = 1 << 12
#: Rows of a bucket, about; a run of fewer is not cut.
BUCKET_ROWS = 1 << 20

#: Whether a row takes its key out of the state.
GONE = "__gone"
_AT, _BUCKET = "__written", "__bucket"


@dataclass(frozen=True)
class Run:
    """A folder of rows: the batch of its newest rows, and how it is cut."""

    name: str
    batch: int
    rows: int
    buckets: int

    @property
    def level(self) -> int:
        level, most = 0, LEVEL_ROWS
        while self.rows > most:
            level, most = level + 1, most * FAN
        return level


def newest_to_merge(runs: Sequence[Run]) -> int:
    """How many runs at the end of the log are to be merged; 0 if none. Only neighbours in age are."""
    for level in sorted({r.level for r in runs}):
        n = same = 0
        while n < len(runs) and runs[-1 - n].level <= level:
            same += runs[-1 - n].level == level
            n += 1
        if same >= FAN:
            return n
    return 0


class LogState:
    """A table of keyed rows under a checkpoint folder.

    key       the column that batches ask by
    identity  the columns of which the table has one row each (default the key): the newest row holds
    combine   instead of the newest row, what rows of an identity are put together to
    """

    def __init__(
        self,
        spark: SparkSession,
        checkpoint: str,
        name: str,
        schema: StructType,
        key: str,
        identity: Sequence[str] = (),
        combine: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self._spark, self._key, self._identity = spark, key, list(identity) or [key]
        self._schema = StructType([f for f in schema.fields]).add(GONE, "boolean")
        self._columns = [f.name for f in schema.fields]
        self._combine, self._base = combine, f"{checkpoint}/tables/{name}"

    # Manifests --------------------------------------------------------------------------------------

    def _place(self, path: str):
        place = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, batch_id: int) -> tuple[list[Run], dict, list[str]]:
        """The runs, oldest first, the note, and the names of runs that were there for the batch alone."""
        path, fs = self._place(f"{self._base}/manifest/{batch_id}.json")
        if batch_id < 0 or not fs.exists(path):
            return [], {}, []
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        held = json.loads(text)
        return [Run(**r) for r in held["runs"]], held["note"], held["passing"]

    def _commit(self, batch_id: int, runs: list[Run], note: dict, passing: list[str]) -> None:
        """A manifest appears whole or not at all."""
        path, fs = self._place(f"{self._base}/manifest/{batch_id}.json")
        part, _ = self._place(f"{self._base}/manifest/{batch_id}.part")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(json.dumps({"runs": [asdict(r) for r in runs], "note": note, "passing": passing}).encode()))
        finally:
            stream.close()
        fs.delete(path, False)
        if not fs.rename(part, path):
            raise OSError(f"could not write the manifest {path}")

    def runs(self, batch_id: int) -> list[Run]:
        """The runs that hold after a batch, oldest first."""
        return self._manifest(batch_id)[0]

    def note(self, batch_id: int) -> dict:
        """What a batch noted; empty before the first."""
        return self._manifest(batch_id)[1]

    # Rows -------------------------------------------------------------------------------------------

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self._key), F.lit(buckets)).cast("int")

    def _rows(self, run: Run, touched: set[int] | None = None) -> DataFrame | None:
        path = f"{self._base}/{run.name}"
        if run.buckets == 1 or touched is None:
            read = self._spark.read.schema(self._schema).parquet(path)
        else:
            _, fs = self._place(path)
            there = [f"{path}/{_BUCKET}={b}" for b in sorted({t % run.buckets for t in touched})]
            there = [p for p in there if fs.exists(self._place(p)[0])]
            if not there:
                return None
            read = self._spark.read.schema(self._schema).parquet(*there)
        return read.select(*self._schema.names, F.lit(run.batch).alias(_AT))

    def _merged(self, runs: Sequence[Run], keys: DataFrame | None = None) -> DataFrame | None:
        """The rows of several runs put together, with those that are gone."""
        touched = None
        most = max((r.buckets for r in runs), default=1)
        if keys is not None and most > 1:
            touched = {r[0] for r in keys.select(self._bucket(most)).distinct().collect()}
        parts = [p for p in (self._rows(r, touched) for r in runs) if p is not None]
        if not parts:
            return None
        rows = reduce(DataFrame.unionByName, parts)
        if keys is not None:
            asked = keys.select(F.col(self._key).alias("__asked")).distinct()
            rows = rows.join(asked, F.col(self._key).eqNullSafe(F.col("__asked")), "left_semi")
        if self._combine is not None:
            return self._combine(rows.drop(_AT, GONE)).withColumn(GONE, F.lit(False))
        if len(parts) == 1:
            return rows.drop(_AT)
        rest = [c for c in self._schema.names if c not in self._identity]
        newest = rows.groupBy(*self._identity).agg(F.max_by(F.struct(*rest), _AT).alias("__row"))
        return newest.select(*self._identity, *[F.col(f"__row.{c}").alias(c) for c in rest])

    def read(self, batch_id: int, keys: DataFrame | None = None) -> DataFrame | None:
        """What the batches before left, of the keys a table has or of all; None if there is none."""
        rows = self._merged(self.runs(batch_id - 1), keys)
        return None if rows is None else rows.where(~F.col(GONE)).select(*self._columns)

    def write(self, rows: DataFrame, batch_id: int, note: dict | None = None, keep: Column | None = None) -> DataFrame:
        """Add the rows a batch changed, those with GONE true to be taken out; they are returned as written.

        keep  rows of older runs for which it does not hold may be dropped when runs are merged
        """
        runs = self.runs(batch_id - 1)
        gone = F.col(GONE) if GONE in rows.columns else F.lit(False)
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self._schema if f.name != GONE]
        new = self._put(rows.select(*typed, gone.alias(GONE)), f"run-{batch_id}", batch_id, 1)
        runs, own = [*runs, new], {new.name}
        while n := newest_to_merge(runs):
            merged = self._compacted(runs[-n:], f"run-{batch_id}-{len(own)}", n == len(runs), keep)
            runs = [*runs[:-n], merged]
            own.add(merged.name)
        self._commit(batch_id, runs, note or {}, sorted(own - {r.name for r in runs}))
        self._forget(batch_id)
        return self._rows(new).drop(_AT)

    def _put(self, rows: DataFrame, name: str, batch: int, buckets: int) -> Run:
        seen, path = Observation(), f"{self._base}/{name}"
        watched = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        if buckets == 1:
            watched.write.mode("overwrite").parquet(path)
        else:
            # Dealt by bucket first, so that each bucket is one file.
            dealt = watched.withColumn(_BUCKET, self._bucket(buckets)).repartition(buckets, _BUCKET)
            dealt.write.mode("overwrite").partitionBy(_BUCKET).parquet(path)
        return Run(name, batch, int(seen.get["rows"]), buckets)

    def _compacted(self, old: Sequence[Run], name: str, oldest: bool, keep: Column | None) -> Run:
        """One run of several neighbours."""
        rows = self._merged(old)
        if oldest:
            rows = rows.where(~F.col(GONE))  # nothing is left for them to take out
        if keep is not None:
            rows = rows.where(keep)
        buckets = 1
        while buckets * BUCKET_ROWS < sum(r.rows for r in old):
            buckets *= 2
        return self._put(rows, name, old[-1].batch, buckets)

    def _forget(self, batch_id: int) -> None:
        """This batch may be run again from the manifest before it, never from the one before that.

        Runs that the batch before wrote and merged at once are in no manifest; they were there for its output.
        """
        held, _, passing = self._manifest(batch_id - 1)
        before = {r.name for r in held}
        for name in ({r.name for r in self.runs(batch_id - 2)} | set(passing)) - before:
            forget(self._spark, f"{self._base}/{name}")
        forget(self._spark, f"{self._base}/manifest/{batch_id - 2}.json")
