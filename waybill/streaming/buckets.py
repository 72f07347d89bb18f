"""Stored tables in buckets that take changes without being rewritten.

A row lies in the bucket an expression over its columns names: the hash of a key, a stretch of time. A bucket is a base and the files of
changes since then; a small manifest names them all. ``add`` writes the changes of one epoch, a file or a few per bucket it touches,
and merges only those buckets into a new base that have gathered ``most_changes`` of them: a row is rewritten once for so many
epochs, and buckets without changes keep their files. ``read`` gives any buckets as they are after the last epoch.

Files get names of their own, and the manifest is swapped at the end, as one file in one of two places in turn. So whatever fails
before leaves the table as it was, and readers of the manifest before find their files. An epoch that is run again changes nothing.
Files no manifest names any more are the caller's to remove.

The manifest has a row per bucket and file set, which is what the driver sees; the number of buckets bounds it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EPOCH = "epoch"
_BUCKET = "_bucket"
_MANIFEST = "serial bigint, version bigint, bucket bigint, kind string, path string"
_BASE, _CHANGES = "base", "changes"


def hashed(key: str, buckets: int) -> Column:
    """The bucket of a key."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("bigint")


@dataclass
class BucketTable:
    """``merge`` makes the rows of some buckets out of those of the base and the changes, which have the number of their ``epoch``.

    An object reads the manifest once and knows it from then on by what it writes; a reader beside the writer makes a new object to
    see later epochs.
    """

    spark: SparkSession
    folder: str
    rows: StructType
    changes: StructType
    bucket: Column
    merge: Callable[[DataFrame, DataFrame], DataFrame]
    most_changes: int = 8
    _known: tuple | None = None

    # --- manifest ---

    def _entries(self) -> tuple[int, int | None, list[tuple[int, str, str]]]:
        """Serial number and version (None before ``create``) of the last manifest, and its rows (bucket, kind, path)."""
        if self._known is not None:
            return self._known
        found = []
        for slot in (0, 1):
            try:
                found += self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest/{slot}").collect()
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
        last = max((r.serial for r in found), default=-1)
        own = [r for r in found if r.serial == last]
        self._known = last, own[0].version if own else None, [(r.bucket, r.kind, r.path) for r in own if r.kind]
        return self._known

    def _swap(self, serial: int, version: int, entries: list[tuple[int, str, str]]) -> None:
        rows = [(serial, version, None, None, None)] + [(serial, version, *e) for e in sorted(entries)]
        (self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.folder}/manifest/{serial % 2}"))
        self._known = serial, version, entries

    def version(self) -> int | None:
        """The last epoch that is in the table; -1 for the table as it was created, None before."""
        return self._entries()[1]

    # --- files ---

    def _write(self, df: DataFrame, kind: str, version: int) -> list[tuple[int, str, str]]:
        """Write rows by bucket. Spark splits buckets that hold much and joins those that hold little into tasks."""
        path = f"{self.folder}/{kind}-{version}-{uuid.uuid4().hex}"
        df.withColumn(_BUCKET, self.bucket).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(path)
        schema = StructType(list(df.schema.fields)).add(_BUCKET, "long")
        buckets = self.spark.read.schema(schema).parquet(path).select(_BUCKET).distinct().collect()
        return [(r[0], kind, path) for r in buckets]

    def _load(self, entries: list[tuple[int, str, str]], kind: str) -> DataFrame:
        schema = self.rows if kind == _BASE else StructType([*self.changes.fields]).add(EPOCH, "long")
        paths = [f"{path}/{_BUCKET}={bucket}" for bucket, k, path in entries if k == kind]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # --- the table ---

    def create(self, df: DataFrame) -> None:
        """The first base; a table that is there stays as it is."""
        if self.version() is None:
            self._swap(0, -1, self._write(df.select(*self.rows.names), _BASE, -1))

    def read(self, buckets: Iterable[int] | None = None, more: DataFrame | None = None) -> DataFrame:
        """The rows of the given buckets (all if none are given). ``more``: changes that are not in the table yet."""
        entries = self._entries()[2]
        if buckets is not None:
            chosen = set(buckets)
            entries = [e for e in entries if e[0] in chosen]
        changes = self._load(entries, _CHANGES)
        return self.merge(self._load(entries, _BASE), changes if more is None else changes.unionByName(more))

    def add(self, changes: DataFrame, epoch: int) -> None:
        """Take the changes of an epoch, which is larger than all before; one that is in the table already changes nothing."""
        serial, version, entries = self._entries()
        if version is None:
            raise ValueError("create the table first")
        if epoch <= version:
            return
        rows = changes.select(*self.changes.names, F.lit(epoch).cast("bigint").alias(EPOCH))
        self._swap(serial + 1, epoch, self._merged(entries + self._write(rows, _CHANGES, epoch), epoch, self.most_changes))

    def compact(self) -> None:
        """Merge every bucket that has changes."""
        serial, version, entries = self._entries()
        if any(kind == _CHANGES for _, kind, _ in entries):
            self._swap(serial + 1, version, self._merged(entries, version, 1))

    def _merged(self, entries: list[tuple[int, str, str]], version: int, most: int) -> list[tuple[int, str, str]]:
        """``entries`` with the buckets of ``most`` changes or more merged into a base of their own."""
        gathered: dict[int, int] = {}
        for bucket, kind, _ in entries:
            gathered[bucket] = gathered.get(bucket, 0) + (kind == _CHANGES)
        full = {b for b, n in gathered.items() if n >= most}
        if not full:
            return entries
        own = [e for e in entries if e[0] in full]
        merged = self.merge(self._load(own, _BASE), self._load(own, _CHANGES)).select(*self.rows.names)
        return [e for e in entries if e[0] not in full] + self._write(merged, _BASE, version)


def latest(key: list[str], order: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge by which the row of a key with the greatest ``order`` stays, of equal ones that of the last epoch."""
    def merge(base: DataFrame, changes: DataFrame) -> DataFrame:
        fields = [c for c in base.columns if c not in key]
        every = base.withColumn(EPOCH, F.lit(-1).cast("bigint")).unionByName(changes)
        return (every.groupBy(*key).agg(F.max_by(F.struct(*fields), F.struct(*order, EPOCH)).alias("_row"))
                .select(*key, "_row.*"))
    return merge


def appended(base: DataFrame, changes: DataFrame) -> DataFrame:
    """A merge that keeps all rows; the table has a column ``epoch`` of its own."""
    return base.unionByName(changes)
