"""Keyed tables as logs of runs (O9, O29): appended versions with tombstones, merged on read, compacted by size.

A table is a folder of runs. A commit appends one run that holds only the rows and tombstones at hand, so a batch of k
keys writes O(k) bytes however large the table is. The latest commit that names a key replaces all its earlier rows;
reading keeps, per key, the rows of that commit. Runs of like size are merged into one, so each row is rewritten a
number of times that grows with the logarithm of the table, and the number of runs stays as small.

A run counts once Spark's commit protocol has written its success marker; what a lost job left behind is ignored and
overwritten by its repetition. A commit number that a run already covers is skipped, so a repeated batch changes nothing.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.sources.tables import BUCKET, key_bucket

COMMIT, GONE = "__commit", "__gone"
_RUN = re.compile(r"run-(\d+)-(\d+)\Z")


@dataclass(frozen=True)
class Run:
    first: int
    last: int
    path: str
    size: int

    def covers(self, first: int, last: int) -> bool:
        return self.first <= first and last <= self.last


@dataclass(frozen=True)
class KeyedLog:
    """A table below ``path`` whose rows are replaced by ``keys``; ``keys`` may be coarser than a row.

    ``bucket_keys`` (all keys by default) choose a row's bucket; readers that want some keys open their buckets only.
    """

    path: str
    keys: tuple[str, ...]
    bucket_keys: tuple[str, ...] = ()
    buckets: int = 64
    fanout: int = 4

    def _files(self, spark: SparkSession, path: str | None = None):
        location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path or self.path)
        return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location

    def _bucket(self) -> Column:
        return key_bucket(list(self.bucket_keys or self.keys), self.buckets)

    def runs(self, spark: SparkSession) -> list[Run]:
        """Complete runs from old to new, without those that a merged run contains."""
        files, location = self._files(spark)
        found = []
        for status in files.listStatus(location) if files.exists(location) else []:
            named = _RUN.match(status.getPath().getName())
            marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if named and files.exists(marker):
                size = files.getContentSummary(status.getPath()).getLength()
                found.append(Run(int(named[1]), int(named[2]), status.getPath().toString(), size))
        live = [r for r in found if not any(o is not r and o.covers(r.first, r.last) for o in found)]
        return sorted(live, key=lambda r: r.first)

    def append(self, rows: DataFrame, commit: int, gone: DataFrame | None = None) -> bool:
        """Write one commit: ``rows`` replace what their keys held, keys of ``gone`` without rows are deleted.

        False if a run covers the commit already.
        """
        spark = rows.sparkSession
        if any(run.covers(commit, commit) for run in self.runs(spark)):
            return False
        entries = rows.withColumn(GONE, F.lit(False))
        if gone is not None:
            given, named = gone.select(*self.keys).distinct().alias("g"), rows.select(*self.keys).distinct().alias("r")
            left = given.join(named, self._same_key("g", "r"), "left_anti")
            entries = entries.unionByName(left.withColumn(GONE, F.lit(True)), allowMissingColumns=True)
        self._write(entries.withColumn(COMMIT, F.lit(commit).cast("long")), commit, commit)
        return True

    def read(self, spark: SparkSession, wanted: DataFrame | None = None) -> DataFrame:
        """The current rows; with ``wanted`` (distinct values of the bucket keys at least) only those of its keys."""
        runs = self.runs(spark)
        if not runs:
            raise ValueError(f"no complete run below {self.path}")
        rows = self._merged(spark, runs, wanted).filter(~F.col(GONE)).drop(GONE, COMMIT)
        if wanted is None:
            return rows
        names = [k for k in self.keys if k in wanted.columns]
        return rows.alias("t").join(wanted.select(*names).distinct().alias("w"), self._same_key("t", "w", names), "left_semi")

    def compact(self, spark: SparkSession) -> bool:
        """Merge the newest runs while each is at most ``fanout`` times as large as all newer ones together.

        Nothing happens before ``fanout`` runs can be merged. Tombstones go once no older run is left.
        """
        runs = self.runs(spark)
        start, total = len(runs), 0
        while start and (not total or runs[start - 1].size <= self.fanout * total):
            start -= 1
            total += runs[start].size
        if len(runs) - start < self.fanout:
            return False
        rows = self._merged(spark, runs[start:], None)
        self._write(rows if start else rows.filter(~F.col(GONE)), runs[start].first, runs[-1].last)
        return True

    def vacuum(self, spark: SparkSession) -> int:
        """Delete runs that a merged run contains; call it when no reader holds them any more."""
        files, location = self._files(spark)
        live = self.runs(spark)
        removed = 0
        for status in files.listStatus(location) if live else []:
            named = _RUN.match(status.getPath().getName())
            if named and any((r.first, r.last) != (int(named[1]), int(named[2])) and r.covers(int(named[1]), int(named[2])) for r in live):
                removed += bool(files.delete(status.getPath(), True))
        return removed

    def first_commit(self, spark: SparkSession, writer: str) -> int:
        """The number from which ``writer`` (a stream's checkpoint) counts its batches: beyond all commits when it first came."""
        files, location = self._files(spark)
        mark = f"writer-{hashlib.sha256(writer.encode()).hexdigest()[:16]}-"
        for status in files.listStatus(location) if files.exists(location) else []:
            if status.getPath().getName().startswith(mark):
                return int(status.getPath().getName()[len(mark):])
        first = max((run.last for run in self.runs(spark)), default=-1) + 1
        files.mkdirs(self._files(spark, f"{self.path.rstrip('/')}/{mark}{first}")[1])
        return first

    def _same_key(self, left: str, right: str, names: list[str] | None = None) -> Column:
        condition = F.lit(True)
        for name in names or self.keys:
            condition = condition & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
        return condition

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        rows = rows.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET)
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path.rstrip('/')}/run-{first:012d}-{last:012d}")

    def _merged(self, spark: SparkSession, runs: list[Run], wanted: DataFrame | None) -> DataFrame:
        """Per key the rows of its latest commit, tombstones included.

        The oldest run, by far the largest, only loses the keys that newer runs name; it is not aggregated.
        """
        places = None
        if wanted is not None:  # at most ``buckets`` numbers
            places = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]

        def opened(run: Run) -> DataFrame:
            rows = spark.read.parquet(run.path)
            return (rows if places is None else rows.filter(F.col(BUCKET).isin(places))).drop(BUCKET)

        oldest = opened(runs[0])
        if len(runs) == 1:
            return oldest
        newer = opened(runs[1])
        for run in runs[2:]:
            newer = newer.unionByName(opened(run))
        latest = newer.groupBy(*self.keys).agg(F.max(COMMIT).alias("__latest")).alias("l")
        kept = oldest.alias("o").join(latest, self._same_key("o", "l"), "left_anti")
        won = newer.alias("n").join(latest, self._same_key("n", "l") & (F.col(f"n.{COMMIT}") == F.col("l.__latest")), "left_semi")
        return kept.unionByName(won)
