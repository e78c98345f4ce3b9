"""Result tables of a streaming job, in versions that readers pin.

Every micro-batch makes one version of all tables of a job. A table is either replaced by
each batch, or merged: a batch adds a part, and every so often the parts so far are merged
into a snapshot. A log keeps what every batch adds. Parts and snapshots go to a fixed
number of folders in turn, so that nothing grows but the logs, and nothing is listed.

A version is a manifest, written when all its data are: its number, its settings and the
paths it is made of. The last few manifests stay, so a reader always finds a whole one, and
what a manifest names is not replaced for another ``every`` batches at least.
A batch that is retried writes the same folders and the same manifest again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Micro-batches between two snapshots.
SNAPSHOT_EVERY = 100

BATCH = "batch_id"
_MANIFESTS = 4
_SNAPSHOTS = 3
_ATTEMPTS = 5
_SCHEMA = "number bigint, base bigint, every int, paths map<string, array<string>>"

Merge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Version:
    """What a reader needs to know of a finished micro-batch."""

    number: int
    base: int  # parts from this batch on are read; a snapshot holds those before
    every: int
    paths: Mapping[str, list[str]]


class VersionedTables:
    """The tables of one job under ``folder``.

    ``tables`` names them with the function that merges their parts, None for a table that
    every batch replaces. Parts have a column ``batch_id`` when they are merged. A merge must
    give the shape of a part, and must not mind what is merged first. ``logs`` names the logs.
    """

    def __init__(self, folder: str, tables: Mapping[str, Merge | None], logs: tuple[str, ...] = ()):
        self.folder, self.tables, self.logs = folder, tables, logs
        self._committed: Version | None = None

    # --- writing ---------------------------------------------------------------

    def commit(
        self, number: int, parts: Mapping[str, DataFrame], every: int = SNAPSHOT_EVERY
    ) -> None:
        """Writes the tables and logs of micro-batch ``number`` and makes them a version.

        ``every`` counts when the tables are begun; later ones keep to what the manifest says.
        """
        spark = next(iter(parts.values())).sparkSession
        before = self._committed
        if not before or before.number >= number:  # begun anew, or a batch is retried
            before = self._find(spark, lambda version: version.number < number)
        every = before.every if before else every
        base = number // every * every
        for name in self.logs:
            parts[name].write.mode("overwrite").parquet(f"{self.folder}/{name}/{BATCH}={number}")
        paths: dict[str, list[str]] = {}
        for name, merge in self.tables.items():
            slots = 2 * every if merge else _SNAPSHOTS
            first = base if merge else number
            paths[name] = [self._part(name, n, slots) for n in range(first, number + 1)]
            if merge and base:
                snapshot = f"{self.folder}/{name}/snapshot={base // every % _SNAPSHOTS}"
                if base == number and before:
                    self._write(self.read(spark, name, before), base, snapshot)
                paths[name].insert(0, snapshot)
            self._write(parts[name], number, paths[name][-1])
        self._publish(spark, number, base, every, paths)
        self._committed = Version(number, base, every, paths)

    def _part(self, name: str, number: int, slots: int) -> str:
        return f"{self.folder}/{name}/slot={number % slots}"

    def _write(self, rows: DataFrame, number: int, path: str) -> None:
        rows.withColumn(BATCH, F.lit(number).cast("bigint")).write.mode("overwrite").parquet(path)

    def _publish(
        self, spark: SparkSession, number: int, base: int, every: int, paths: dict[str, list[str]]
    ) -> None:
        named = F.create_map(
            *[c for name, found in paths.items() for c in (F.lit(name), F.array(*map(F.lit, found)))]
        )
        row = spark.range(1, numPartitions=1).select(
            F.lit(number).cast("bigint").alias("number"), F.lit(base).cast("bigint").alias("base"),
            F.lit(every).alias("every"), named.alias("paths"),
        )
        row.write.mode("overwrite").parquet(f"{self.folder}/manifest={number % _MANIFESTS}")

    # --- reading ---------------------------------------------------------------

    def _manifests(self, spark: SparkSession) -> list[Version]:
        """The manifests that are whole just now; one may be in the middle of being replaced."""
        found = []
        for n in range(_MANIFESTS):
            try:
                rows = spark.read.schema(_SCHEMA).parquet(f"{self.folder}/manifest={n}").collect()
            except (PySparkException, Py4JJavaError):
                continue
            found += [Version(r.number, r.base, r.every, r.paths) for r in rows]
        return found

    def _find(self, spark: SparkSession, wanted: Callable[[Version], bool]) -> Version | None:
        return max(filter(wanted, self._manifests(spark)), key=lambda v: v.number, default=None)

    def version(self, spark: SparkSession) -> Version:
        """The newest finished version, to be read as long as ``every`` more batches take."""
        for _ in range(_ATTEMPTS):
            found = self._find(spark, lambda version: True)
            if found:
                return found
            time.sleep(0.05)
        raise ValueError(f"no finished batch in {self.folder}")

    def read(self, spark: SparkSession, name: str, version: Version | None = None) -> DataFrame:
        """A table as of a version, the newest if none is given."""
        version = version or self.version(spark)
        merge = self.tables[name]
        rows = spark.read.parquet(*version.paths[name])
        within = F.col(BATCH).between(version.base if merge else version.number, version.number)
        rows = rows.where(within)
        return (merge(rows) if merge else rows).drop(BATCH)

    def read_log(self, spark: SparkSession, name: str, version: Version | None = None) -> DataFrame:
        """All that the batches up to a version have added to a log."""
        version = version or self.version(spark)
        rows = spark.read.parquet(f"{self.folder}/{name}")
        return rows.where(F.col(BATCH) <= version.number).drop(BATCH)


def newest_by(key: str) -> Merge:
    """Merges parts that hold whole rows per ``key``: the one of the last batch counts."""

    def merge(parts: DataFrame) -> DataFrame:
        fields = [c for c in parts.columns if c not in (key, BATCH)]
        row = F.max_by(F.struct(*fields), BATCH).alias("row")
        return parts.groupBy(key).agg(row).select(key, "row.*")

    return merge
