"""A table that grows by micro-batches and stays cheap to list.

Each batch is a segment of data folders, by date first.  A numbered manifest
names the segments that make up a version and the last batch they hold: a batch
that is in it already is not written again.  Once there are many segments they
are merged under a new version; the version before stays readable, older ones are
dropped.  Readers take the segments of one manifest, so they see one version.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.folders import Folders

MERGE_AFTER = 32  # segments
KEPT = 2  # versions


class BatchLog:
    """``schema`` holds all columns but ``segment``, among them ``batch_id`` and the date column."""

    def __init__(self, spark: SparkSession, path: str, schema: str, date: str, merge_after: int = MERGE_AFTER):
        self.spark, self.path, self.schema, self.date, self.merge_after = spark, path, schema, date, merge_after
        self.folders = Folders(spark, path)

    def manifest(self, version: int | None = None) -> dict:
        """Version, last batch and segments; the newest version if none is named, version 0 of an empty log."""
        home = self.folders.at("manifest")
        if version is None:
            version = max(self.folders.numbers(home), default=0)
        if not version:
            return {"version": 0, "last_batch": -1, "segments": []}
        return json.loads(self.folders.first_line(self.folders.below(home, f"{version:012d}")))

    def _put(self, before: dict, last_batch: int, segments: list[str]) -> dict:
        after = {"version": before["version"] + 1, "last_batch": last_batch, "segments": segments}
        if not self.folders.put(self.folders.at("manifest", f"{after['version']:012d}"), json.dumps(after)):
            raise RuntimeError(f"version {after['version']} of {self.path} was written by another query")
        return after

    def append(self, rows: DataFrame, batch_id: int) -> bool:
        """Add a batch; False, and nothing written, if the log has it.  ``rows`` lacks ``batch_id``."""
        before = self.manifest()
        if batch_id <= before["last_batch"]:
            return False
        segment = f"b{batch_id:012d}"
        self._write(rows.withColumn("batch_id", F.lit(batch_id).cast("long")), segment)
        after = self._put(before, batch_id, [*before["segments"], segment])
        if len(after["segments"]) > self.merge_after:
            self.merge(after)
        return True

    def merge(self, before: dict) -> None:
        """All segments of a version as one, under the next version; then drop what no kept version names."""
        segment = f"m{before['version']:012d}"
        self._write(self._segments(before["segments"]), segment)
        after = self._put(before, before["last_batch"], [segment])
        home = self.folders.at("manifest")
        kept = [v for v in self.folders.numbers(home) if v > after["version"] - KEPT]
        live = {name for version in kept for name in self.manifest(version)["segments"]}
        for version in self.folders.numbers(home):
            if version not in kept:
                self.folders.drop(self.folders.below(home, f"{version:012d}"))
        for day in self.folders.names(self.folders.at("data")):
            for name in self.folders.names(self.folders.at("data", day)):
                if name.startswith("segment=") and name.removeprefix("segment=") not in live:
                    self.folders.drop(self.folders.at("data", day, name))

    def _write(self, rows: DataFrame, segment: str) -> None:
        """The segment's folders, whatever a failed attempt left there replaced."""
        spread = rows.withColumn("segment", F.lit(segment)).repartition(self.date)
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.date, "segment").parquet(f"{self.path}/data")

    def _segments(self, segments: list[str], days: Iterable[str] | None = None) -> DataFrame:
        folders = [f"{self.path}/data"] if days is None else [f"{self.path}/data/{self.date}={day}" for day in days if self.folders.names(self.folders.at("data", f"{self.date}={day}"))]
        columns = f"{self.schema}, segment STRING"
        if not segments or not folders or not self.folders.names(self.folders.at("data")):
            return self.spark.createDataFrame([], columns).drop("segment")
        held = self.spark.read.schema(columns).option("basePath", f"{self.path}/data").parquet(*folders)
        return held.where(F.col("segment").isin(segments)).drop("segment")

    def read(self, days: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """Rows of one version; only the folders of ``days``, if given, are listed."""
        return self._segments(self.manifest(version)["segments"], days)
