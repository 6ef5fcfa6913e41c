"""Tables that grow by segments and are compacted without stopping writers.

Each write is a folder of its own.  A log names the segments, and those that a compaction has replaced; a segment counts
if it is named and not replaced.  So writers never touch each other's files, and what was appended while a compaction
ran is not among what it replaces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOG = "segment string, replaced array<string>"


class Segments:
    """Segments under ``path``, a shared folder; one segment may hold several tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> list:
        base = f"{self.path}/log"
        self.spark.createDataFrame([], LOG).write.mode("ignore").parquet(base)
        return self.spark.read.schema(LOG).parquet(base).collect()  # one row per write and compaction

    def segments(self) -> list[str]:
        """Segments that count; compaction keeps them few."""
        log = self._log()
        return sorted({row["segment"] for row in log} - {s for row in log for s in row["replaced"] or []})

    def new_segment(self) -> str:
        return f"s{uuid.uuid4().hex}"

    def folder(self, table: str, segment: str) -> str:
        return f"{self.path}/{table}/segment={segment}"

    def _name(self, segment: str, replaced: list[str]) -> None:
        """Let a written segment count, in place of those it replaces."""
        row = self.spark.createDataFrame([(segment, replaced)], LOG).coalesce(1)
        row.write.mode("append").parquet(f"{self.path}/log")

    def stored(self, table: str, segments: list[str], shape: str) -> DataFrame:
        """A table's rows in the given segments; ``shape`` names its columns with ``segment``."""
        if not segments:
            return self.spark.createDataFrame([], shape)
        reader = self.spark.read.schema(shape).option("basePath", f"{self.path}/{table}")
        return reader.parquet(*[self.folder(table, s) for s in segments])

    def vacuum(self, *tables: str) -> int:
        """Delete the files of replaced segments, when nobody reads them any more; returns how many went."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        gone = 0
        for segment in sorted({s for row in self._log() for s in row["replaced"] or []}):
            for table in tables or ("rows",):
                folder = path(self.folder(table, segment))
                gone += folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return gone
