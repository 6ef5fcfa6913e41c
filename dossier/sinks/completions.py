"""The store of completions: written in segments, read by parts, compacted without stopping writers.

Each write of a job is a segment of its own (:mod:`dossier.sinks.segments`), split by a hash of prompt_id into
parts.  Two compactions at once leave some rows twice, which readers take as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.sinks.segments import Segments
from dossier.sinks.stage import save

# ``batch`` names the round of calls that made a row, so a prompt's failed tries are told apart however often they are copied.
ROW = "prompt_id string, content string, error string, batch string"
PARTS = 64
# Blocks of a part, by which calls are dealt out; a task's blocks follow each other, so it writes to few parts.
BLOCKS = 1024


def block() -> Column:
    return F.pmod(F.xxhash64("prompt_id"), F.lit(PARTS * BLOCKS)).cast("int")


def part() -> Column:
    return F.floor(block() / BLOCKS).cast("int")


class CompletionStore(Segments):
    def append(self, rows: DataFrame) -> None:
        """Add rows (ROW) as a segment, as they come: nothing is shuffled between a call and its row in the store."""
        segment = self.new_segment()
        save(rows.withColumn("part", part()), self.folder("rows", segment), "part")
        self._name(segment, [])

    def rows(self, parts: list[int] | None = None, segments: list[str] | None = None) -> DataFrame:
        """Rows of the given segments, by default all that count, of the given parts only."""
        return self._of(self.segments() if segments is None else segments, parts)

    def _of(self, segments: list[str], parts: list[int] | None = None) -> DataFrame:
        found = self.stored("rows", segments, ROW + ", segment string, part int")
        return found if parts is None else found.where(F.col("part").isin(parts))

    def parts_of(self, prompts: DataFrame) -> list[int]:
        return [row["part"] for row in prompts.select(part().alias("part")).distinct().collect()]  # at most PARTS

    def compact(self) -> None:
        """Replace the segments there are by one, with one row per completed prompt and one per failed try of the others.
        Old files stay for readers that started before, until :meth:`vacuum`."""
        old = self.segments()
        if len(old) < 2:
            return
        rows = self._of(old).select("prompt_id", "content", "error", "batch")
        good = rows.where(F.col("error").isNull()).groupBy("prompt_id")
        done = good.agg(F.min("content").alias("content"), F.lit(None).cast("string").alias("error"), F.min("batch").alias("batch"))
        failed = rows.where(F.col("error").isNotNull()).join(done.select("prompt_id"), "prompt_id", "left_anti").distinct()
        merged = done.unionByName(failed).withColumn("part", part()).hint("rebalance", F.col("part"))
        segment = self.new_segment()
        save(merged, self.folder("rows", segment), "part")
        self._name(segment, old)

    def completions(self) -> DataFrame:
        """The stored completions, one row per prompt_id whatever number of writers made it."""
        good = merged_rows(self.rows().where(F.col("error").isNull()))
        return good.select("prompt_id", "content", "error")

    def dead_letters(self, give_up: int) -> DataFrame:
        """(prompt_id, tries, error) of prompts without a completion that have failed ``give_up`` times."""
        failed = merged_rows(self.rows()).where(F.col("error").isNotNull() & (F.col("tries") >= give_up))
        return failed.select("prompt_id", "tries", "error")


def merged_rows(rows: DataFrame, run: str = "") -> DataFrame:
    """prompt_id, content, error and failed tries, one row per prompt_id.  A completion outweighs failures, and of several the
    least counts; of the errors the last by batch counts, before all others one whose batch begins with ``run``."""
    good = F.col("error").isNull()
    rank = F.struct(F.col("batch").startswith(run), "batch", "error")
    return rows.groupBy("prompt_id").agg(
        F.min(F.when(good, F.col("content"))).alias("content"),
        F.when(F.count_if(good) == 0, F.max_by("error", F.when(~good, rank))).alias("error"),
        F.size(F.collect_set(F.when(~good, F.col("batch")))).alias("tries"),
    )
