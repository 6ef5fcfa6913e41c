"""Exact duplicates by a stateful stream.

A first stream reads new files of a source folder and notes for each row the digest of its normalised text, its identifier and
its content locator: file and place in it.  A second stream keeps one state row per digest, on disk and without
expiry: how many rows there were, and identifier and locator of the row that stays.  Rows are combined per task before
they reach the state, so a text that a third of all rows repeat is one row per task there.  A digest that was met before is a
hit: the full texts of all its rows are then read by their locators and compared byte by byte.  Where texts of
one digest differ, each text is a class of its own.

Both streams take what is there and end; called again with the same work folder, they go on where they were, with
new files only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.spelling import LOWERED
from dossier.llm.stages import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEEN = "doc_id long, file string, place long, digest binary"

# Settings of the state: RocksDB keeps it on the executors' disks and its changes in the checkpoint folder; a store is
# closed after its task, so an executor's disk and memory hold the stores in use and not all of them.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
# Hits whose texts are read at once: their locators are broadcast, some 60 MB at most.
HITS = 400_000


@contextmanager
def _settings(spark: SparkSession, values: dict):
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each text, A to Z lower-cased, null as empty."""
    for batch in batches:
        texts = batch.column(3).cast(pa.large_binary()).to_pylist()
        found = [hashlib.sha256((text or b"").translate(LOWERED)).digest() for text in texts]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(found, pa.binary())], ["doc_id", "file", "place", "digest"]
        )


def _located(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("place"),
        F.col(text_col).cast("string").alias("text"),
    )


def _run(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class StreamDedup:
    """Duplicates among the rows of Parquet files in ``source``, a folder that may grow or a single file.

    ``work`` is a shared folder that holds the rows seen, the state and its classes.  ``digest_bytes`` shortens the key of
    the state (for tests of collisions); results do not depend on it.  ``batches`` is in how many steps a backlog is
    passed to the state.  Extra columns of the source are not read."""

    def __init__(
        self,
        spark: SparkSession,
        source: str,
        work: str,
        id_col: str = "doc_id",
        text_col: str = "text",
        digest_bytes: int = 32,
        batches: int = 2,
    ) -> None:
        self.spark, self.source, self.work = spark, source, work
        self.id_col, self.text_col, self.batches = id_col, text_col, batches
        self.key = F.substring("digest", 1, digest_bytes).alias("key")

    def seen(self) -> DataFrame:
        """Rows met so far: doc_id, file, place, digest of the full text."""
        return self.spark.read.schema(SEEN).parquet(f"{self.work}/seen")

    def advance(self) -> None:
        """Take in all files that are new in the source."""
        schema = self.spark.read.parquet(self.source).schema
        # A stream takes a single file only by a pattern; this one matches the path itself.
        path = self.source.rstrip("/")
        arrived = self.spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
        noted = _located(arrived, self.id_col, self.text_col).mapInArrow(_digests, SEEN)
        _run(noted.writeStream.format("parquet").option("path", f"{self.work}/seen"), f"{self.work}/seen-checkpoint")
        before = self._last_batch()
        with _settings(self.spark, STATE):
            files = max(1, -(-self._new_files() // self.batches))
            stream = self.spark.readStream.schema(SEEN).option("maxFilesPerTrigger", files).parquet(f"{self.work}/seen")
            keep = F.max(F.struct("doc_id", "file", "place")).alias("keep")
            state = stream.groupBy(self.key).agg(keep, F.count("*").alias("n"))
            _run(state.writeStream.outputMode("update").foreachBatch(self._store), f"{self.work}/state-checkpoint")
        self._check(before)

    def _new_files(self) -> int:
        """Files of rows seen: at least as many as the state has yet to read."""
        return self.seen().select(F.col("_metadata.file_path").alias("f")).distinct().count()

    def _store(self, changed: DataFrame, batch: int) -> None:
        """Classes that a batch changed.  A batch that is handed over again overwrites itself."""
        changed.write.mode("overwrite").parquet(f"{self.work}/classes/batch={batch}")

    def _stored(self) -> DataFrame:
        shape = "key binary, keep struct<doc_id:long,file:string,place:long>, n long, batch int"
        base = f"{self.work}/classes"
        self.spark.createDataFrame([], shape).write.mode("ignore").partitionBy("batch").parquet(base)
        return self.spark.read.schema(shape).parquet(base)

    def _last_batch(self) -> int:
        last = self._stored().agg(F.max("batch")).head()[0]
        return -1 if last is None else last

    def classes(self) -> DataFrame:
        """(key, keep, n) per digest, as the state has them."""
        latest = self._stored().groupBy("key").agg(F.max_by(F.struct("keep", "n"), "batch").alias("c"))
        return latest.select("key", "c.keep", "c.n")

    def _check(self, before: int) -> None:
        """Compare the full texts of all digests that were hit after batch ``before``; digests with several texts
        are written down, with a class per text."""
        hit = self._stored().where((F.col("batch") > before) & (F.col("n") > 1)).select("key").distinct()
        rows = staged(self.seen().withColumn("key", self.key).join(hit, "key").select("key", "file", "place"), "hits")
        kinds = self._texts(rows)
        mixed = staged(kinds.groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") > 1).select("key"), "mixed-digests")
        if not mixed.head(1):
            return
        # The few digests of several texts are gone through once more, row by row.
        own = staged(rows.join(mixed, "key"), "mixed-rows")
        each = self._texts(own).select("key", "text", "keep", "n")
        split = self._contents(own).select("key", "text", "file", "place").join(each, ["key", "text"]).drop("text")
        split.withColumn("run", F.lit(before)).write.mode("overwrite").parquet(f"{self.work}/split/at={before + 1}")

    def _contents(self, rows: DataFrame) -> DataFrame:
        """(key, text normalised, doc_id, file, place): the contents that the locators of ``rows`` name."""
        contents = _located(self.spark.read.parquet(self.source), self.id_col, self.text_col)
        normal = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("text")
        return contents.join(rows, ["file", "place"]).select("key", normal, "doc_id", "file", "place")

    def _texts(self, rows: DataFrame) -> DataFrame:
        """(key, text, keep, n): the different texts of each key, told apart by all their bytes.

        Source files are taken in parts of at most ``HITS`` hits, so only the files of hits are read, each once, and only texts of hits
        are moved: the locators of a part go to the files.  A file with more hits than that is joined as Spark sees fit.
        A text is the grouping key and is combined per task, so one that many rows share moves once per task."""
        counted = rows.groupBy("file").count().orderBy("file").collect()  # one row per source file
        parts: list[tuple[list, int]] = []
        for row in counted:
            if parts and parts[-1][1] + row["count"] <= HITS:
                parts[-1] = (parts[-1][0] + [row["file"]], parts[-1][1] + row["count"])
            else:
                parts.append(([row["file"]], row["count"]))
        keep = F.max(F.struct("doc_id", "file", "place")).alias("keep")
        found = []
        for files, hits in parts:
            near = rows.where(F.col("file").isin(files)) if len(parts) > 1 else rows
            texts = self._contents(F.broadcast(near) if hits <= HITS else near)
            if len(parts) > 1:
                texts = texts.where(F.col("file").isin(files))
            found.append(texts.groupBy("key", "text").agg(keep, F.count("*").alias("n")))
        if len(found) == 1:
            return found[0]
        shape = "key binary, text string, keep struct<doc_id:long,file:string,place:long>, n long"
        stored = [staged(part, "hit-texts") for part in found] or [self.spark.createDataFrame([], shape)]
        return reduce(DataFrame.unionByName, stored).groupBy("key", "text").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))

    def _split(self) -> DataFrame:
        """(file, place, keep, n) of rows whose digest has several texts; the last check of a row counts."""
        shape = "key binary, file string, place long, keep struct<doc_id:long,file:string,place:long>, n long, run int, at int"
        base = f"{self.work}/split"
        self.spark.createDataFrame([], shape).write.mode("ignore").partitionBy("at").parquet(base)
        last = self.spark.read.schema(shape).parquet(base).groupBy("file", "place").agg(F.max_by(F.struct("keep", "n"), "run").alias("c"))
        return last.select("file", "place", "c.keep", "c.n")

    def result(self) -> DataFrame:
        """``doc_id, keep_id, group_size, kept, text_sha256`` of every row seen.

        Of equal texts the row with the greatest id stays, of several such rows the last by file and place, so one row of each
        class is kept.  Null ids are the least; a null text counts as empty.  An empty source gives no rows."""
        rows = self.seen().withColumn("key", self.key).join(self.classes(), "key")
        split = self._split()
        if split.head(1):
            own = split.select("file", "place", F.struct("keep", "n").alias("own"))
            rows = rows.join(own, ["file", "place"], "left").withColumns(
                {"keep": F.coalesce("own.keep", "keep"), "n": F.coalesce("own.n", "n")}
            )
        kept: Column = (F.col("file") == F.col("keep.file")) & (F.col("place") == F.col("keep.place"))
        return rows.select(
            "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def deduplicated(spark: SparkSession, source: str, work: str, **options) -> DataFrame:
    """All rows of ``source`` with their classes: :meth:`StreamDedup.result` after one pass over what is new."""
    dedup = StreamDedup(spark, source, work, **options)
    dedup.advance()
    return dedup.result()
