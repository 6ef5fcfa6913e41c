"""Stage tables: written once in the shared folder, then read by later stages.

A written stage cuts lineage, so neither a lost executor nor a second consumer
recomputes what came before it.  It also gives the optimizer the true size of
the table: whether a later join broadcasts it is then decided by Spark's own
threshold on the bytes on disk, with a shuffled join beyond that.

All stages of a session lie in one folder, which :func:`release` deletes.  Those that only a piece of work needs are deleted
with it (:func:`scratch`).  The files of the shuffles that led to a stage go as soon as it is written.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
RUN = "spark.dossier.run"
OWN = "spark.dossier.folder"
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Of the thread that is at work, so that stages of another do not get into its folder.
_scratch: ContextVar[str] = ContextVar("scratch", default="")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Only a session that runs in one process, as in
    tests, gets one of its own where none is named."""
    folder = spark.conf.get(CONF, None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError(f"set {CONF} to a folder that every executor can reach")
    folder = spark.conf.get(OWN, None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="dossier-")
        spark.conf.set(OWN, folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """The folder of this session's stages."""
    name = spark.conf.get(RUN, None)
    if not name:
        name = uuid.uuid4().hex
        spark.conf.set(RUN, name)
    return f"{shared_folder(spark)}/dossier/{name}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{_scratch.get()}{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str, part: str | None = None, mode: str = "errorifexists") -> None:
    """Write ``df`` as Parquet, by the column ``part`` if given.  What was shuffled for it is deleted once it is written: Spark keeps such files
    until the driver happens to collect its garbage, which on large tables are many times the table."""
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        writer = df.write.mode(mode).option("compression", "zstd")
        (writer if part is None else writer.partitionBy(part)).parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in a new shared folder and read it back."""
    path = new_folder(df.sparkSession, name)
    save(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Stages and folders that this thread makes inside are deleted at the end, so nothing that is read later may be built on them."""
    folder = f"{_scratch.get()}{name}-{uuid.uuid4().hex}/"
    outer = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(outer)
        _delete(spark, f"{run_folder(spark)}/{folder}")


def stage_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stage what ``make`` returns and delete the stages that it makes on the way, which must be needed by nothing else."""
    path = new_folder(spark, name)
    with scratch(spark, name):
        df = make()
        save(df, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the stages of this session.  Tables built on them cannot be read any more."""
    _delete(spark, run_folder(spark))
