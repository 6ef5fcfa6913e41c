"""Writers for findings, reports and the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import fixed_values as fixed
from dossier.functions.text import fill, quoted_path


def write_findings(results: DataFrame, path: str) -> None:
    """Query results as Parquet by run; a run written again replaces its old rows.

    The rebalance hint lets Spark split a large run over several files and pack
    small ones together."""
    (
        results.hint("rebalance", F.col("run_id"))
        .write.partitionBy("run_id")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def write_findings_text(results: DataFrame, path: str) -> None:
    """The same as ``.txt`` files, one folder per run and query.

    The text writer ends each file with a line break of its own, so these are read
    back with ``terminated=True``."""
    (
        results.select("run_id", "query_idx", F.col("result").alias("value"))
        .write.partitionBy("run_id", "query_idx")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .text(path)
    )


def write_reports(reports: DataFrame, path: str) -> None:
    """Report Markdown, by run and report type."""
    (
        reports.select("run_id", "report_type", F.col("report").alias("value"))
        .write.partitionBy("run_id", "report_type")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .text(path)
    )


def report_path(directory: Column, report_type: Column) -> Column:
    return quoted_path(fill(fixed.REPORT_FILE, directory=directory, report_type=report_type))


def report_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, report_type, path, stored): which stored file holds the report whose path a run was told."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    path = report_path(F.col("run_id").cast("string"), F.col("report_type"))
    return files.select("run_id", "report_type", path.alias("path"), F.col("path").alias("stored"))


# A run's log lies in one part of the stored log, whatever number of batches wrote it.
LOG_PARTS = 64


def _log_part(run_id: Column) -> Column:
    return F.pmod(F.xxhash64(run_id.cast("string")), F.lit(LOG_PARTS)).cast("int").alias("part")


def _clustered(log: DataFrame) -> DataFrame:
    """Rows of a part come from one task, so a write adds one file a part and not one a task and part."""
    return log.withColumn("part", _log_part(F.col("run_id"))).repartition(LOG_PARTS, "part")


def append_run_log(log: DataFrame, path: str) -> None:
    _clustered(log).write.mode("append").partitionBy("part").parquet(path)


def stream_run_log(log: DataFrame, path: str, checkpoint: str):
    """Append a streaming run log; returns the started query.

    The sink's own log names the files of each batch, so a batch that is written again is read once."""
    return (
        _clustered(log)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .partitionBy("part")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_run_log(spark: SparkSession, path: str, run_id: str | int | None = None) -> DataFrame:
    """The stored log, or that of one run, which is read from its own part."""
    log = spark.read.parquet(path)
    if run_id is not None:
        part = spark.range(1).select(_log_part(F.lit(str(run_id)))).head()[0]
        log = log.where((F.col("part") == part) & (F.col("run_id").cast("string") == str(run_id)))
    return log.drop("part")
