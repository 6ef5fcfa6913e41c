"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import schemas
from dossier.functions.ordered import ordered_concat


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGE).parquet(path)


def spread(table: DataFrame, key: str, partitions: int | None) -> DataFrame:
    """Rows over ``partitions`` tasks by key, for work that is heavy per row in a table of few files; with None, or if it is read by as
    many tasks already, the table is left as it is stored and nothing is shuffled.  ``table`` should be a stored one."""
    if partitions is None or table.rdd.getNumPartitions() >= partitions:
        return table
    return table.repartition(partitions, key)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """One start message per line of text files."""
    return spark.read.text(path).withColumnRenamed("value", "message")


def stream_messages(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .text(path)
        .withColumnRenamed("value", "message")
    )


def stream_deltas(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schemas.DELTA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def read_findings(spark: SparkSession, path: str, run_type: str = "bigint") -> DataFrame:
    """(run_id, query_idx, result) as ``sinks.outputs.write_findings`` stored them; ``run_id`` is a folder's
    name there, so its type is given."""
    return spark.read.schema(f"query_idx bigint, result string, run_id {run_type}").parquet(path).select(
        "run_id", "query_idx", "result"
    )


def read_txt_findings(
    spark: SparkSession, folders: str, run_pattern: str = r"([^/]+)/[^/]*$", terminated: bool = False
) -> DataFrame:
    """(run_id, all_text): the ``.txt`` files directly in the matching folders, in path
    order, each followed by a line break.  Numbers in a path count by their value, so the
    file of query 10 follows that of query 9.

    ``folders`` may hold wildcards; ``run_pattern`` takes the run out of a file's path, by
    default its folder's name.  With ``terminated``, a file's last line break belongs
    to its writer and not to the text.
    """
    value = F.regexp_replace("value", r"\n\z", "") if terminated else F.col("value")
    files = (
        spark.read.option("pathGlobFilter", "*.txt")
        .text(folders, wholetext=True)
        .select(
            F.regexp_extract("_metadata.file_path", run_pattern, 1).alias("run_id"),
            F.col("_metadata.file_path").alias("path"),
            F.concat(value, F.lit("\n")).alias("text"),
        )
    )
    padded = F.transform(
        F.regexp_extract_all("path", F.lit(r"([0-9]+|[^0-9]+)"), F.lit(0)),
        lambda part: F.when(part.rlike("^[0-9]"), F.lpad(part, 20, "0")).otherwise(part),
    )
    return ordered_concat(files.withColumn("path", F.array_join(padded, "")), ["run_id"], "path", "text", "", "all_text")
