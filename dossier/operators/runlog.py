"""The log of a run, its duration, and memory records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import fixed_values as fixed
from dossier.functions.text import duration_text, fill, interval_micros


def log_rows(
    df: DataFrame, phase: int, stage_no: int, stage: str, output: Column, query_idx=None, seq=None, kind="logs"
) -> DataFrame:
    """One stage's lines; a run's log reads in (phase, query_idx, stage_no, seq) order, so a query
    is through all its stages before the next one starts."""
    number = lambda c: (F.lit(0) if c is None else F.col(c)).cast("bigint")
    return df.select(
        "run_id",
        F.lit(phase).alias("phase"),
        F.lit(stage_no).alias("stage_no"),
        F.lit(stage).alias("stage"),
        number(query_idx).alias("query_idx"),
        number(seq).alias("seq"),
        F.lit(kind).alias("type"),
        output.alias("output"),
    )


def run_log(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def run_duration(events: DataFrame) -> DataFrame:
    """Microseconds and text from the first to the last event of each run."""
    micros = interval_micros(F.col("end_ts") - F.col("start_ts"))
    return (
        events.groupBy("run_id")
        .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
        .withColumn("micros", micros)
        .select(
            "run_id",
            "micros",
            fill(fixed.LOG_RUN_TIME, duration=duration_text(F.col("micros"))).alias("output"),
        )
    )


def memory_records(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """A raw and a summary record per chunk, tagged with source and 1-based part."""
    part = F.col("part") + 1
    keys = ["run_id", "query_idx", "url", "part"]
    raw = chunks.select(
        *keys,
        F.lit("raw").alias("kind"),
        fill(fixed.MEMORY_RAW, url=F.col("url"), part=part, chunk=F.col("chunk")).alias("record"),
    )
    summed = summaries.select(
        *keys,
        F.lit("summary").alias("kind"),
        fill(
            fixed.MEMORY_SUMMARY, url=F.col("url"), part=part, summary=F.col("summary")
        ).alias("record"),
    )
    return raw.unionByName(summed)


def concept_lines(replies: DataFrame, keys: list[str]) -> DataFrame:
    """The line that shows a model's reply with the concepts of a lesson."""
    return replies.select(*keys, fill(fixed.LOG_CONCEPTS, reply=F.col("reply")).alias("output"))
