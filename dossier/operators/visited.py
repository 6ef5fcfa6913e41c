"""Which query owns a URL, and what a run visited."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_visits(hits: DataFrame) -> DataFrame:
    """The first query, then rank, of a run that surfaces a URL keeps it.

    The top-k cut comes before this, so a later query may keep fewer hits.  Query and
    rank are packed into one number, whose minimum is hashed and combined before the
    shuffle: a URL or run with a large share of all hits costs one row per task.
    The hits of a run that have no URL are one visit, which fails later on.
    """
    place = F.shiftleft(F.col("query_idx").cast("bigint"), 32) + F.col("rank")
    return (
        hits.groupBy("run_id", "url")
        .agg(F.min(place).alias("_place"), F.min_by("score", place).alias("score"))
        .select(
            "run_id",
            F.shiftright("_place", 32).alias("query_idx"),
            F.col("_place").bitwiseAND(0xFFFFFFFF).alias("rank"),
            "url",
            "score",
        )
    )


def unvisited(hits: DataFrame, history: DataFrame) -> DataFrame:
    """First visits that a stored (run_id, url) history does not hold yet."""
    return first_visits(hits.join(history.select("run_id", "url"), ["run_id", "url"], "left_anti"))


def source_ledger(findings: DataFrame, page_chunks: DataFrame) -> DataFrame:
    """Per run and URL: owning query, status, chunks read and characters read."""
    sizes = page_chunks.groupBy("url").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("chunk")).cast("bigint").alias("n_chars")
    )
    return (
        findings.groupBy("run_id", "url")
        .agg(F.min("query_idx").alias("query_idx"), F.min("status").alias("status"))
        .join(sizes, "url", "left")
        .select(
            "run_id",
            "url",
            "query_idx",
            "status",
            F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
            F.coalesce("n_chars", F.lit(0)).alias("n_chars"),
        )
    )
