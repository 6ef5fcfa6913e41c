"""Summaries to findings, findings to query results and research summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import fixed_values as fixed
from dossier.functions.ordered import ordered_concat
from dossier.functions.text import fill, word_count
from dossier.operators import prompts
from dossier.operators.pages import PAGE_MISSING
from dossier.settings import DEFAULTS, JobSettings

VISIT = ["run_id", "query_idx", "url"]
# Chunks joined per task before the final join of a page's summaries.
BLOCK = 1024


def combined_summary(
    summaries: DataFrame, keys: list[str] = VISIT, dense: bool = False, errors: str | None = None
) -> DataFrame:
    """Chunk summaries of one visit joined by line breaks in part order.  ``dense`` says that there is a row for every part from 0;
    with ``errors``, the column of that name, the error of the first failed part comes out as ``_failed``."""
    return ordered_concat(summaries, keys, "part", "summary", "\n", "combined", BLOCK, dense, errors)


def finding_status(lookups: DataFrame, summaries: DataFrame) -> DataFrame:
    """One finding per visit.  ``summaries`` has VISIT columns, summary and error.

    A missing page or a failed call gives an error text in place; a page without
    text gives a fixed message, wrapped like any other finding.  Both sides have
    one row per visit."""
    joined = lookups.join(summaries.select(*VISIT, "summary", "error"), VISIT, "left")
    error = F.coalesce("error", F.when(F.col("status") == "no_page", PAGE_MISSING))
    summary = F.when(F.col("status") == "empty_text", fixed.NO_TEXT).otherwise(F.col("summary"))
    status = F.when(F.col("error").isNotNull(), "error").otherwise(F.col("status"))
    content = (
        F.when(F.col("status") == "no_url", fixed.NO_URL)
        .when(error.isNotNull(), fill(fixed.FINDING_ERROR, url=F.col("url"), error=error))
        .otherwise(fill(fixed.FINDING_OK, url=F.col("url"), summary=summary))
    )
    return joined.select(
        "run_id", "query_idx", "rank", "url", status.alias("status"), content.alias("content")
    )


def topic_calls(texts: DataFrame, keys: list[str], text: str, topic: str, settings: JobSettings = DEFAULTS) -> DataFrame:
    """One call per whole text for its topic, without chunks, with the line that the log gets
    for it."""
    messages = prompts.summary_messages(F.col(text), F.col(topic))
    line = fill(fixed.LOG_SUMMARIZING, text=F.col(text)).alias("output")
    return prompts.call_table(texts.select(*keys, line, messages.alias("messages")), settings.fast_model, settings)


def query_findings(queries: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of one query joined in rank order; a query without any has ''."""
    joined = ordered_concat(findings, ["run_id", "query_idx"], "rank", "content", "\n", "result")
    return (
        queries.select("run_id", "query_idx", "query")
        .join(joined, ["run_id", "query_idx"], "left")
        .withColumn("result", F.coalesce("result", F.lit("")))
    )


def research_summary(results: DataFrame) -> DataFrame:
    """Each query's result followed by a blank line, in query order, per run."""
    padded = results.withColumn("_padded", F.concat("result", F.lit("\n\n")))
    return ordered_concat(padded, ["run_id"], "query_idx", "_padded", "", "research_summary")


def research_word_count(results: DataFrame) -> DataFrame:
    """Words of each run's research summary.

    A split on single spaces has one piece more than there are spaces, so the spaces
    of the stored results are added up and the long summary need not be built."""
    spaces = word_count(F.col("result")) - 1
    return results.groupBy("run_id").agg((F.sum(spaces) + 1).cast("bigint").alias("n_words"))
