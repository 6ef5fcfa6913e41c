"""Prompts as columns and tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import fixed_values as fixed
from dossier.functions.text import fill, literal_table
from dossier.settings import DEFAULTS, JobSettings


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def summary_messages(chunk: Column, question: Column) -> Column:
    return F.array(message("user", fill(fixed.SUMMARY_PROMPT, chunk=chunk, question=question)))


def role_messages(role_prompt: Column, action: Column) -> Column:
    return F.array(message("system", role_prompt), message("user", action))


def query_prompt(question: Column) -> Column:
    return fill(fixed.QUERY_PROMPT, question=question)


def concept_prompt(question: Column, research_summary: Column) -> Column:
    return fill(fixed.CONCEPT_PROMPT, question=question, research_summary=research_summary)


def lesson_prompt(concept: Column) -> Column:
    return fill(fixed.LESSON_PROMPT, concept=concept)


def role_choice_messages(task: Column) -> Column:
    return role_messages(
        F.lit(fixed.ROLE_CHOICE_PROMPT), fill(fixed.ROLE_CHOICE_TASK, task=task)
    )


def report_types(spark) -> DataFrame:
    """The fixed report types, each prompt cut at its two slots."""
    rows = [
        (name, *re.split(r"\{\w+\}", template)) for name, template in fixed.REPORT_PROMPTS.items()
    ]
    names = ["report_type", "before_summary", "before_question", "after_question"]
    return literal_table(spark, names, rows)


def resolve_report_type(requests: DataFrame) -> DataFrame:
    """Requests with ``known``: whether their report type exists (three fixed rows)."""
    types = F.broadcast(report_types(requests.sparkSession).select("report_type", F.lit(True).alias("known")))
    return requests.join(types, "report_type", "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )


def report_prompts(runs: DataFrame) -> DataFrame:
    """(run_id, report_type, role_prompt, report_prompt) of runs that have task and
    research_summary.  A type that does not exist gives no prompt."""
    types = F.broadcast(report_types(runs.sparkSession))
    return runs.join(types, "report_type").select(
        "run_id",
        "report_type",
        "role_prompt",
        F.concat(
            "before_summary", "research_summary", "before_question", "task", "after_question"
        ).alias("report_prompt"),
    )


def call_table(prompts: DataFrame, model: str, settings: JobSettings = DEFAULTS) -> DataFrame:
    """Add the call fields and ``prompt_id``, the digest of all of them."""
    called = (
        prompts.withColumn("model", F.lit(model))
        .withColumn("temperature", F.lit(settings.temperature))
        .withColumn("max_tokens", F.lit(None).cast("int"))
    )
    call = F.struct("messages", "model", "temperature", "max_tokens")
    return called.withColumn("prompt_id", F.sha2(F.to_json(call), 256))


def validate_calls(calls: DataFrame, settings: JobSettings = DEFAULTS) -> DataFrame:
    """Calls with ``accepted`` and the first failed check.  ``stream`` and ``target``
    are the columns of the streaming check."""
    over = F.col("max_tokens") > settings.max_tokens_cap
    error = (
        F.when(F.col("model").isNull(), fixed.MODEL_MISSING)
        .when(over, fill(fixed.MAX_TOKENS_OVER, max_tokens=F.col("max_tokens")))
        .when(F.col("stream") & F.col("target").isNull(), fixed.STREAM_TARGET_MISSING)
    )
    return calls.withColumn("error", error).withColumn("accepted", F.col("error").isNull())


def require_valid(calls: DataFrame, settings: JobSettings = DEFAULTS) -> DataFrame:
    """The calls as they are; the job fails with the first failed check instead."""
    checked = validate_calls(calls, settings)
    failing = F.raise_error(F.col("error")).cast("boolean")
    return checked.where(F.when(F.col("accepted"), True).otherwise(failing)).select(*calls.columns)
