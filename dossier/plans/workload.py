"""Inputs of the catalogue's queries, derived by Spark from the given tables.

The given tables hold documents, pages, task texts, conversations and events, but no
requests, replies, prompts or deltas.  Each function here forms one of those from whole
tables; none drops rows to make a query smaller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AGENTS = [
    "Finance Agent",
    "Travel Agent",
    "Academic Research Agent",
    "Business Analyst",
    "Computer Security Analyst Agent",
    "Default Agent",
    "Auto Agent",
    "Gardening Agent",
]
REPORT_TYPES = ["research_report", "resource_report", "outline_report", "poem"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(options: list[str], number) -> F.Column:
    return F.array(*[F.lit(o) for o in options])[F.pmod(number, F.lit(len(options))).cast("int")]


def start_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, message), one per turn.

    User turns are start messages.  System turns are start messages from a client that
    does not close its JSON.  Assistant turns are sent as they are and start nothing.
    A user turn past the fifth leaves its agent out; one that follows the start of a
    conversation names an empty report type where its text has a line break.
    """
    turns = table(spark, sf_dir, "conversations")
    size = F.length("text")
    report_type = F.when(
        (F.col("turn") > 0) & F.contains("text", F.lit("\n")), ""
    ).otherwise(_choice(REPORT_TYPES, size))
    body = F.to_json(
        F.struct(
            F.col("text").alias("task"),
            report_type.alias("report_type"),
            F.when(F.col("turn") <= 5, _choice(AGENTS, size)).alias("agent"),
        )
    )
    return turns.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", F.concat(F.lit("start "), body))
        .when(F.col("role") == "system", F.concat(F.lit("start "), F.regexp_replace(body, r"\}$", "")))
        .otherwise(F.col("text"))
        .alias("message"),
    )


def list_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, reply): assistant turns answer with a JSON array of their lines,
    the others with their bare text."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "assistant", F.to_json(F.split("text", "\n")))
        .otherwise(F.col("text"))
        .alias("reply"),
    )


def concept_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, reply): English documents answer with a JSON array of their lines."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", F.to_json(F.split("text", "\n")))
        .otherwise(F.col("text"))
        .alias("reply"),
    )


def role_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, reply): user turns answer with a role object, with its prompt
    only on the first two turns and its agent only where the text has one line; system turns
    have no reply at all, and assistant turns answer with bare text."""
    role = F.struct(
        F.when(~F.contains("text", F.lit("\n")), _choice(AGENTS, F.length("text"))).alias("agent"),
        F.when(F.col("turn") <= 1, F.col("text")).alias("agent_role_prompt"),
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", F.to_json(role))
        .when(F.col("role") == "assistant", F.col("text"))
        .alias("reply"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, task, report_type, agent, agent_role_prompt, reply), one per task text.

    The reply is a JSON array of four word windows that cover the whole text.  By the length
    of their task some models reply with an empty list, and some with prose behind the list."""
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    tasks = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("run_id"), F.col("text").alias("task"), words.alias("w")
    )
    per = F.ceil(F.size("w") / 4).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: F.array_join(F.slice("w", i * per + 1, per), " ")
    )
    kind = F.length("task") % 8
    listed = F.to_json(windows)
    return tasks.select(
        "run_id",
        "task",
        _choice(REPORT_TYPES, F.length("task")).alias("report_type"),
        _choice(AGENTS, F.col("run_id")).alias("agent"),
        F.lit(None).cast("string").alias("agent_role_prompt"),
        F.when(kind == 0, "[]").when(kind == 1, F.concat(listed, F.lit(" as you asked."))).otherwise(listed).alias("reply"),
    )


def run_role_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, reply): a role for every task, with the task in its prompt."""
    role = F.struct(F.lit("Travel Agent").alias("agent"), F.concat(F.lit("Guide: "), "text").alias("agent_role_prompt"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("run_id"), F.to_json(role).alias("reply"))


def other_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, query_idx, rank, url): one more hit of each run's first query, without
    a URL or with one that was not crawled, by the length of its task."""
    absent = F.concat(F.lit("https://absent.example.org/"), F.col("item_id").cast("string"))
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("run_id"),
        F.lit(0).cast("bigint").alias("query_idx"),
        F.lit(5).alias("rank"),
        F.when(F.length("text") % 3 > 0, absent).alias("url"),
    )


def odd_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): documents in markup that is valid but unusual: headings that hold
    blocks, text behind them, and references by number with leading zeros or from Windows."""
    docs = table(spark, sf_dir, "documents")
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&#00000038;")), F.lit("<"), F.lit("&#x3c;"))
    first = F.substring_index(escaped, "\n", 1)
    return docs.select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(
            F.lit("<html><body><h2><div>"),
            first,
            F.lit("</div> &#150; <ul><li>&#146;s</li></ul>tail</h2><p>"),
            escaped,
            F.lit("<div>unseen</div></body></html>"),
        ).alias("html"),
    )


def wrapped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): documents as pages; English text sits in a paragraph,
    other text in a table cell, which holds no page text."""
    docs = table(spark, sf_dir, "documents")
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    english = F.col("lang") == "en"
    return docs.select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(
            F.lit("<html><body>"),
            F.when(english, "<p>").otherwise("<table><tr><td>"),
            escaped,
            F.when(english, "</p>").otherwise("</td></tr></table>"),
            F.lit("</body></html>"),
        ).alias("html"),
    )


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, model, max_tokens, stream, target): one call per document."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("lang") != "es", F.lit("gpt-4")).alias("model"),
        F.when(F.col("lang") != "fr", F.col("n_chars")).alias("max_tokens"),
        (F.col("lang") != "en").alias("stream"),
        F.when(F.col("lang") == "fr", F.col("source")).alias("target"),
    )


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, seq, delta, is_end): each turn as a response cut at word boundaries.

    A response opens with a null delta, as model streams do, and its last row is the
    end marker."""
    pieces = F.concat(
        F.array(F.lit(None).cast("string")),
        F.regexp_extract_all("text", F.lit("[^ ]+ *| +"), F.lit(0)),
        F.array(F.lit(None).cast("string")),
    )
    return (
        table(spark, sf_dir, "conversations")
        .select(
            F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("run_id"), pieces.alias("pieces")
        )
        .select("run_id", "pieces", F.size("pieces").alias("n"))
        .select("run_id", "n", F.posexplode_outer("pieces").alias("seq", "delta"))
        .select(
            "run_id",
            F.col("seq").cast("bigint").alias("seq"),
            "delta",
            (F.col("seq") == F.col("n") - 1).alias("is_end"),
        )
    )


def run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, ts): events of a user as the log times of a run."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts")
