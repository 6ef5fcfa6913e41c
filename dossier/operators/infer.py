"""Batch inference: a user-supplied completion function over a prompt table."""

from __future__ import annotations

import inspect
import json
import re
import sys
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dossier import schemas
from dossier.functions import fixed_values as fixed
from dossier.operators.prompts import validate_calls
from dossier.settings import DEFAULTS, JobSettings
from dossier.sinks.completions import BLOCKS, PARTS, CompletionStore, block, merged_rows
from dossier.sinks.stage import new_folder, save, scratch, stage

# The functions below travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# complete(messages, model, temperature, max_tokens) -> content
Completer = Callable[[list, str, float, "int | None"], str]


@dataclass(frozen=True)
class Quoted:
    """The texts that calls quote: ``texts`` has the columns ``on`` and ``text``, and ``messages`` are those of a call's row, by its column
    ``question`` and the text it is joined with.  Messages are then made in the tasks that send them and stored nowhere.
    ``texts`` must be the same whenever it is read.

    ``shared`` says that many calls quote the same text.  They are dealt to one task, or to several where they are more than its
    share, and the text is moved once for each of these, not once for each call."""

    texts: DataFrame
    on: list[str]
    text: str
    question: str
    messages: Column
    shared: bool = False

    @property
    def reads(self) -> list[str]:
        """Columns of a call's row that are needed to make it."""
        return [*self.on, self.question, "_text", "prompt_id", "model", "temperature", "max_tokens", "_chars", "_row"]

    def mark(self) -> Column:
        """Tells texts apart whose columns ``on`` are equal."""
        return F.xxhash64(self.text).alias("_text")

    def block(self) -> Column:
        """Calls of a block go to one task if they are not too many."""
        return F.pmod(F.xxhash64(*self.on), F.lit(PARTS * BLOCKS)).cast("int") if self.shared else block()

    def joined(self, placed: DataFrame, width: int) -> DataFrame:
        """Calls with their messages in the task that the column ``task`` names.  Both sides are dealt by that column, so the join
        moves nothing."""
        same = [*self.on, "_text"]
        wanted = placed.select("task", *same).distinct()
        texts = self.texts.select(*self.on, self.text, self.mark()).join(wanted, same).repartitionById(width, "task")
        # Texts may be there several times, a call must not.
        texts = texts.dropDuplicates(["task", *same])
        return placed.repartitionById(width, "task").join(texts, ["task", *same]).withColumn("messages", self.messages)


def pending(prompts: DataFrame, stored: DataFrame) -> DataFrame:
    """Prompts with no stored completion, one row per prompt_id."""
    new = prompts.join(stored.select("prompt_id"), "prompt_id", "left_anti")
    return new.dropDuplicates(["prompt_id"])


def prompt_states(ids: DataFrame, rows: DataFrame, run: str) -> DataFrame:
    """``ids``, one row per prompt_id, with what the store's ``rows`` say of it: ``stored`` (anything), ``done`` (a completion),
    ``failed`` (tries) and ``mine`` (one of these by ``run``).  Contents are not read."""
    good = F.col("error").isNull()
    told = rows.groupBy("prompt_id").agg(
        F.max(good).alias("done"),
        F.count_distinct(F.when(~good, F.col("batch"))).alias("failed"),
        F.max(~good & F.col("batch").startswith(run)).alias("mine"),
    )
    return ids.join(told, "prompt_id", "left").select(
        *ids.columns,
        F.col("done").isNotNull().alias("stored"),
        F.coalesce("done", F.lit(False)).alias("done"),
        F.coalesce("failed", F.lit(0)).alias("failed"),
        F.coalesce("mine", F.lit(False)).alias("mine"),
    )


def prompt_chars() -> Column:
    """Characters of a call's messages: what its time and cost grow with."""
    return F.aggregate("messages", F.lit(0).cast("bigint"), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))


def dealt(ids: DataFrame, width: int, by: Column | None = None) -> DataFrame:
    """(block, task, more): which of ``width`` tasks calls the prompts of a block, and how many tasks behind it a block shares that
    is as long as theirs together.

    ``ids`` has prompt_id and chars.  Blocks of a hash are taken in order and cut where their running length passes another
    share of the whole, so a task has at most the mean and one block more.  A block holds prompts of one part of the store, unless
    blocks are made by another number ``by``.  The table has one row per block, a fixed number at most, whatever the number of prompts."""
    sizes = ids.groupBy((block() if by is None else by).alias("block")).agg(F.sum(F.col("chars") + 1).alias("size"))
    before = F.sum("size").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    whole = F.sum("size").over(W.partitionBy())
    place = F.coalesce(before, F.lit(0)).cast("decimal(38,0)") * width / whole
    task = F.least(F.floor(place), F.lit(width - 1)).cast("int")
    more = F.floor(F.col("size").cast("decimal(38,0)") * width / whole)
    return sizes.select("block", task.alias("task"), F.least(more, width - 1 - task).cast("int").alias("more"))


def complete(
    prompts: DataFrame,
    completer: Completer,
    tasks: int | None = None,
    threads: int = 1,
    lengths: DataFrame | None = None,
    quoted: Quoted | None = None,
) -> DataFrame:
    """(prompt_id, content, error) of each prompt of a stored table.

    ``tasks`` sets how many tasks call at once, by default as many as the cluster runs, and
    ``threads`` how many calls each keeps open.  Prompts are dealt by their length (:func:`dealt`), not by their number.
    A call that raises gives a row with its error; the others go on.  The function may
    retry by itself.  One with a parameter ``attempt`` is told the how-manieth try of its prompt it is, by the column ``attempt``.
    ``lengths`` (prompt_id, chars), where it is stored already, saves reading the messages once for their length.
    With ``quoted``, prompts have ``chars`` and the columns that join them with their texts, in place of messages.
    """
    counted = "attempt" in inspect.signature(completer).parameters

    def call(row: dict) -> dict:
        made = {"prompt_id": row["prompt_id"], "content": None, "error": None}
        try:
            more = {"attempt": row["attempt"]} if counted else {}
            made["content"] = completer(row["messages"], row["model"], row["temperature"], row["max_tokens"], **more)
        except Exception as failure:  # one failing call must not end the job
            made["error"] = str(failure)
        return made

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([(name, pa.string()) for name in ("prompt_id", "content", "error")])
        with ThreadPoolExecutor(threads) as pool:
            # One call at a time needs no thread of its own, which costs about as much as a short call.
            each = map if threads == 1 else pool.map
            for batch in rows:
                yield pa.RecordBatch.from_pylist(list(each(call, batch.to_pylist())), shape)

    width = tasks or prompts.sparkSession.sparkContext.defaultParallelism
    attempt = F.col("attempt") if "attempt" in prompts.columns else F.lit(1)
    fields = ["prompt_id", "messages", "model", "temperature", "max_tokens", "attempt"]
    if quoted is not None:
        calls = prompts.withColumns({"attempt": attempt, "block": quoted.block()})
        places = dealt(prompts, width, quoted.block())
        # Calls for a long block are dealt over its tasks, others all go to the first.
        place = F.col("task") + (F.pmod(F.xxhash64("prompt_id"), F.col("more") + 1) if quoted.shared else F.lit(0))
        placed = calls.join(F.broadcast(places), "block").withColumn("task", place.cast("int"))
        return quoted.joined(placed, width).select(*fields).mapInArrow(batches, schemas.COMPLETION)
    calls = prompts.select(*fields[:-1], attempt.alias("attempt"), block().alias("block"))
    if lengths is None:
        lengths = prompts.select("prompt_id", prompt_chars().alias("chars"))
    places = dealt(lengths, width)
    # At most PARTS * BLOCKS rows of two numbers.
    placed = calls.join(F.broadcast(places), "block").repartitionById(width, "task").drop("block", "task", "more")
    return placed.mapInArrow(batches, schemas.COMPLETION)


# A store of more segments is compacted before it is used.
SEGMENTS = 16


def completion_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored completions, one row per prompt_id."""
    return CompletionStore(spark, path).completions()


def complete_stored(
    prompts: DataFrame, completer: Completer, path: str, cap: int = DEFAULTS.max_tokens_cap, quoted: Quoted | None = None, **calling
) -> DataFrame:
    """``prompts`` with content and error.  Calls that may be sent (:func:`prompts.validate_calls`) are completed as
    :func:`complete_valid` says, which takes ``calling``; the others come back with the reason they may not."""
    checked = validate_calls(
        prompts.withColumns({"stream": F.lit(False), "target": F.lit(None).cast("string")}), JobSettings(max_tokens_cap=cap)
    )
    checked = checked.withColumnRenamed("error", "_refused").drop("stream", "target", "accepted")
    done = complete_valid(checked.where(F.col("_refused").isNull()).drop("_refused"), completer, path, quoted=quoted, **calling)
    refused = checked.where(F.col("_refused").isNotNull())
    if quoted is not None:
        refused = refused.drop("messages", quoted.text)
    return done.unionByName(
        refused.withColumnsRenamed({"_refused": "error"}).withColumn("content", F.lit(None).cast("string"))
    )


def complete_valid(
    prompts: DataFrame,
    completer: Completer,
    path: str,
    tasks: int | None = None,
    threads: int = 1,
    waves: int = 1,
    attempts: int = 1,
    pause: float = 1.0,
    give_up: int | None = None,
    quoted: Quoted | None = None,
) -> DataFrame:
    """Complete what ``path`` does not hold, append it there, and return ``prompts``
    with content and error.

    Prompts are staged, so they are worked out once.  Calls are written to the store as soon as
    they are made, failed ones too; what follows reads what was written, and only the parts of the store that the
    prompts' ids fall in.  A long list of calls can be made in several ``waves``, each stored before the next starts, so
    that a job that ends early keeps what it has paid for.

    A failed call is sent again up to ``attempts`` times in all, in rounds after a ``pause`` in seconds that doubles
    each time.  The store counts failures over all runs.  After ``give_up`` of them a prompt is a dead letter
    (``CompletionStore.dead_letters``): it is not sent any more and comes back with its last error.  Other failed calls come back
    with their error of this run, and a later run sends them again.

    With ``quoted``, whose text is a column of the prompts too, prompts are worked out for their ids and lengths and staged without messages and
    texts; what is returned lacks these as well.
    """
    spark = prompts.sparkSession
    store = CompletionStore(spark, path)
    if len(store.segments()) > SEGMENTS:
        store.compact()
    run = f"{time.time_ns():020}-{uuid.uuid4().hex}"  # later runs sort behind earlier ones
    prompts = prompts.withColumns({"_row": F.monotonically_increasing_id(), "_chars": prompt_chars()})
    if quoted is not None:
        prompts = prompts.withColumn("_text", quoted.mark()).drop("messages", quoted.text)
        unread = [name for name in prompts.columns if name not in quoted.reads]
    asked = stage(prompts, "prompts")
    parts = store.parts_of(asked)
    # One row stands for all of its prompt, so that messages need not be shuffled to drop repeats.
    ids = asked.groupBy("prompt_id").agg(F.min("_row").alias("_row"), F.min("_chars").alias("chars"))
    before = store.segments()
    stored_ids, any_stored = new_folder(spark, "stored-ids"), False
    with scratch(spark, "pending"):
        for turn in range(max(1, attempts)):
            state = prompt_states(ids, store.rows(parts, None if turn else before), run)
            state = stage(state.where("mine") if turn else state, "pending-ids")
            if not turn:
                stored = state.where("stored").select("prompt_id")
                if any_stored := bool(stored.head(1)):
                    save(stored, stored_ids)
            due = state.where("not done" if give_up is None else f"not done and failed < {give_up}")
            if turn:
                if not due.head(1):
                    break
                time.sleep(pause * 2 ** (turn - 1))
            due = due.select("prompt_id", "_row", "chars", (F.col("failed") + 1).alias("attempt"))
            for wave in range(waves):
                now = due.where(F.pmod(F.xxhash64("prompt_id", F.lit("wave")), F.lit(waves)) == wave) if waves > 1 else due
                calls = asked.join(now.select("_row", "attempt"), "_row").withColumnRenamed("_chars", "chars")
                if quoted is not None:
                    # Rows without messages, which are read several times to deal them.
                    calls = stage(calls.drop(*unread, "_row"), "calls")
                made = complete(calls, completer, tasks, threads, now.select("prompt_id", "chars"), quoted)
                store.append(made.withColumn("batch", F.lit(f"{run}-{turn:04}")))
    # Of the segments there were before, only rows of these prompts are moved, and none if there are no such rows.
    after = store.segments()
    rows = store.rows(parts, [s for s in after if s not in before])
    if any_stored:
        stored = spark.read.schema(stored.schema).parquet(stored_ids)
        rows = rows.unionByName(store.rows(parts, [s for s in after if s in before]).join(stored, "prompt_id", "left_semi"))
    known = merged_rows(rows.repartition("prompt_id"), run).select("prompt_id", "content", "error")
    return asked.drop("_row", "_chars", "_text").join(known, "prompt_id", "left")


def _quoted_prompts() -> list[tuple[str, str, str, int, str]]:
    """Of each prompt that quotes a text and asks a question: its three fixed pieces, and how many
    sentences answer it, joined by what."""
    templates = [(fixed.SUMMARY_PROMPT, 3, ". "), *((t, 5, ".\n") for t in fixed.REPORT_PROMPTS.values())]
    return [(*re.split(r"\{\w+\}", template)[:3], keep, joint) for template, keep, joint in templates]


def extractive_completer() -> Completer:
    """Offline stand-in for a model, for tests and repeatable runs.

    It answers a quoted text by the sentences of the whole text that share most words with the question, as
    :func:`dossier.functions.text.extractive_summary` does; a call for search queries by four runs
    of the question's words, and a call for a role by a fixed agent with the task in its prompt."""
    quoted = _quoted_prompts()
    asks_queries = re.split(r"\{\w+\}", fixed.QUERY_PROMPT)
    asks_role = fixed.ROLE_CHOICE_TASK.split("{task}")[0]
    role_system = fixed.ROLE_CHOICE_PROMPT

    word, digit = re.compile(r"[^\W_]+"), re.compile("[0-9]")
    apart = str.maketrans({chr(i): " " for i in range(128) if not chr(i).isalnum()})

    def words(text: str) -> set:
        low = text.lower()
        # The same words either way; a pattern takes several times as long.
        return set(low.translate(apart).split() if low.isascii() else word.findall(low))

    def answer(messages: list, model: str, temperature: float, max_tokens: int | None) -> str:
        content = messages[-1]["content"]
        if messages[0]["role"] == "system" and messages[0]["content"] == role_system:
            task = content[len(asks_role) :]
            return json.dumps({"agent": "Travel Agent", "agent_role_prompt": "Guide: " + task}, ensure_ascii=False)
        if content.startswith(asks_queries[0]) and content.endswith(asks_queries[1]):
            parts = content[len(asks_queries[0]) : -len(asks_queries[1])].split()
            per = -(-len(parts) // 4)
            return json.dumps([" ".join(parts[i * per : (i + 1) * per]) for i in range(4)], ensure_ascii=False)
        for head, middle, tail, keep, joint in quoted:
            if content.startswith(head) and middle in content and content.endswith(tail):
                cut = content.rindex(middle)
                text, question = content[len(head) : cut], content[cut + len(middle) : len(content) - len(tail)]
                break
        else:
            text, question, keep, joint = content, content, 3, ". "
        wanted = words(question)
        pieces = [s for s in (piece.strip(" ") for piece in re.split(r"[.\n]+", text)) if s]
        score = lambda s: len(wanted & words(s)) + bool(digit.search(s))
        best = sorted(range(len(pieces)), key=lambda i: (-score(pieces[i]), i))
        return joint.join(pieces[i] for i in sorted(best[:keep]))

    return answer
