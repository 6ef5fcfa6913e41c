"""The named queries: each takes a session and a folder of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import fixed_values as fixed
from dossier.functions.text import extractive_summary
from dossier.operators import (
    assemble,
    infer,
    pages,
    prompts,
    requests,
    runlog,
    search,
    visited,
)
from dossier.operators import report_text as reporting
from dossier.operators.index import SearchIndex
from dossier.plans import workload as given
from dossier.plans.research import ResearchRun, choose_agents, plan_queries
from dossier.settings import DEFAULTS
from dossier.sinks import outputs
from dossier.sinks.completions import CompletionStore
from dossier.sinks.stage import new_folder, stage
from dossier.sources.page_store import store_page_texts
from dossier.sources.tables import read_findings, read_txt_findings, spread, stream_deltas
from dossier.streaming.deltas import stream_report_messages
from dossier.streaming.runs import ResearchStream
from dossier.streaming.state import disk_state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# The given tables are one file each, so work that is heavy per row is dealt out.
TASKS = 16


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(given.table(spark, sf_dir, "pages"), "page_id", TASKS)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(given.table(spark, sf_dir, "documents"), "doc_id", TASKS)


def _research(spark: SparkSession, sf_dir: str, inferred: bool = False) -> ResearchRun:
    """The given tasks as runs with their agents settled; ``inferred`` has all summaries written
    by calls of a Python completer instead of expressions."""
    asked = given.runs(spark, sf_dir).drop("agent_role_prompt").withColumnRenamed("reply", "queries")
    settled = requests.settle_agents(asked, given.run_role_replies(spark, sf_dir), ["run_id"])
    runs = settled.withColumnRenamed("queries", "reply")
    return ResearchRun(
        runs,
        given.table(spark, sf_dir, "pages"),
        completer=infer.extractive_completer() if inferred else None,
        store=new_folder(spark, "store") if inferred else None,
        more_hits=given.other_hits(spark, sf_dir),
        partitions=TASKS,
    )


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.validate(requests.ingest(given.start_messages(spark, sf_dir))).where("accepted")


# --- requests and roles ---------------------------------------------------


@query
def request_ingest(spark, sf_dir):
    return requests.ingest(given.start_messages(spark, sf_dir))


@query
def request_validate(spark, sf_dir):
    return requests.validate(requests.ingest(given.start_messages(spark, sf_dir))).select(
        "conv_id", "turn", "accepted", "error"
    )


@query
def report_type_resolve(spark, sf_dir):
    return prompts.resolve_report_type(_accepted(spark, sf_dir)).select(
        "conv_id", "turn", "report_type", "known"
    )


@query
def role_resolve(spark, sf_dir):
    named = requests.auto_role(given.role_replies(spark, sf_dir))
    return requests.resolve_role(named).select("conv_id", "turn", "agent", "role_prompt")


@query
def auto_role(spark, sf_dir):
    return requests.auto_role(given.role_replies(spark, sf_dir))


@query
def settled_agents(spark, sf_dir):
    """Requests with the agent that will run them, chosen by the model where asked to."""
    messages = requests.ingest(given.start_messages(spark, sf_dir))
    settled = requests.settle_agents(messages, given.role_replies(spark, sf_dir), ["conv_id", "turn"])
    return requests.validate(settled).select(
        "conv_id", "turn", "agent", "agent_role_prompt", "accepted", "error"
    )


@query
def query_fanout(spark, sf_dir):
    return requests.list_fanout(given.list_replies(spark, sf_dir), "query")


@query
def concept_fanout(spark, sf_dir):
    return requests.list_fanout(given.concept_replies(spark, sf_dir), "concept")


# --- pages ----------------------------------------------------------------


@query
def page_text(spark, sf_dir):
    return pages.page_text(_pages(spark, sf_dir))


@query
def odd_page_text(spark, sf_dir):
    return pages.page_text(given.odd_pages(spark, sf_dir)).select("page_id", "text")


@query
def page_links(spark, sf_dir):
    return pages.page_links(_pages(spark, sf_dir))


@query
def page_top_links(spark, sf_dir):
    return pages.page_top_links(_pages(spark, sf_dir))


@query
def text_chunks(spark, sf_dir):
    return pages.text_chunks(given.table(spark, sf_dir, "documents"), ["doc_id"])


@query
def empty_text_findings(spark, sf_dir):
    """A page without text gets the fixed message and no model call."""
    texts = stage(pages.page_text(given.wrapped_documents(spark, sf_dir)), "page-text")
    visits = given.wrapped_documents(spark, sf_dir).select(
        F.col("page_id").alias("run_id"), F.lit(0).alias("query_idx"), F.lit(1).alias("rank"), "url"
    )
    lookups = pages.page_lookup(visits, texts)
    summed = lookups.where(F.col("status") == "ok").select(
        *assemble.VISIT,
        extractive_summary(F.col("text"), F.lit("")).alias("summary"),
        F.lit(None).cast("string").alias("error"),
    )
    return assemble.finding_status(lookups, summed).select("run_id", "url", "status", "content")


# --- search ---------------------------------------------------------------


@query
def term_stats(spark, sf_dir):
    """Document frequency and occurrences per word, with the corpus size and mean length."""
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("doc_key"), "text")
    size = search.corpus_size(search.lengths(docs))
    return search.term_stats(search.postings(docs)).select(
        "*", size.select("n_docs").scalar().alias("n_docs"), F.round(size.select("avg_dl").scalar(), 6).alias("avg_dl")
    )


@query
def index_append(spark, sf_dir):
    """The same statistics from an index that grew in three steps, each handed some documents again, and was compacted between."""
    index = SearchIndex(spark, new_folder(spark, "index"))
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("doc_key"), "text", F.pmod("doc_id", F.lit(3)).alias("third"))
    for step in range(3):
        index.append(docs.where(F.col("third") <= step))
        if step == 1:
            index.compact()
    size = index.size()
    return index.term_stats().select(
        "*", size.select("n_docs").scalar().alias("n_docs"), F.round(size.select("avg_dl").scalar(), 6).alias("avg_dl")
    )


def _document_hits(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    tasks = given.table(spark, sf_dir, "benchmark")
    return search.search_topk(
        docs.select(F.col("doc_id").alias("doc_key"), "text"),
        tasks.select("item_id", F.col("text").alias("query")),
        ["item_id"],
    )


@query
def search_topk(spark, sf_dir):
    return _document_hits(spark, sf_dir).select(
        "item_id",
        F.col("doc_key").alias("doc_id"),
        "score",
        F.col("rank").cast("bigint").alias("rank"),
    )


@query
def hits_json(spark, sf_dir):
    docs = given.table(spark, sf_dir, "documents")
    hits = stage(_document_hits(spark, sf_dir), "found").select(
        "item_id",
        "rank",
        F.concat(F.lit("https://example.org/"), F.col("doc_key").cast("string")).alias("url"),
        F.col("doc_key").alias("doc_id"),
    )
    titled = hits.join(
        docs.select("doc_id", F.substring_index("text", ".", 1).alias("title")), "doc_id"
    )
    return search.hits_json(titled, ["item_id"])


@query
def unvisited_urls(spark, sf_dir):
    return _research(spark, sf_dir).visits.select(
        "run_id",
        F.col("query_idx").cast("bigint").alias("query_idx"),
        F.col("rank").cast("bigint").alias("rank"),
        "url",
        "score",
    )


@query
def unvisited_after_history(spark, sf_dir):
    """New URLs of a run's later queries, given a history its first query left."""
    hits = _research(spark, sf_dir).hits
    history = hits.where(F.col("query_idx") == 0)
    return visited.unvisited(hits.where(F.col("query_idx") > 0), history).select(
        "run_id", "query_idx", F.col("rank").cast("bigint").alias("rank"), "url"
    )


# --- prompts --------------------------------------------------------------


@query
def query_prompts(spark, sf_dir):
    return _accepted(spark, sf_dir).select(
        "conv_id", "turn", prompts.query_prompt(F.col("task")).alias("prompt")
    )


@query
def role_prompts(spark, sf_dir):
    messages = prompts.role_choice_messages(F.col("task"))
    return (
        requests.ingest(given.start_messages(spark, sf_dir))
        .where(F.col("agent") == fixed.AUTO_AGENT)
        .select("conv_id", "turn", F.posexplode(messages).alias("pos", "m"))
        .select(
            "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content"
        )
    )


@query
def lesson_prompts(spark, sf_dir):
    concepts = requests.list_fanout(given.concept_replies(spark, sf_dir), "concept")
    return concepts.where(F.col("error").isNull()).select(
        "doc_id", "concept_idx", prompts.lesson_prompt(F.col("concept")).alias("prompt")
    )


@query
def lessons(spark, sf_dir):
    """A lesson on every concept, written by calls of the smart model and stored."""
    concepts = requests.list_fanout(given.concept_replies(spark, sf_dir), "concept").where(F.col("error").isNull())
    role = F.lit(fixed.ROLE_PROMPTS[fixed.DEFAULT_AGENT])
    messages = prompts.role_messages(role, prompts.lesson_prompt(F.col("concept")))
    calls = prompts.call_table(concepts.select("doc_id", "concept_idx", messages.alias("messages")), DEFAULTS.smart_model)
    done = infer.complete_stored(calls, infer.extractive_completer(), new_folder(spark, "store"))
    return done.select("doc_id", "concept_idx", F.col("content").alias("lesson"), "error")


@query
def prompt_validate(spark, sf_dir):
    return prompts.validate_calls(given.model_calls(spark, sf_dir)).select("doc_id", "accepted", "error")


@query
def chunk_prompts(spark, sf_dir):
    return (
        _research(spark, sf_dir)
        .chunk_prompts.select("run_id", "query_idx", "url", "part", F.explode("messages").alias("m"))
        .select("run_id", "query_idx", "url", "part", "m.role", "m.content")
    )


@query
def report_prompts(spark, sf_dir):
    ready = _research(spark, sf_dir).report_prompts
    messages = prompts.role_messages(F.col("role_prompt"), F.col("report_prompt"))
    return ready.select("run_id", "report_type", F.posexplode(messages).alias("pos", "m")).select(
        "run_id", "report_type", F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content"
    )


@query
def concept_prompts(spark, sf_dir):
    run = _research(spark, sf_dir)
    prompt = prompts.concept_prompt(F.col("task"), F.col("research_summary"))
    return run.runs.join(run.research, "run_id").select("run_id", prompt.alias("prompt"))


# --- batch inference ------------------------------------------------------


def _document_calls(spark, sf_dir):
    docs = pages.text_chunks(given.table(spark, sf_dir, "documents"), ["doc_id", "source"])
    messages = prompts.summary_messages(F.col("chunk"), F.col("source"))
    return prompts.call_table(
        docs.select("doc_id", "part", messages.alias("messages")), DEFAULTS.fast_model
    )


@query
def completions(spark, sf_dir):
    """A Python completer over all chunks of all documents, stored and joined back."""
    done = infer.complete_stored(
        _document_calls(spark, sf_dir), infer.extractive_completer(), new_folder(spark, "store")
    )
    return done.select("doc_id", "part", "prompt_id", "content", "error")


@query
def retried_completions(spark, sf_dir):
    """All chunks of all documents by a completer that fails by the prompt's length: some calls at first, some for good.
    Each is sent three times at most, in rounds; what has failed so often is a dead letter."""
    answer = infer.extractive_completer()

    def completer(messages, model, temperature, max_tokens, attempt):
        if attempt < (1, 2, 3, 9)[len(messages[0]["content"]) % 4]:
            raise RuntimeError(f"busy at try {attempt}")
        return answer(messages, model, temperature, max_tokens)

    path = new_folder(spark, "store")
    done = infer.complete_stored(_document_calls(spark, sf_dir), completer, path, attempts=3, pause=0.1, give_up=3)
    dead = CompletionStore(spark, path).dead_letters(3).select("prompt_id", F.col("tries").cast("bigint").alias("tries"))
    return done.join(dead, "prompt_id", "left").select("doc_id", "part", "content", "error", F.coalesce("tries", F.lit(0).cast("bigint")).alias("tries"))


@query
def pending_prompts(spark, sf_dir):
    """Prompts still to send where a store holds those of the English documents."""
    calls = _document_calls(spark, sf_dir)
    docs = given.table(spark, sf_dir, "documents")
    stored = calls.join(docs.where(F.col("lang") == "en").select("doc_id"), "doc_id").select("prompt_id")
    return infer.pending(calls, stored).select("prompt_id", "model", "temperature")


@query
def chunk_summaries(spark, sf_dir):
    return _research(spark, sf_dir, inferred=True).chunk_summaries.select(*assemble.VISIT, "part", "summary")


@query
def combined_summary(spark, sf_dir):
    """Chunks of 1000 characters, so that most pages have several to combine."""
    run = _research(spark, sf_dir)
    parts = pages.text_chunks(run.texts, ["url"], 1000)
    asked = run.visits.join(run.queries, ["run_id", "query_idx"]).select(*assemble.VISIT, "query")
    summaries = asked.join(parts, "url").select(
        *assemble.VISIT, "part", extractive_summary(F.col("chunk"), F.col("query")).alias("summary")
    )
    return assemble.combined_summary(summaries)


@query
def url_summaries(spark, sf_dir):
    return _research(spark, sf_dir, inferred=True).url_summaries.select(*assemble.VISIT, "summary")


@query
def topic_summaries(spark, sf_dir):
    calls = assemble.topic_calls(given.table(spark, sf_dir, "documents"), ["doc_id"], "text", "lang")
    done = infer.complete_stored(calls, infer.extractive_completer(), new_folder(spark, "store"))
    return done.select("doc_id", F.col("content").alias("summary"), "output")


@query
def reports(spark, sf_dir):
    return _research(spark, sf_dir, inferred=True).reports.select("run_id", "report_type", "report")


# --- assembly -------------------------------------------------------------


@query
def page_lookup(spark, sf_dir):
    return _research(spark, sf_dir).lookups.select(
        "run_id", "query_idx", F.col("rank").cast("bigint").alias("rank"), "url", "page_id", "status", "text"
    )


@query
def page_lookup_stored(spark, sf_dir):
    """The same from a store of the crawl's texts that is bucketed by URL: a lookup moves visits, not texts."""
    run = _research(spark, sf_dir)
    store = store_page_texts(run.page_texts, new_folder(spark, "page-store"), TASKS)
    return pages.page_lookup(run.visits, store).select(
        "run_id", "query_idx", F.col("rank").cast("bigint").alias("rank"), "url", "page_id", "status", "text"
    )


@query
def finding_status(spark, sf_dir):
    return _research(spark, sf_dir).findings.select(
        "run_id", "query_idx", F.col("rank").cast("bigint").alias("rank"), "url", "status", "content"
    )


@query
def query_findings(spark, sf_dir):
    return _research(spark, sf_dir).query_findings


@query
def research_summary(spark, sf_dir):
    return _research(spark, sf_dir).research


@query
def research_word_count(spark, sf_dir):
    return _research(spark, sf_dir).word_counts


@query
def source_ledger(spark, sf_dir):
    return _research(spark, sf_dir).ledger


@query
def findings_readback(spark, sf_dir):
    """Query results written as text files, one per query, and read back by run."""
    folder = new_folder(spark, "findings")
    outputs.write_findings_text(_research(spark, sf_dir).query_findings, folder)
    back = read_txt_findings(
        spark, f"{folder}/run_id=*/query_idx=*", r"run_id=([^/]+)/", terminated=True
    )
    return back.select(F.col("run_id").cast("bigint").alias("run_id"), "all_text")


# --- reports, log, streaming ----------------------------------------------


@query
def report_path(spark, sf_dir):
    return given.table(spark, sf_dir, "documents").select(
        "doc_id", outputs.report_path(F.col("source"), F.col("text")).alias("path")
    )


@query
def report_messages(spark, sf_dir):
    return reporting.report_messages(given.deltas(spark, sf_dir))


def _sent(spark: SparkSession, sf_dir: str, deliveries: int) -> DataFrame:
    """Messages of a stream of delta files, where all deltas are delivered so often, each time once the stream is through."""
    source, out, state = (new_folder(spark, n) for n in ("deltas", "messages", "stream-state"))
    for _ in range(deliveries):
        given.deltas(spark, sf_dir).write.mode("append").parquet(source)
        sent = stream_report_messages(stream_deltas(spark, source))
        writer = sent.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        with disk_state(spark):
            writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(sent.schema).parquet(out)


@query
def report_messages_stream(spark, sf_dir):
    """The same messages from a stream of delta files, run to its end."""
    return _sent(spark, sf_dir, 1)


@query
def report_messages_replayed(spark, sf_dir):
    """The same again where all deltas are delivered once more, after all runs have ended."""
    return _sent(spark, sf_dir, 2)


@query
def report_text(spark, sf_dir):
    return reporting.report_text(given.deltas(spark, sf_dir))


@query
def run_log(spark, sf_dir):
    return _research(spark, sf_dir).log(given.run_times(spark, sf_dir))


@query
def concept_log(spark, sf_dir):
    return runlog.concept_lines(given.concept_replies(spark, sf_dir), ["doc_id"])


@query
def full_run(spark, sf_dir):
    """From start messages to reports: roles and queries asked for, rejected requests kept."""
    completer, store = infer.extractive_completer(), new_folder(spark, "store")
    asked = requests.ingest(given.start_messages(spark, sf_dir)).select(
        F.concat_ws("-", "conv_id", "turn").alias("run_id"), "task", "report_type", "agent", "error"
    )
    settled = stage(requests.validate(choose_agents(asked, completer, store)), "settled")
    runs = plan_queries(settled.where("accepted"), completer, store)
    run = ResearchRun(
        stage(runs, "runs"), given.table(spark, sf_dir, "pages"), completer=completer, store=store, partitions=TASKS
    )
    path = outputs.report_path(F.col("run_id"), F.col("report_type"))
    written = run.reports.select("run_id", "report_type", "report", path.alias("path"))
    return settled.select("run_id", "agent", "accepted", "error").join(written, "run_id", "left")


@query
def run_stream(spark, sf_dir):
    """The same from a stream of message files: each batch goes through to its reports and is committed as one."""
    source, out = new_folder(spark, "messages"), new_folder(spark, "run-stream")
    messages = given.start_messages(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("run_id"), "message")
    messages.repartition(2, "run_id").write.parquet(source)
    crawled = given.table(spark, sf_dir, "pages")
    texts = stage(pages.page_text(spread(crawled, "page_id", TASKS)), "all-text")
    index = new_folder(spark, "index")
    search.store_index(texts.select(F.col("page_id").alias("doc_key"), "text"), index)
    runs = ResearchStream(
        spark,
        crawled,
        infer.extractive_completer(),
        new_folder(spark, "store"),
        out,
        texts=texts,
        index=search.read_index(spark, index),
        partitions=TASKS,
    )
    stream = spark.readStream.schema("run_id string, message string").option("maxFilesPerTrigger", 1).parquet(source)
    runs.start(stream, new_folder(spark, "stream-state")).awaitTermination()
    written = runs.results.read("reports").select("run_id", "report_type", "report", "path")
    return runs.results.read("requests").select("run_id", "agent", "accepted", "error").join(written, "run_id", "left")


@query
def findings_overwrite(spark, sf_dir):
    """Query results stored by run; the runs of a second write replace their old rows, others stay."""
    folder = new_folder(spark, "findings")
    found = _research(spark, sf_dir).query_findings
    outputs.write_findings(found, folder)
    again = found.where(F.col("run_id") % 2 == 1).withColumn("result", F.concat(F.lit("again: "), "result"))
    outputs.write_findings(again.where(F.col("query_idx") > 0), folder)
    return read_findings(spark, folder)


@query
def run_log_stored(spark, sf_dir):
    """The run log as stored by a stream, started a second time over the same input."""
    source, out, state = (new_folder(spark, n) for n in ("log-lines", "log", "stream-state"))
    _research(spark, sf_dir).log(given.run_times(spark, sf_dir)).write.parquet(source)
    lines = spark.read.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 8).parquet(source)
        outputs.stream_run_log(stream, out, state).awaitTermination()
    return outputs.read_run_log(spark, out)


@query
def run_duration(spark, sf_dir):
    return runlog.run_duration(given.run_times(spark, sf_dir))


@query
def memory_records(spark, sf_dir):
    run = _research(spark, sf_dir)
    return runlog.memory_records(run.visit_chunks, run.chunk_summaries)


# --- flagship -------------------------------------------------------------


def pages_on_question(spark: SparkSession, sf_dir: str, question: str) -> DataFrame:
    """What the pages say on a question: one combined summary per URL."""
    texts = pages.page_text(_pages(spark, sf_dir)).where(F.col("text") != "")
    parts = pages.text_chunks(texts, ["url"])
    summaries = parts.select(
        "url", "part", extractive_summary(F.col("chunk"), F.lit(question)).alias("summary")
    )
    return assemble.combined_summary(summaries, ["url"])
