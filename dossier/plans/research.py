"""A whole research run for many requests at once."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import fixed_values as fixed
from dossier.functions.text import duration_text, extractive_summary, fill, interval_micros, word_count
from dossier.operators import assemble, pages, prompts, requests, runlog, search, visited
from dossier.operators.infer import Completer, Quoted, complete_stored
from dossier.settings import DEFAULTS, JobSettings
from dossier.sinks.outputs import report_path
from dossier.sinks.stage import stage, stage_alone
from dossier.sources.tables import spread

VISIT = assemble.VISIT


def choose_agents(
    asked: DataFrame, completer: Completer, store: str, settings: JobSettings = DEFAULTS
) -> DataFrame:
    """Requests (run_id, task, report_type, agent, error) with their agents settled; the
    model is asked, at temperature 0, for those that want the automatic agent."""
    auto = asked.where(F.col("agent") == fixed.AUTO_AGENT)
    calls = prompts.call_table(
        auto.select("run_id", prompts.role_choice_messages(F.col("task")).alias("messages")),
        settings.smart_model,
        replace(settings, temperature=0.0),
    )
    replies = complete_stored(calls, completer, store, settings.max_tokens_cap, **settings.calling)
    return requests.settle_agents(asked, replies.withColumnRenamed("content", "reply"), ["run_id"])


def plan_queries(
    accepted: DataFrame, completer: Completer, store: str, settings: JobSettings = DEFAULTS
) -> DataFrame:
    """Accepted requests with ``reply``, the model's list of search queries."""
    roles = requests.resolve_role(accepted)
    messages = prompts.role_messages(F.col("role_prompt"), prompts.query_prompt(F.col("task")))
    calls = prompts.call_table(
        roles.select("run_id", messages.alias("messages")), settings.smart_model, settings
    )
    replies = complete_stored(calls, completer, store, settings.max_tokens_cap, **settings.calling)
    return accepted.join(replies.select("run_id", F.col("content").alias("reply")), "run_id")


class ResearchRun:
    """The stages of a batch of runs, each a DataFrame that is built when asked for.

    ``runs`` has run_id, task, report_type, agent, agent_role_prompt and reply (the
    model's list of queries).  ``crawled`` is a stored table of page_id, url and html.  Queries of one run and all
    runs go in parallel; that a run's queries come one after the other shows only in
    which query owns a URL, and :mod:`dossier.operators.visited` settles that.

    Hits are staged: everything later starts from them, and they are small beside
    the corpus, so their true size then decides how pages are fetched.  Without a
    ``completer`` the extractive stand-in writes all summaries, as column expressions.

    Where many batches run over one crawl, store ``pages.page_text(crawled)`` and the
    index of it (``search.store_index``) once, and give them as ``texts`` and ``index``.  ``more_hits`` (run_id,
    query_idx, rank, url) are hits of another search; their URLs may be null or not crawled.
    ``saved`` (run_id, all_text) are findings of earlier runs, as ``sources.tables.read_txt_findings`` reads them: such a run
    takes up at its report, without queries, hits or calls for pages.
    ``partitions`` deals a crawl of few files over that many tasks.
    """

    def __init__(
        self,
        runs: DataFrame,
        crawled: DataFrame,
        settings: JobSettings = DEFAULTS,
        completer: Completer | None = None,
        store: str | None = None,
        texts: DataFrame | None = None,
        index: tuple[DataFrame, DataFrame] | None = None,
        more_hits: DataFrame | None = None,
        saved: DataFrame | None = None,
        partitions: int | None = None,
    ):
        if completer is not None and store is None:
            raise ValueError("a completer needs a folder that stores its completions")
        self.runs = runs
        self.crawled = spread(crawled, "page_id", partitions)
        self.partitions = partitions
        self.more_hits = more_hits
        self.saved = None if saved is None else saved.where(F.coalesce("all_text", F.lit("")) != "")
        self.settings = settings
        self.completer = completer
        self.store = store
        self.extracted = texts
        self.index = index

    def _completed(self, calls: DataFrame, quoted: Quoted | None = None) -> DataFrame:
        return complete_stored(
            calls, self.completer, self.store, self.settings.max_tokens_cap, quoted, **self.settings.calling
        )

    @cached_property
    def fresh(self) -> DataFrame:
        """Runs without saved findings."""
        return self.runs if self.saved is None else self.runs.join(self.saved, "run_id", "left_anti")

    @cached_property
    def fanned(self) -> DataFrame:
        return stage(requests.list_fanout(self.fresh.select("run_id", "reply"), "query"), "fanned")

    @cached_property
    def queries(self) -> DataFrame:
        return self.fanned.where(F.col("error").isNull()).select("run_id", "query_idx", "query")

    @cached_property
    def rejected(self) -> DataFrame:
        """(run_id, error) of runs whose reply is no list of queries; they end there."""
        return self.fanned.where(F.col("error").isNotNull()).select("run_id", "error")

    @cached_property
    def researched(self) -> DataFrame:
        """Runs that go on: an empty list of queries gives an empty research summary."""
        return self.runs.join(self.rejected, "run_id", "left_anti")

    @cached_property
    def page_texts(self) -> DataFrame:
        """Text of all pages, extracted once for search and lookup."""
        if self.extracted is not None:
            return self.extracted
        return stage(pages.page_text(self.crawled), "all-text")

    @cached_property
    def hits(self) -> DataFrame:
        """Search over the text of all pages, and hits from elsewhere for queries of these runs."""
        corpus, queries = self.page_texts.select(F.col("page_id").alias("doc_key"), "text"), self.queries
        keys, most = ["run_id", "query_idx"], self.settings.hits_per_query
        found = stage_alone(
            queries.sparkSession, lambda: search.search_topk(corpus, queries, keys, most, index=self.index), "found"
        )
        addresses = self.page_texts.select(F.col("page_id").alias("doc_key"), "url")
        hits = found.join(addresses, "doc_key").select("run_id", "query_idx", "rank", "url", "score")
        if self.more_hits is not None:
            asked = self.queries.select("run_id", "query_idx")
            more = self.more_hits.join(asked, ["run_id", "query_idx"], "left_semi")
            hits = hits.unionByName(
                more.select("run_id", "query_idx", "rank", "url", F.lit(None).cast("bigint").alias("score"))
            )
        return stage(hits, "hits")

    @cached_property
    def visits(self) -> DataFrame:
        return visited.first_visits(self.hits)

    @cached_property
    def _stored_texts(self) -> DataFrame:
        return stage(pages.latest_pages(self.page_texts, self.hits).select("page_id", "url", "text"), "page-text")

    @cached_property
    def texts(self) -> DataFrame:
        """Text of the pages that were hit, staged: it is read for lookups and chunks."""
        return spread(self._stored_texts, "page_id", self.partitions)

    @cached_property
    def lookups(self) -> DataFrame:
        return pages.page_lookup(self.visits, self.texts)

    @cached_property
    def page_chunks(self) -> DataFrame:
        """Chunks by URL; a page is cut once, however many runs visit it."""
        filled = self.texts.where(F.col("text") != "")
        return pages.text_chunks(filled, ["url"], self.settings.chunk_chars)

    @cached_property
    def visit_chunks(self) -> DataFrame:
        asked = self.visits.join(self.queries, ["run_id", "query_idx"])
        return asked.select(*VISIT, "query").join(self.page_chunks, "url")

    @cached_property
    def chunk_prompts(self) -> DataFrame:
        messages = prompts.summary_messages(F.col("chunk"), F.col("query"))
        return self.visit_chunks.select(*VISIT, "part", messages.alias("messages"))

    def _summarised(
        self, texts: DataFrame, keys: list[str], text: str, source: DataFrame, on: list[str], shared: bool = False
    ) -> DataFrame:
        """summary and error of each row; rows have ``query`` beside keys and text.  ``source`` is the table that the texts come
        from, by ``on``, which are columns of the rows too; if it is ``shared``, many rows have the same text."""
        if self.completer is None:
            summary = extractive_summary(F.col(text), F.col("query"))
            return texts.select(*keys, summary.alias("summary"), F.lit(None).cast("string").alias("error"))
        messages = prompts.summary_messages(F.col(text), F.col("query"))
        calls = prompts.call_table(
            texts.select(*dict.fromkeys([*keys, *on]), "query", text, messages.alias("messages")),
            self.settings.fast_model,
            self.settings,
        )
        done = self._completed(calls, Quoted(source, on, text, "query", messages, shared))
        return done.select(*keys, F.col("content").alias("summary"), "error")

    @cached_property
    def chunk_summaries(self) -> DataFrame:
        """Read from the store of completions where a completer writes them."""
        return self._summarised(self.visit_chunks, [*VISIT, "part"], "chunk", self.page_chunks, ["url", "part"], shared=True)

    @cached_property
    def _joined_chunks(self) -> DataFrame:
        """The combined text of each visit, and in ``_failed`` the error of its first failed call; staged, as calls quote it by ``_id``."""
        joined = assemble.combined_summary(self.chunk_summaries, dense=True, errors="error")
        return stage(joined.withColumn("_id", F.monotonically_increasing_id()), "combined")

    @cached_property
    def combined(self) -> DataFrame:
        if self.completer is None:
            return assemble.combined_summary(self.chunk_summaries)
        return self._joined_chunks.drop("_failed", "_id")

    @cached_property
    def url_summaries(self) -> DataFrame:
        """One more call on the combined text, also where there was a single chunk.  A
        visit with a failed chunk call keeps that error instead."""
        if self.completer is None:
            asked = self.combined.join(self.queries, ["run_id", "query_idx"])
            return self._summarised(asked, VISIT, "combined", self.combined, VISIT)
        asked = self._joined_chunks.join(self.queries, ["run_id", "query_idx"])
        summed = self._summarised(asked, [*VISIT, "_failed"], "combined", self._joined_chunks, ["_id"])
        return summed.select(
            *VISIT,
            F.when(F.col("_failed").isNull(), F.col("summary")).alias("summary"),
            F.coalesce("_failed", "error").alias("error"),
        )

    @cached_property
    def findings(self) -> DataFrame:
        """Staged: query results, word counts, reports and the log all start from it."""
        # Whether there is a text is all that a finding says of it.
        brief = self._stored_texts.withColumn("text", F.substring("text", 1, 1))
        return stage(assemble.finding_status(pages.page_lookup(self.visits, brief), self.url_summaries), "findings")

    @cached_property
    def query_findings(self) -> DataFrame:
        return assemble.query_findings(self.queries, self.findings)

    @cached_property
    def research(self) -> DataFrame:
        """Of every run that goes on; '' for one without queries."""
        made = assemble.research_summary(self.query_findings)
        if self.saved is not None:
            made = made.unionByName(self.saved.select("run_id", F.col("all_text").alias("research_summary")))
        return self._of_all_runs(made, "research_summary", F.lit(""))

    def _of_all_runs(self, found: DataFrame, column: str, default) -> DataFrame:
        joined = self.researched.select("run_id").join(found, "run_id", "left")
        return joined.select("run_id", F.coalesce(column, default).alias(column))

    @cached_property
    def word_counts(self) -> DataFrame:
        made = assemble.research_word_count(self.query_findings)
        if self.saved is not None:
            made = made.unionByName(self.saved.select("run_id", word_count(F.col("all_text")).alias("n_words")))
        return self._of_all_runs(made, "n_words", F.lit(1).cast("bigint"))

    @cached_property
    def report_prompts(self) -> DataFrame:
        ready = requests.resolve_role(self.researched).join(self.research, "run_id")
        return prompts.report_prompts(ready)

    @cached_property
    def reports(self) -> DataFrame:
        """(run_id, report_type, report, error) by the smart model, or the stand-in."""
        if self.completer is None:
            ready = self.runs.join(self.research, "run_id")
            typed = prompts.resolve_report_type(ready).where("known")
            report = extractive_summary(F.col("research_summary"), F.col("task"), 5, ".\n")
            written = typed.select(
                "run_id", "report_type", report.alias("report"), F.lit(None).cast("string").alias("error")
            )
            return stage(written, "reports")
        messages = prompts.role_messages(F.col("role_prompt"), F.col("report_prompt"))
        calls = prompts.call_table(
            self.report_prompts.select("run_id", "report_type", messages.alias("messages")),
            self.settings.smart_model,
            self.settings,
        )
        done = self._completed(calls)
        return stage(done.select("run_id", "report_type", F.col("content").alias("report"), "error"), "reports")

    @cached_property
    def ledger(self) -> DataFrame:
        return visited.source_ledger(self.findings, self.page_chunks)

    def log(self, run_times: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
        """All lines a run sends, in one table.

        ``run_times`` (run_id, ts) adds end and total run time, of runs that get to their report.
        ``asked`` (run_id, agent) are all requests, where some were rejected: each gets its first line.
        A run of an unknown report type ends before its report is begun."""
        row = runlog.log_rows
        column = F.col
        shown = lambda c: F.coalesce(column(c), F.lit("None"))
        findings = self.findings
        visits = self.visits.join(self.queries, ["run_id", "query_idx"]).withColumn("url", shown("url"))
        sites = visits.groupBy("run_id", "query_idx").agg(
            F.array_sort(F.collect_list(F.struct("rank", "url"))).alias("_sites")
        )
        sites = self.queries.select("run_id", "query_idx").join(sites, ["run_id", "query_idx"], "left")
        urls = F.coalesce(F.to_json(F.transform("_sites", lambda s: s["url"])), F.lit("[]"))
        reports = self.reports.where(F.col("report").isNotNull())
        writing = prompts.resolve_report_type(self.researched).where("known")
        # A report is sent line by line as its breaks arrive; a tail without one is not.
        lines = F.posexplode(F.split("report", "(?<=\n)"))
        parts = [
            row(self.runs if asked is None else asked, 0, 0, "request", fill(fixed.LOG_INITIATED, agent=shown("agent"))),
            row(self.fresh, 1, 1, "queries", fill(fixed.LOG_QUERIES, reply=shown("reply"))),
            row(self.queries, 2, 2, "query", fill(fixed.LOG_QUERY, query=column("query")), "query_idx"),
            row(visits, 2, 3, "new_url", fill(fixed.LOG_NEW_URL, url=column("url")), "query_idx", "rank"),
            row(sites, 2, 4, "sites", fill(fixed.LOG_SITES, urls=urls), "query_idx"),
            row(visits, 2, 5, "browse", fill(fixed.LOG_BROWSE, url=column("url"), query=column("query")), "query_idx", "rank"),
            row(
                findings.where(column("status").isin("ok", "empty_text")),
                2,
                6,
                "finding",
                fill(fixed.LOG_FINDING, finding=column("content")),
                "query_idx",
                "rank",
            ),
            row(self.word_counts, 3, 7, "words", fill(fixed.LOG_WORDS, n=column("n_words"))),
            row(
                writing,
                4,
                8,
                "writing",
                fill(fixed.LOG_WRITING, report_type=column("report_type"), task=column("task")),
            ),
            row(
                reports.select("run_id", lines.alias("seq", "line")).where(F.contains("line", F.lit("\n"))),
                4,
                9,
                "report",
                column("line"),
                None,
                "seq",
                "report",
            ),
            row(
                reports,
                5,
                10,
                "path",
                report_path(column("run_id").cast("string"), column("report_type")),
                kind="path",
            ),
        ]
        if run_times is not None:
            spans = run_times.groupBy("run_id").agg(
                F.max("ts").alias("end"), interval_micros(F.max("ts") - F.min("ts")).alias("micros")
            )
            ended = reports.select("run_id").join(spans, "run_id")
            stamp = F.date_format(column("end"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
            parts.append(row(ended, 6, 11, "end", fill(fixed.LOG_END, end=stamp)))
            parts.append(
                row(ended, 6, 12, "run_time", fill(fixed.LOG_RUN_TIME, duration=duration_text(column("micros"))))
            )
        return runlog.run_log(parts)
