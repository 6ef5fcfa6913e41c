import json
import random
import time
import uuid
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from dossier.functions.ordered import ordered_concat
from dossier.operators import assemble, infer, pages, prompts, runlog, search, visited
from dossier.plans import workload as given
from dossier.operators.requests import list_fanout, validate
from dossier.plans.research import ResearchRun, choose_agents, plan_queries
from dossier.settings import JobSettings
from dossier.sinks import outputs
from dossier.sinks import stage as stages
from dossier.sinks.completions import CompletionStore
from dossier.sinks.stage import new_folder, stage
from dossier.sources.tables import read_txt_findings, spread


@pytest.mark.parametrize("block", [None, 1, 3, 1000])
def test_ordered_concat(rows, block):
    data = [(g, i, None if i % 5 == 4 else f"{g}{i}") for g in "ab" for i in range(23)]
    frame = rows(data[::-1], "g string, o long, v string").repartition(3)
    got = {r.g: r.s for r in ordered_concat(frame, ["g"], "o", "v", "'\n", "s", block).collect()}
    assert got == {g: "'\n".join(v for h, _, v in data if h == g and v is not None) for g in "ab"}


def test_first_visit_owns_the_url(rows):
    hits = rows(
        [
            (1, 1, 1, "u", 9), (1, 0, 2, "u", 5), (1, 0, 3, "u", 4), (1, 1, 2, "v", 3),
            (2, 1, 1, "u", 2), (1, 1, 3, None, 1),
        ],
        "run_id int, query_idx int, rank int, url string, score long",
    )
    got = {(r.run_id, r.url): (r.query_idx, r["rank"], r.score) for r in visited.first_visits(hits).collect()}
    assert got == {(1, "u"): (0, 2, 5), (1, "v"): (1, 2, 3), (2, "u"): (1, 1, 2), (1, None): (1, 3, 1)}
    history = rows([(1, "u")], "run_id int, url string")
    fresh = {(r.run_id, r.url) for r in visited.unvisited(hits, history).collect()}
    assert fresh == {(1, "v"), (2, "u"), (1, None)}


def test_query_without_findings_keeps_its_row(rows):
    queries = rows([(1, 0, "a"), (1, 1, "b")], "run_id int, query_idx int, query string")
    findings = rows([(1, 0, 2, "second x"), (1, 0, 1, "first")], "run_id int, query_idx int, rank int, content string")
    results = assemble.query_findings(queries, findings)
    assert {(r.query_idx, r.result) for r in results.collect()} == {(0, "first\nsecond x"), (1, "")}
    summary = assemble.research_summary(results).first().research_summary
    assert summary == "first\nsecond x\n\n\n\n"
    assert assemble.research_word_count(results).first().n_words == len(summary.split(" "))


def test_finding_texts(rows):
    lookups = rows(
        [(1, 0, i, u, s) for i, (u, s) in enumerate([("a", "ok"), ("b", "no_page"), ("c", "empty_text"), ("d", "ok"), ("", "no_url")])],
        "run_id int, query_idx int, rank int, url string, status string",
    )
    summaries = rows([(1, 0, "a", "S", None), (1, 0, "d", None, "boom")], "run_id int, query_idx int, url string, summary string, error string")
    got = {r.url: (r.status, r.content) for r in assemble.finding_status(lookups, summaries).collect()}
    assert got == {
        "a": ("ok", "Information gathered from url a: S"),
        "b": ("no_page", "Error processing the url b: page not found"),
        "c": ("empty_text", "Information gathered from url c: Error: No text to summarize"),
        "d": ("error", "Error processing the url d: boom"),
        "": ("no_url", "A URL was not specified, cancelling request to browse website."),
    }


def _calls(rows, texts):
    frame = rows([(i, t) for i, t in enumerate(texts)], "id int, t string")
    messages = prompts.summary_messages(F.col("t"), F.lit("q"))
    return prompts.call_table(frame.select("id", messages.alias("messages")), "m")


def test_failing_calls_stay_rows_and_are_sent_again(spark, rows, tmp_path):
    marker = tmp_path / "calls"

    def completer(messages, model, temperature, max_tokens):
        assert (model, temperature, max_tokens) == ("m", 1.0, None)
        with open(marker, "a") as log:
            log.write("x")
        if "bad" in messages[0]["content"] and len(open(marker).read()) < 5:
            raise RuntimeError("refused")
        return messages[0]["role"].upper()

    store = new_folder(spark, "store")
    calls = _calls(rows, ["one", "bad", "one", "two"])
    first = {r.id: (r.content, r.error) for r in infer.complete_stored(calls, completer, store).collect()}
    assert first == {0: ("USER", None), 1: (None, "refused"), 2: ("USER", None), 3: ("USER", None)}
    made = len(marker.read_text())
    assert made == 3  # the repeated prompt was sent once, and reading sent none
    with open(marker, "a") as log:
        log.write("xx")
    second = infer.complete_stored(calls, completer, store, tasks=2, threads=2)
    assert {r.content for r in second.collect()} == {"USER"}
    assert len(marker.read_text()) == made + 2 + 1


def test_waves_make_each_call_once(spark, rows, tmp_path):
    marker = tmp_path / "calls"

    def completer(messages, model, temperature, max_tokens):
        with open(marker, "a") as log:
            log.write("x")
        if "t7" in messages[0]["content"]:
            raise RuntimeError("refused")
        return "done"

    calls = _calls(rows, [f"t{i}" for i in range(20)])
    done = infer.complete_stored(calls, completer, new_folder(spark, "store"), waves=3).collect()
    assert len(marker.read_text()) == 20
    assert {(r.content, r.error) for r in done if r.id != 7} == {("done", None)}
    assert [(r.content, r.error) for r in done if r.id == 7] == [(None, "refused")]


def test_calls_are_spread(spark, rows, tmp_path):
    def completer(messages, model, temperature, max_tokens):
        from pyspark import TaskContext

        return str(TaskContext.get().partitionId())

    calls = _calls(rows, [f"t{i}" for i in range(1000)])
    done = infer.complete_stored(calls, completer, new_folder(spark, "store")).collect()
    assert len({r.content for r in done}) >= spark.sparkContext.defaultParallelism > 1


def test_a_second_writer_gives_no_second_row(spark, rows):
    store = new_folder(spark, "store")
    calls = _calls(rows, ["one", "two"])
    answer = lambda text: lambda messages, model, temperature, max_tokens: text
    infer.complete_stored(calls, answer("first"), store)
    # Another writer that had not seen the first one's rows.
    rival = calls.select("prompt_id", F.lit("second").alias("content"), F.lit(None).cast("string").alias("error"), F.lit("b").alias("batch"))
    CompletionStore(spark, store).append(rival)
    again = infer.complete_stored(calls, answer("third"), store).collect()
    assert sorted((r.id, r.content) for r in again) == [(0, "first"), (1, "first")]
    assert infer.completion_store(spark, store).count() == 2


def flaky(log):
    """Fails for good on prompts that hold ``bad``, and at first on those that hold ``slow``."""

    def completer(messages, model, temperature, max_tokens, attempt):
        text = messages[0]["content"]
        with open(log, "a") as lines:
            lines.write("x")
        if "bad" in text or ("slow" in text and attempt < 3):
            raise RuntimeError(f"busy at {attempt}")
        return f"done at {attempt}"

    return completer


def test_failed_calls_are_sent_again(spark, rows, tmp_path):
    log, path = tmp_path / "calls", new_folder(spark, "store")
    calls = _calls(rows, ["one", "slow", "bad", "one"])
    ask = lambda attempts, **more: {
        r.id: (r.content, r.error) for r in infer.complete_stored(calls, flaky(log), path, attempts=attempts, pause=0.01, **more).collect()
    }
    assert ask(2, give_up=5) == {0: ("done at 1", None), 1: (None, "busy at 2"), 2: (None, "busy at 2"), 3: ("done at 1", None)}
    assert len(log.read_text()) == 5
    assert ask(4, give_up=5) == {0: ("done at 1", None), 1: ("done at 3", None), 2: (None, "busy at 5"), 3: ("done at 1", None)}
    store = CompletionStore(spark, path)
    assert len(log.read_text()) == 9 and [(r.tries, r.error) for r in store.dead_letters(5).collect()] == [(5, "busy at 5")]
    # A dead letter is not sent any more, also once the store is compacted.
    for _ in range(2):
        assert ask(3, give_up=5)[2] == (None, "busy at 5") and len(log.read_text()) == 9
        store.compact()
    assert ask(1)[2] == (None, "busy at 6") and len(log.read_text()) == 10


def test_compaction_loses_nothing(spark, rows):
    store = CompletionStore(spark, new_folder(spark, "store"))

    def add(ids, batch, failed=()):
        data = [(f"p{i}", None if i in failed else batch, "e" if i in failed else None, batch) for i in ids]
        store.append(rows(data, "prompt_id string, content string, error string, batch string"))

    add(range(0, 60), "a", failed=range(50, 60))
    add(range(40, 90), "b", failed=range(55, 60))
    # While one compaction is at work, a writer adds a segment and a second compaction starts from what it found.
    name, late = store._name, []

    def interrupted(segment, replaced):
        if replaced and not late:
            late.append(1)
            add(range(85, 100), "c")
            CompletionStore(spark, store.path).compact()
        name(segment, replaced)

    store._name = interrupted
    store.compact()
    store._name = name
    want = {f"p{i}": "a" if i < 50 else "b" if i < 90 else "c" for i in range(100) if not 55 <= i < 60}
    assert {r.prompt_id: r.content for r in store.completions().collect()} == want
    for _ in range(2):
        store.compact()
        assert len(store.segments()) == 1
        assert {r.prompt_id: r.content for r in store.completions().collect()} == want
        assert [r.tries for r in store.dead_letters(1).collect()] == [2] * 5
        store.vacuum()
    assert store.rows().count() == 95 + 10


def test_few_prompts_read_few_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(infer, "SEGMENTS", 2)
    path = new_folder(spark, "store")
    for turn in range(5):
        infer.complete_stored(_calls(rows, [f"{turn}-{i}" for i in range(30)]), infer.extractive_completer(), path, tasks=2)
    store = CompletionStore(spark, path)
    assert len(store.segments()) <= infer.SEGMENTS + 1
    ten = _calls(rows, [f"3-{i}" for i in range(10)])
    parts = store.parts_of(ten)
    read = store.rows(parts)
    assert len(parts) <= 10 and {r.part for r in read.select("part").distinct().collect()} <= set(parts)
    assert "PartitionFilters: [part" in read._jdf.queryExecution().executedPlan().toString()


def test_calls_are_dealt_by_length(spark, rows):
    texts = ["x" * (40 if i % 50 else 4000) for i in range(4000)]
    ids = _calls(rows, [f"{i} {t}" for i, t in enumerate(texts)]).select("prompt_id", infer.prompt_chars().alias("chars"))
    places = ids.join(infer.dealt(ids, 8), infer.block() == F.col("block"))
    sizes = [r.n for r in places.groupBy("task").agg(F.sum("chars").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sum(sizes) / 8


def test_calls_that_may_not_be_sent_come_back(spark, rows):
    run = ResearchRun(rows([], "run_id int"), rows([], "page_id int"), completer=infer.extractive_completer(), store=new_folder(spark, "store"))
    calls = _calls(rows, ["one", "two"])
    calls = calls.withColumn("max_tokens", F.when(F.col("id") == 1, 9000).cast("int"))
    got = {r.id: (r.content is not None, r.error) for r in run._completed(calls).collect()}
    assert got == {0: (True, None), 1: (False, "Max tokens cannot be more than 8001, but got 9000")}


def _run(spark, sf_dir, **more):
    crawled = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return ResearchRun(given.runs(spark, sf_dir), crawled, more_hits=given.other_hits(spark, sf_dir), **more)


def test_run_with_a_completer(spark, sf_dir):
    store = new_folder(spark, "store")
    run = _run(spark, sf_dir, completer=infer.extractive_completer(), store=store)
    findings = run.findings.collect()
    assert {f.status for f in findings} == {"ok", "no_page", "no_url"}
    assert {f.url for f in findings if f.status == "no_page"} == {
        r.url for r in given.other_hits(spark, sf_dir).join(run.queries, ["run_id", "query_idx"]).collect() if r.url
    }
    assert run.visits.count() == len(findings)
    assert infer.completion_store(spark, store).count() > 0
    reports = run.reports.collect()
    assert len(reports) == run.researched.where("report_type <> 'poem'").count()
    assert all(r.report is not None and r.error is None for r in reports)
    # The completer and the expressions say the same.
    assert set(findings) == set(_run(spark, sf_dir).findings.collect())


def test_runs_without_queries(spark, rows, sf_dir):
    base = rows(
        [(1, "t", "research_report", "A", None, "[]"), (2, "t", "outline_report", "A", None, "no list"),
         (3, "u", "poem", None, None, '["the"]')],
        "run_id long, task string, report_type string, agent string, agent_role_prompt string, reply string",
    )
    run = ResearchRun(base, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert [(r.run_id, r.error) for r in run.rejected.collect()] == [(2, "malformed reply")]
    summaries = {r.run_id: r.research_summary for r in run.research.collect()}
    assert set(summaries) == {1, 3} and summaries[1] == "" and summaries[3]
    assert {r.run_id: r.n_words for r in run.word_counts.collect()}[1] == 1
    assert {r.run_id for r in run.reports.collect()} == {1}
    times = rows([(i, "2024-01-01 00:00:00") for i in (1, 2, 3)], "run_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    asked = rows([(1, "A"), (2, "A"), (3, None), (4, "B")], "run_id long, agent string")
    lines = run.log(times, asked).orderBy("run_id", "phase", "query_idx", "stage_no", "seq").collect()
    sent = lambda i: list(dict.fromkeys(r.stage for r in lines if r.run_id == i))
    assert sent(1) == ["request", "queries", "words", "writing", "path", "end", "run_time"]
    assert sent(2) == ["request", "queries"] and sent(4) == ["request"]
    assert sent(3) == ["request", "queries", "query", "new_url", "sites", "browse", "finding", "words"]
    assert [r.output for r in lines if r.run_id == 3][0] == "Initiated an Agent: None"


def test_saved_runs_take_up_at_their_report(spark, rows, sf_dir):
    base = rows(
        [(1, "t", "research_report", "A", None, '["the"]'), (2, "t", "research_report", "A", None, None), (3, "t", "research_report", "A", None, '["the"]')],
        "run_id long, task string, report_type string, agent string, agent_role_prompt string, reply string",
    )
    saved = rows([(2, "kept words\nhere"), (3, "")], "run_id long, all_text string")
    run = ResearchRun(base, spark.read.parquet(f"{sf_dir}/pages.parquet"), saved=saved)
    assert {r.run_id for r in run.queries.collect()} == {1, 3} and not run.rejected.collect()
    assert {r.run_id: r.research_summary for r in run.research.collect()}[2] == "kept words\nhere"
    assert {r.run_id: r.n_words for r in run.word_counts.collect()}[2] == 2
    assert {r.run_id for r in run.reports.collect()} == {1, 2, 3}
    assert [r.stage for r in run.log().where("run_id = 2").orderBy("phase", "stage_no").collect()][:3] == ["request", "words", "writing"]


def test_from_request_to_queries(spark, rows):
    def model(messages, model, temperature, max_tokens):
        if temperature == 0.0:
            return '{"agent": "Picked", "agent_role_prompt": "P"}'
        return json.dumps([messages[0]["content"], messages[1]["content"][:7]])

    asked = rows(
        [(1, "t", "research_report", "Auto Agent", None), (2, "", "research_report", "Travel Agent", None),
         (3, "u", "research_report", "Nobody", None)],
        "run_id long, task string, report_type string, agent string, error string",
    )
    store = new_folder(spark, "store")
    settled = validate(choose_agents(asked, model, store)).where("accepted")
    planned = plan_queries(settled, model, store)
    queries = list_fanout(planned.select("run_id", "reply"), "query")
    got = {(r.run_id, r.query_idx, r["query"]) for r in queries.collect()}
    assert got == {(1, 0, "P"), (1, 1, "Write 4"), (3, 0, "No such agent"), (3, 1, "Write 4")}
    assert {r.agent for r in planned.collect()} == {"Picked", "Nobody"}


def test_stored_texts_and_index_give_the_same_run(spark, sf_dir):
    runs, crawled = given.runs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = stage(pages.page_text(crawled), "texts")
    path = new_folder(spark, "index")
    search.store_index(texts.select(F.col("page_id").alias("doc_key"), "text"), path)
    stored = ResearchRun(runs, crawled, texts=texts, index=search.read_index(spark, path))
    assert set(stored.findings.collect()) == set(ResearchRun(runs, crawled).findings.collect())


def test_each_url_is_owned_once(spark, sf_dir):
    run = ResearchRun(given.runs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet"))
    hits = {(r.run_id, r.url) for r in run.hits.collect()}
    visits = [(r.run_id, r.url) for r in run.visits.collect()]
    assert len(visits) == len(set(visits)) and set(visits) == hits


def test_wide_columns_are_extracted_once(spark, sf_dir):
    """Pages are looked up in the stored texts: no plan after the extraction reads markup."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = _run(spark, sf_dir)
        for frame in (run.lookups, run.findings, run.research, run.ledger):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "html" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_findings_are_replaced_by_run(spark, rows):
    folder = new_folder(spark, "findings")
    make = lambda data: rows(data, "run_id int, query_idx int, query string, result string")
    outputs.write_findings(make([(1, 0, "q", "old"), (2, 0, "q", "kept")]), folder)
    outputs.write_findings(make([(1, 0, "q", "new")]), folder)
    assert {(r.run_id, r.result) for r in spark.read.parquet(folder).collect()} == {(1, "new"), (2, "kept")}


def test_text_findings_read_back(spark, rows, tmp_path):
    folder = new_folder(spark, "texts")
    results = rows([(7, 0, "q", "a\n"), (7, 1, "q", ""), (8, 0, "q", "b\n\nc")], "run_id int, query_idx int, query string, result string")
    outputs.write_findings_text(results, folder)
    back = read_txt_findings(spark, f"{folder}/run_id=*/query_idx=*", r"run_id=([^/]+)/", terminated=True)
    assert {(r.run_id, r.all_text) for r in back.collect()} == {("7", "a\n\n\n"), ("8", "b\n\nc\n")}
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "b.txt").write_text("two\n")
    (tmp_path / "r1" / "a.txt").write_text("one")
    (tmp_path / "r1" / "c.md").write_text("no")
    (tmp_path / "r1" / "deep").mkdir()
    (tmp_path / "r1" / "deep" / "d.txt").write_text("no")
    plain = read_txt_findings(spark, str(tmp_path / "r1"))
    assert [(r.run_id, r.all_text) for r in plain.collect()] == [("r1", "one\ntwo\n\n")]


def test_reports_and_log_are_written(spark, rows):
    folder = new_folder(spark, "reports")
    outputs.write_reports(rows([(1, "research_report", "# T\n\nx")], "run_id int, report_type string, report string"), folder)
    back = spark.read.text(folder, wholetext=True).first()
    assert (back.value, back.run_id, back.report_type) == ("# T\n\nx\n", 1, "research_report")
    told = outputs.report_manifest(spark, folder).first()
    assert (told.run_id, told.report_type, told.path) == (1, "research_report", "./outputs/1/research_report.pdf")
    assert spark.read.text(told.stored, wholetext=True).first().value == back.value
    log = new_folder(spark, "log")
    line = runlog.log_rows(rows([(1,)], "run_id int"), 0, 0, "request", F.lit("hello"))
    outputs.append_run_log(line, log)
    outputs.append_run_log(line, log)
    assert spark.read.parquet(log).count() == 2


def test_findings_of_many_queries_are_in_order(spark, rows):
    folder = new_folder(spark, "texts")
    results = rows([(7, i, "q", f"r{i}") for i in range(12)], "run_id int, query_idx int, query string, result string")
    outputs.write_findings_text(results, folder)
    back = read_txt_findings(spark, f"{folder}/run_id=*/query_idx=*", r"run_id=([^/]+)/", terminated=True)
    assert back.first().all_text == "".join(f"r{i}\n" for i in range(12))


def test_spread(spark):
    assert spread(spark.range(0, 100, 1, 16), "id", None).rdd.getNumPartitions() == 16
    assert spread(spark.range(0, 100, 1, 1), "id", 5).rdd.getNumPartitions() == 5


def test_stage_folders(spark, rows):
    kept = spark.conf.get(stages.RUN, None)
    spark.conf.set(stages.RUN, "trial")
    try:
        table = stage(rows([(1,)], "x int"), "t")
        assert table.inputFiles()[0].count("/dossier/trial/t-") == 1
        stages.release(spark)
        assert not spark._jvm.java.io.File(stages.run_folder(spark).removeprefix("file:")).exists()
    finally:
        spark.conf.set(stages.RUN, kept) if kept else spark.conf.unset(stages.RUN)

    class Session:
        def __init__(self, master):
            self.conf, self.values = self, {"spark.master": master}

        def get(self, key, *default):
            return self.values.get(key, *default)

        def set(self, key, value):
            self.values[key] = value

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            stages.shared_folder(Session(master))
    for master in ("local", "local[4]", "local[*]"):
        alone = Session(master)
        assert stages.shared_folder(alone) == stages.shared_folder(alone)


def test_one_call_at_a_time_needs_no_thread(spark, rows):
    def completer(messages, model, temperature, max_tokens):
        import threading

        return str(threading.current_thread() is threading.main_thread())

    for threads, wanted in ((1, {"True"}), (2, {"False"})):
        done = infer.complete_stored(_calls(rows, ["one", "two"]), completer, new_folder(spark, "store"), threads=threads)
        assert {r.content for r in done.collect()} == wanted


def test_a_table_of_many_parts_is_not_dealt_again(spark):
    assert spread(spark.range(0, 100, 1, 16), "id", 5).rdd.getNumPartitions() == 16


def test_rows_of_earlier_calls_are_left_where_they_are(spark, rows):
    store = CompletionStore(spark, new_folder(spark, "store"))
    answer = lambda text: lambda messages, model, temperature, max_tokens: text
    infer.complete_stored(_calls(rows, [f"a{i}" for i in range(200)]), answer("first"), store.path)
    old = store.segments()[0]
    done = infer.complete_stored(_calls(rows, ["b", "c"]), answer("second"), store.path)
    assert {r.content for r in done.collect()} == {"second"}
    assert not [path for path in done.inputFiles() if old in path]
    # Where they are asked for, they are found, and only they are moved.
    mixed = infer.complete_stored(_calls(rows, ["a7", "b", "d", "d"]), answer("third"), store.path)
    assert sorted((r.id, r.content) for r in mixed.collect()) == [(0, "first"), (1, "second"), (2, "third"), (3, "third")]


def test_a_compaction_meanwhile_hides_no_completion(spark, rows):
    store = CompletionStore(spark, new_folder(spark, "store"))
    answer = lambda text: lambda messages, model, temperature, max_tokens: text
    infer.complete_stored(_calls(rows, ["a", "b"]), answer("first"), store.path)
    infer.complete_stored(_calls(rows, ["c"]), answer("first"), store.path)
    append = CompletionStore.append

    def compacting(self, made):
        append(self, made)
        CompletionStore(spark, self.path).compact()

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(CompletionStore, "append", compacting)
        done = infer.complete_stored(_calls(rows, ["a", "c", "d"]), answer("second"), store.path)
    assert {r.id: r.content for r in done.collect()} == {0: "first", 1: "first", 2: "second"}


def test_reports_are_worked_out_once(spark, sf_dir):
    run = _run(spark, sf_dir, completer=infer.extractive_completer(), store=new_folder(spark, "store"))
    assert all("/reports-" in path for path in run.reports.inputFiles())


def _bytes_shuffled(spark):
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def _noise(seed, length):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(length))


def test_a_text_is_not_moved_for_each_call_that_quotes_it(spark, rows):
    # One page that 60 runs visit.  Its text was staged, and shuffled twice, for each of them.
    text = "word " + _noise(1, 40_000)
    crawled = rows([(1, "u", f"<p>{text}</p>")], "page_id long, url string, html string")
    base = rows(
        [(f"r{i}", f"t{i}", "research_report", "A", None, f'["word {i}"]') for i in range(60)],
        "run_id string, task string, report_type string, agent string, agent_role_prompt string, reply string",
    )
    brief = lambda messages, model, temperature, max_tokens: messages[0]["content"][-300:-280]
    store = new_folder(spark, "store")
    run = ResearchRun(base, crawled, completer=brief, store=store)
    run.texts.count()
    before = _bytes_shuffled(spark)
    done = run.chunk_summaries.collect()
    # A first paragraph over the limit has an empty chunk before it.
    assert len(done) == 120 and all(r.error is None and bool(r.summary) == (r.part == 1) for r in done)
    assert _bytes_shuffled(spark) - before < 60 * 40_000 / 3
    messages = prompts.summary_messages(F.col("chunk"), F.col("query"))
    whole = prompts.call_table(run.visit_chunks.withColumn("messages", messages), "gpt-3.5-turbo-16k")
    assert {r.prompt_id for r in whole.collect()} == {r.prompt_id for r in infer.completion_store(spark, store).collect()}


def test_quoted_texts_give_the_same_calls(spark, rows, tmp_path):
    # Equal texts under several keys, rows that come twice, texts that come twice, and other texts under one key.
    texts = rows([("a", "one"), ("a", "one"), ("b", "one"), ("b", "two"), ("c", "x" * 5000), ("d", None)], "k string, t string")
    asked = rows([(i, "abcde"[i % 5], f"q{i % 3}") for i in range(40)] + [(0, "a", "q0"), (41, None, "q0")], "id int, k string, q string")
    messages = prompts.summary_messages(F.col("t"), F.col("q"))
    calls = prompts.call_table(asked.join(texts, "k").withColumn("messages", messages), "m")
    calls = stage(calls, "calls")

    def completer(messages, model, temperature, max_tokens):
        with open(tmp_path / uuid.uuid4().hex, "w") as log:
            log.write(str(messages))
        if "two" in str(messages):
            raise RuntimeError("refused")
        return str(messages)[:200]

    shown = lambda done: sorted(map(str, done.select("id", "k", "q", "prompt_id", "content", "error").collect()))
    want = shown(infer.complete_stored(calls, completer, new_folder(spark, "store")))
    made = first = len(list(tmp_path.iterdir()))
    for shared, tasks in ((False, 3), (True, 3), (True, 1), (True, 40)):
        source = stage(texts, "texts")
        quoted = infer.Quoted(source, ["k"], "t", "q", messages, shared)
        store = new_folder(spark, "store")
        assert shown(infer.complete_stored(calls, completer, store, quoted=quoted, tasks=tasks)) == want
        made += first
        assert len(list(tmp_path.iterdir())) == made


def test_calls_that_quote_one_text_are_spread(spark, rows):
    def completer(messages, model, temperature, max_tokens):
        from pyspark import TaskContext

        return str(TaskContext.get().partitionId())

    texts = stage(rows([(i, f"{i} " + "x" * 100) for i in range(50)], "k int, t string"), "texts")
    asked = rows([(i, 7 if i < 1000 else i % 50, f"q{i}") for i in range(1200)], "id int, k int, q string")
    messages = prompts.summary_messages(F.col("t"), F.col("q"))
    calls = prompts.call_table(asked.join(texts, "k").withColumn("messages", messages), "m")
    quoted = infer.Quoted(texts, ["k"], "t", "q", messages, shared=True)
    done = infer.complete_stored(calls, completer, new_folder(spark, "store"), quoted=quoted, tasks=8).collect()
    tasks = lambda k: Counter(r.content for r in done if (r.k == 7) == (k == 7) and (k == 7 or r.k == k))
    assert max(tasks(7).values()) < 2 * 1200 / 8
    assert all(len(tasks(k)) == 1 for k in range(50) if k != 7)


def test_a_stage_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    kept = spark.range(1000).repartition(3, "id")
    kept.count()
    before = shuffled()
    table = stage(spark.range(10_000).repartition(5, "id"), "t")
    deadline = time.time() + 20
    while shuffled() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled() - before
    assert table.count() == 10_000 and spark.conf.get(stages.SHUFFLES_GO, None) is None


def test_scratch_stages_go_with_their_work(spark, rows):
    folders = lambda: {str(p) for p in _listed(spark)}
    stage(rows([(0,)], "x int"), "before")
    before = folders()
    made = stages.stage_alone(spark, lambda: stage(stage(rows([(1,)], "x int"), "a"), "b"), "alone")
    assert [r.x for r in made.collect()] == [1]
    with pytest.raises(OSError), stages.scratch(spark, "work"):
        stage(rows([(1,)], "x int"), "c")
        raise OSError
    assert {f.split("/")[-1].rsplit("-", 1)[0] for f in folders() - before} == {"alone"}
    # Another thread's stages are its own.
    with ThreadPoolExecutor(1) as pool, stages.scratch(spark, "work"):
        other = pool.submit(stage, rows([(2,)], "x int"), "other").result()
    assert [r.x for r in other.collect()] == [2]


def _listed(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(stages.run_folder(spark))
    return [s.getPath() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]


def test_a_dense_group_is_whole_after_one_move(rows):
    data = [(g, i, None if i % 7 == 3 else f"{g}{i}", "e%d" % i if (i % 7 == 3 and g != "c") else None) for g, n in zip("abcd", (3, 4, 9, 30)) for i in range(n)]
    frame = rows(data[::-1], "g string, o long, v string, error string").repartition(3)
    got = {r.g: (r.s, r._failed) for r in ordered_concat(frame, ["g"], "o", "v", "\n", "s", 4, dense=True, errors="error").collect()}
    want = {g: "\n".join(v for h, _, v, _ in data if h == g and v is not None) for g in "abcd"}
    assert got == {g: (want[g], "e3" if g in "bd" else None) for g in "abcd"}


def test_the_first_failed_chunk_is_a_findings_error(spark, rows):
    def completer(messages, model, temperature, max_tokens):
        if "bad" in messages[0]["content"][:40]:
            raise RuntimeError("refused " + messages[0]["content"][3:7])
        return "fine"

    pages_ = [(1, "u", "<p>word one</p>"), (2, "v", "<p>word two</p><p>bad2 x</p><p>bad3 x</p>")]
    base = rows(
        [("r", "t", "research_report", "A", None, '["word"]')],
        "run_id string, task string, report_type string, agent string, agent_role_prompt string, reply string",
    )
    settings = JobSettings(chunk_chars=10)
    run = ResearchRun(base, rows(pages_, "page_id long, url string, html string"), settings, completer, new_folder(spark, "store"))
    found = {r.url: (r.status, r.content) for r in run.findings.collect()}
    assert found["u"] == ("ok", "Information gathered from url u: fine")
    assert found["v"] == ("error", "Error processing the url v: refused bad2")
