import glob
import json
import os
import random
import time
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier import schemas
from dossier.operators.infer import extractive_completer
from dossier.operators.runlog import log_rows
from dossier.operators.report_text import report_messages, report_text
from dossier.plans import catalog
from dossier.plans import workload as given
from dossier.sinks.batches import BatchTables
from dossier.sinks.outputs import append_run_log, read_run_log, stream_run_log
from dossier.sinks.stage import new_folder, run_folder
from dossier.sources.tables import stream_deltas, stream_messages
from dossier.streaming.deltas import stream_report_messages, stretches
from dossier.streaming.requests import run_requests
from dossier.streaming.runs import ResearchStream
from dossier.streaming.state import disk_state


def plain_messages(deltas):
    sent, buffer = [], ""
    for delta in deltas:
        if delta is not None:
            buffer += delta
            if "\n" in buffer:
                sent.append(buffer)
                buffer = ""
    return sent, buffer


def runs(seed):
    rng = random.Random(seed)
    out = {}
    for r in range(6):
        out[f"r{r}"] = [
            None if rng.random() < 0.1 else "".join(rng.choice("ab \n") for _ in range(rng.randrange(5)))
            for _ in range(rng.randrange(1, 40))
        ]
    out["sample"] = ["He", "llo\nwo", "rld", " x\n\ny", "tail"]
    return out


def table(rows, data):
    return rows(
        [(r, i, d, i == len(ds) - 1) for r, ds in data.items() for i, d in enumerate(ds)], schemas.DELTA
    )


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_batch_messages_and_text(rows, block):
    data = runs(5)
    deltas = table(rows, data)
    wanted = {(r, i, m) for r, ds in data.items() for i, m in enumerate(plain_messages(ds)[0])}
    got = {(m.run_id, m.msg_no, m.output) for m in report_messages(deltas, block).collect()}
    assert got == wanted
    whole = {r.run_id: r.report for r in report_text(deltas, block).collect()}
    for run, ds in data.items():
        sent, tail = plain_messages(ds)
        assert (whole.get(run) or "") == "".join(sent) + tail


@pytest.mark.parametrize("order", ["forward", "reversed", "mixed"])
@pytest.mark.parametrize("cut", [3, 11, 1000])
def test_stream_equals_batch(spark, rows, cut, order):
    data = runs(cut)
    source, out, state = (new_folder(spark, n) for n in ("deltas", "messages", "state"))
    deltas = table(rows, data)
    longest = max(map(len, data.values()))
    starts = list(range(0, longest, cut))
    if order == "reversed":
        starts.reverse()
    elif order == "mixed":
        random.Random(1).shuffle(starts)
        starts.append(starts[0])  # one file comes twice
    for start in starts:
        part = deltas.where(F.col("seq").between(start, start + cut - 1)).coalesce(1)
        part.write.mode("append").parquet(source)
    sent = stream_report_messages(stream_deltas(spark, source, files_per_trigger=1))
    with disk_state(spark):
        (
            sent.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            .trigger(availableNow=True).start().awaitTermination()
        )
    got = {(m.run_id, m.msg_no, m.output) for m in spark.read.schema(sent.schema).parquet(out).collect()}
    assert got == {(m.run_id, m.msg_no, m.output) for m in report_messages(deltas).collect()}


def test_log_stream(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    messages = stream_messages(spark, str(tmp_path)).select(F.col("message").alias("run_id"))
    log, state = new_folder(spark, "log"), new_folder(spark, "state")
    lines = log_rows(messages, 0, 0, "request", F.lit("hello"))
    for _ in range(2):  # a second start finds nothing new and appends nothing
        stream_run_log(lines, log, state).awaitTermination()
    assert {r.run_id for r in spark.read.parquet(log).collect()} == {"one", "two"}
    assert spark.read.parquet(log).count() == 2


def test_requests_stream(spark, tmp_path):
    good = {"task": "t1", "report_type": "research_report", "agent": "Default Agent"}
    (tmp_path / "a.txt").write_text("start " + json.dumps(good) + "\nhello\nstart {\n")
    (tmp_path / "b.txt").write_text("start " + json.dumps(dict(good, task="t2")) + "\nstart {}\n")
    folder = new_folder(spark, "requests")

    def save(requests, batch_id):
        requests.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    messages = stream_messages(spark, str(tmp_path), files_per_trigger=1)
    run_requests(messages, save, new_folder(spark, "state")).awaitTermination()
    got = spark.read.parquet(folder)
    assert {r.task for r in got.collect()} == {"t1", "t2"}
    assert got.columns == ["task", "report_type", "agent", "batch"]


def started(rows, spark, batches, **times):
    """A running stream over files that the caller adds, one batch each."""
    source, out, state = (new_folder(spark, n) for n in ("deltas", "messages", "state"))
    rows([], schemas.DELTA).write.parquet(source)
    sent = stream_report_messages(stream_deltas(spark, source), **times)
    with disk_state(spark):
        query = (
            sent.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            .trigger(processingTime="100 milliseconds").start()
        )

    def arrive(data):
        rows(data, schemas.DELTA).coalesce(1).write.mode("append").parquet(source)
        if times:
            time.sleep(6)  # a stream that keeps time has a next batch at all times, so there is no end to wait for
        else:
            query.processAllAvailable()

    def messages():
        return sorted((m.run_id, m.msg_no, m.output) for m in spark.read.schema(sent.schema).parquet(out).collect())

    return query, arrive, messages


def test_an_ended_run_sends_nothing_again(rows, spark):
    query, arrive, messages = started(rows, spark, 3)
    deltas = [("r", 0, "a", False), ("r", 1, "b\n", False), ("r", 2, "c\n", True)]
    try:
        for data in ([deltas[2]], deltas[:2], deltas, [("r", 3, "late\n", False)]):
            arrive(data)
        assert messages() == [("r", 0, "ab\n"), ("r", 1, "c\n")]
    finally:
        query.stop()


def test_a_silent_run_is_given_up(rows, spark):
    query, arrive, messages = started(rows, spark, 3, idle_ms=3000, remember_ms=600_000)
    try:
        arrive([("r", 0, "a\n", False), ("r", 1, "b", False), ("r", 5, "f\n", False)])
        arrive([("s", 0, "x\n", True)])
        until = time.time() + 60
        while len(messages()) < 3 and time.time() < until:
            time.sleep(0.5)
        arrive([("r", 2, "c\n", False), ("r", 3, "d\n", True)])
        assert messages() == [("r", 0, "a\n"), ("r", 1, None), ("s", 0, "x\n")]
    finally:
        query.stop()


def run_stream(spark, sf_dir, calls):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    answer = extractive_completer()

    def completer(messages, model, temperature, max_tokens):
        with open(os.path.join(calls, uuid.uuid4().hex), "w"):
            return answer(messages, model, temperature, max_tokens)

    return ResearchStream(spark, pages, completer, new_folder(spark, "store"), new_folder(spark, "out"))


def start_message(task, **more):
    return "start " + json.dumps({"task": task, "report_type": "research_report", "agent": "Default Agent"} | more)


def test_a_batch_handed_over_twice_leaves_one_result(rows, spark, sf_dir, tmp_path, monkeypatch):
    stream = run_stream(spark, sf_dir, str(tmp_path))
    first = rows([("a", start_message("and the of things")), ("b", "hello"), ("c", start_message("x", report_type=""))], "run_id string, message string")
    commit = stream.results._commit

    def broken(batch, attempt):
        raise OSError("lost")

    monkeypatch.setattr(stream.results, "_commit", broken)
    with pytest.raises(OSError):
        stream.run_batch(first, 0)
    monkeypatch.setattr(stream.results, "_commit", commit)
    made = len(os.listdir(tmp_path))
    assert made > 0 and not stream.results.done(0)
    assert stream.run_batch(first, 0) is True
    assert len(os.listdir(tmp_path)) == made  # the calls of the lost attempt were stored
    assert stream.run_batch(first, 0) is False
    assert [r.run_id for r in stream.results.read("reports").collect()] == ["a"]
    told = {r.run_id: r.accepted for r in stream.results.read("requests").collect()}
    assert told == {"a": True, "c": False}
    assert stream.results.read("requests").count() == 2
    assert stream.results.read("log").where("stage = 'path'").count() == 1
    second = rows([("d", start_message("and the of things"))], "run_id string, message string")
    assert stream.run_batch(second, 1) is True
    assert sorted(r.run_id for r in stream.results.read("reports").collect()) == ["a", "d"]


def test_of_two_commits_of_a_batch_one_counts(rows, spark):
    tables = BatchTables(spark, new_folder(spark, "out"))
    assert tables.put(3, {"t": rows([(1,)], "x int"), "u": rows([], "y int")})
    assert not tables.put(3, {"t": rows([(2,)], "x int")})
    rows([(2,)], "x int").write.parquet(f"{tables.path}/tables/t/batch=3/attempt=try-zz")
    assert [r.x for r in tables.read("t").collect()] == [1]
    tables._commit(3, "try-zz")
    assert [r.x for r in tables.read("t").collect()] == [1] and tables.read("u").collect() == []


def test_a_stored_log_lies_by_run(spark, rows):
    log = new_folder(spark, "log")
    lines = log_rows(rows([(f"r{i % 40}",) for i in range(400)], "run_id string"), 0, 0, "request", F.lit("hello"))
    append_run_log(lines, log)
    append_run_log(lines, log)
    assert read_run_log(spark, log).count() == 800
    one = read_run_log(spark, log, "r7")
    assert one.count() == 20 and len({f for f in one.select("_metadata.file_path").distinct().collect()}) <= 2


def test_a_state_is_handed_a_row_per_run_and_batch(rows, spark):
    source = new_folder(spark, "deltas")
    texts = [f"w{i}\n" if i % 7 == 0 else f"w{i} " for i in range(2000)]
    data = [(r, i, None if i == 5 else t, i == len(texts) - 1) for r in ("a", "b") for i, t in enumerate(texts)]
    deltas = rows(data, schemas.DELTA)
    deltas.coalesce(1).write.parquet(source)
    out, state = new_folder(spark, "messages"), new_folder(spark, "state")
    with disk_state(spark):
        writer = stream_report_messages(stream_deltas(spark, source)).writeStream.format("parquet").option("path", out)
        query = writer.option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    assert shuffled_rows(spark, query) <= 4
    got = {tuple(r) for r in spark.read.parquet(out).select("run_id", "msg_no", "output").collect()}
    assert got == {(m.run_id, m.msg_no, m.output) for m in report_messages(deltas).collect()}


def shuffled_rows(spark, query):
    """Rows that the stages of a stream have written for a shuffle."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    store = context._jsc.sc().statusStore()
    none = context._gateway.new_array(context._jvm.double, 0)
    jobs = store.jobsList(None)
    mine = {}
    for i in range(jobs.size()):
        job = jobs.apply(i)
        if job.jobGroup().isDefined() and job.jobGroup().get() == str(query.runId):
            ids = job.stageIds()
            mine |= {ids.apply(k): None for k in range(ids.size())}
    stages = store.stageList(None, False, False, none, context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()) if stages.apply(i).stageId() in mine)


def test_a_second_delivery_is_written_by_all_tasks(spark, sf_dir, tmp_path):
    # Four files of turns: no step may draw them into one task.
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    folder = str(tmp_path / "in")
    turns.repartition(4, "conv_id").write.parquet(f"{folder}/conversations.parquet")
    got = catalog.report_messages_replayed(spark, folder)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in report_messages(given.deltas(spark, folder)).collect()}
    deltas = sorted(glob.glob(f"{run_folder(spark)}/deltas-*"), key=os.path.getmtime)[-1]
    assert len(glob.glob(f"{deltas}/*.parquet")) == 2 * spark.read.parquet(f"{folder}/conversations.parquet").rdd.getNumPartitions() > 2


def test_stretches_join_deltas_that_follow_each_other():
    data = [("a", 1, "b\n", False), ("b", 0, "x", None), ("a", 0, "ä", False), ("a", 3, "d", True), ("a", 4, "e", False), ("a", 1, "no", False), (None, 7, None, False)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("run_id", "seq", "delta", "is_end"), row)) for row in data])
    got = [r for made in stretches(iter([batch, batch.slice(0, 0)])) for r in made.to_pylist()]
    plain = {(r["run_id"], r["seq"], r["n"], r["text"], np.frombuffer(r["ends"], "<i4").tobytes().hex(), r["breaks"].hex(), r["is_end"]) for r in got}
    number = lambda *ns: b"".join(n.to_bytes(4, "little") for n in ns).hex()
    assert plain == {
        ("a", 0, 2, "äb\n", number(1, 3), number(1), False),
        ("a", 3, 1, "d", number(1), "", True),
        ("a", 4, 1, "e", number(1), "", False),
        ("b", 0, 1, "x", number(1), "", False),
        (None, 7, 1, "", number(0), "", False),
    }


def test_what_a_batch_stages_goes_with_it(rows, spark, sf_dir, tmp_path):
    stream = run_stream(spark, sf_dir, str(tmp_path))

    def staged():
        path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
        return {str(s.getPath()) for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}

    before = staged()
    assert stream.run_batch(rows([("a", start_message("and the of things"))], "run_id string, message string"), 0) is True
    assert {path.split("/")[-1].rsplit("-", 1)[0] for path in staged() - before} == {"store", "out"}
    assert [r.run_id for r in stream.results.read("reports").collect()] == ["a"]
