import json

import pytest
from pyspark.sql import functions as F

from dossier.functions import fixed_values as fixed
from dossier.operators import prompts, requests


def test_ingest_and_validate(rows):
    full = {"task": "t", "report_type": "research_report", "agent": "Default Agent", "more": 1}
    messages = rows(
        [
            (1, "start " + json.dumps(full)),
            (2, "stop " + json.dumps(full)),
            (3, 'start {"task": "t"'),
            (4, 'start {"task": "t", "report_type": "", "agent": "a"}'),
            (5, 'start {"task": "t", "agent": "a"}'),
            (6, "start []"),
            (7, "start"),
            (8, "start " + json.dumps(full) + " xx"),
            (9, "start " + json.dumps(full).replace('"', "'")),
            (10, "start " + json.dumps(full) + ', {"task": "u"}'),
            (11, "start " + json.dumps(full) + '}, "w": {'),
        ],
        "id int, message string",
    )
    got = {r.id: r for r in requests.validate(requests.ingest(messages)).collect()}
    assert set(got) == {1, *range(3, 12)}
    assert (got[1].task, got[1].report_type, got[1].agent) == ("t", "research_report", "Default Agent")
    assert got[1].accepted and got[1].error is None
    assert {got[i].error for i in (3, 7, 8, 9, 10, 11)} == {"malformed request"}
    assert {got[i].error for i in (4, 5, 6)} == {fixed.NOT_ENOUGH_PARAMETERS}
    assert not any(got[i].accepted for i in range(3, 12))


def test_role_lookup(rows):
    asked = rows(
        [(1, "Travel Agent", None), (2, "travel agent", ""), (3, "Travel Agent", "mine"), (4, None, None)],
        "id int, agent string, agent_role_prompt string",
    )
    got = {r.id: r.role_prompt for r in requests.resolve_role(asked).collect()}
    assert got[1] == fixed.ROLE_PROMPTS["Travel Agent"]
    assert got[2] == got[4] == "No such agent"
    assert got[3] == "mine"


def test_auto_role(rows):
    replies = rows(
        [
            (1, '{"agent": "A", "agent_role_prompt": "P"}'),
            (2, '{"agent: "A"}'),
            (3, None),
            (4, '{"agent": "A"}'),
            (5, "{}"),
            (6, '{"agent": "A", "agent_role_prompt": "P"} I hope this helps.'),
            (7, "{'agent': 'A'}"),
        ],
        "id int, reply string",
    )
    got = {r.id: (r.agent, r.agent_role_prompt) for r in requests.auto_role(replies).collect()}
    default = ("Default Agent", fixed.ROLE_PROMPTS["Default Agent"])
    assert got == {1: ("A", "P"), 2: default, 3: default, 4: ("A", None), 5: (None, None), 6: default, 7: default}


def test_settled_agents(rows):
    asked = rows(
        [(1, "t", "r", "Auto Agent", None), (2, "t", "r", "Travel Agent", None), (3, "t", "r", "Auto Agent", None), (4, "t", "r", "Auto Agent", None)],
        "id int, task string, report_type string, agent string, error string",
    )
    replies = rows([(1, '{"agent": "A", "agent_role_prompt": "P"}'), (2, '{"agent": "B"}'), (4, "{}")], "id int, reply string")
    settled = requests.validate(requests.settle_agents(asked, replies, ["id"]))
    got = {r.id: (r.agent, r.agent_role_prompt, r.accepted) for r in settled.collect()}
    default = fixed.ROLE_PROMPTS["Default Agent"]
    assert got == {
        1: ("A", "P", True), 2: ("Travel Agent", None, True), 3: ("Default Agent", default, True), 4: (None, None, False),
    }


def test_list_fanout(rows):
    replies = rows(
        [(1, '["a", "", "b"]'), (2, "not json"), (3, "[]"), (4, '{"a": 1}'), (5, None), (6, '["x"'),
         (7, '["a"] garbage'), (8, "['a','b']"), (9, '[{"x":1},2]'), (10, '["a", null]'), (11, ' ["c"]\n'), (12, '["a"], ["b"]'), (13, '["a", 3]')],
        "id int, reply string",
    )
    got = sorted(
        (r.id, -1 if r.query_idx is None else r.query_idx, r["query"], r.error)
        for r in requests.list_fanout(replies, "query").collect()
    )
    bad = "malformed reply"
    assert got == [
        (1, 0, "a", None), (1, 1, "", None), (1, 2, "b", None),
        *((i, -1, None, bad) for i in (2, 4, 5, 6, 7, 8, 9, 10)),
        (11, 0, "c", None),
        *((i, -1, None, bad) for i in (12, 13)),
    ]


def test_list_limit(rows):
    replies = rows([(1, '["a", "b", "c"]'), (2, "[")], "id int, reply string")
    got = requests.list_fanout(replies, "query", 2).collect()
    assert sorted((r.id, r["query"] or "") for r in got) == [(1, "a"), (1, "b"), (2, "")]


def test_strict_calls(rows):
    schema = "id int, model string, max_tokens int, stream boolean, target string"
    good = prompts.require_valid(rows([(1, "m", 1, False, None)], schema))
    assert good.columns == ["id", "model", "max_tokens", "stream", "target"] and good.count() == 1
    with pytest.raises(Exception, match="Model cannot be None"):
        prompts.require_valid(rows([(1, None, 1, False, None)], schema)).collect()


def test_report_types(rows):
    asked = rows([(1, "outline_report"), (2, "poem"), (3, None)], "id int, report_type string")
    got = {r.id: r.known for r in prompts.resolve_report_type(asked).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_report_prompt_slots(rows):
    runs = rows(
        [(1, "resource_report", "role", "the {question}", "why {research_summary}?"), (2, "poem", "r", "s", "q")],
        "run_id int, report_type string, role_prompt string, research_summary string, task string",
    )
    got = prompts.report_prompts(runs).collect()
    assert [r.run_id for r in got] == [1]
    wanted = fixed.REPORT_PROMPTS["resource_report"].replace("{question}", "why @?")
    wanted = wanted.replace("{research_summary}", "the {question}").replace("@", "{research_summary}")
    assert got[0].report_prompt == wanted


def test_call_checks(rows):
    calls = rows(
        [
            (1, "m", 8001, False, None),
            (2, "m", 8002, False, None),
            (3, None, 9000, True, None),
            (4, "m", None, True, None),
            (5, "m", None, True, "viewer"),
        ],
        "id int, model string, max_tokens int, stream boolean, target string",
    )
    got = {r.id: r.error for r in prompts.validate_calls(calls).collect()}
    assert got == {
        1: None,
        2: "Max tokens cannot be more than 8001, but got 8002",
        3: "Model cannot be None",
        4: "Websocket cannot be None when stream is True",
        5: None,
    }


def test_prompt_id_covers_all_call_fields(rows):
    frame = rows([("a", "q"), ("a", "q"), ("b", "q")], "chunk string, question string").select(
        prompts.summary_messages(F.col("chunk"), F.col("question")).alias("messages")
    )
    fast = [r.prompt_id for r in prompts.call_table(frame, "fast").collect()]
    smart = [r.prompt_id for r in prompts.call_table(frame, "smart").collect()]
    assert len(set(fast)) == 2 and not set(fast) & set(smart)
