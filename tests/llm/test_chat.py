import json
import random

import pytest

from drillframe.llm import chat, queries
from drillframe.llm.common import table
from drillframe.llm.queries import op9_chat

from ..oracle import compare

SCHEMA = "conv_id long, turn long, role string, text string, calls string, links string"


def call(id, name="search", **arguments):
    return f"<tool_call>{json.dumps({'id': id, 'name': name, 'arguments': arguments})}</tool_call>"


def result(id, content):
    return json.dumps({"tool_call_id": id, "content": content})


def rows_of(spark, rows):
    got = chat.format_chat(spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)).collect()
    return {(r.conv_id, r.turn): (r, json.loads(r.message)) for r in got}


def test_linking_order_and_validation(spark):
    ref = {"$result": "a"}
    got = rows_of(spark, [
        (1, 0, "user", "please"),
        (1, 1, "assistant", "text " + call("c", query={"$result": "b"}) + call("b", query=ref, limit=3) + call("a", query="x") + call("bad", query="", limit=0)),
        (1, 2, "tool", result("a", {"z": 1, "b": [2]})),
        (1, 3, "tool", result("b", "two")),
        (1, 4, "tool", result("nobody", "?")),
        (1, 5, "assistant", call("a", query="again") + call("n", "unknown", q=1) + "<tool_call>{broken</tool_call>"),
        (2, 1, "assistant", call("a", query="x") + call("p", query={"$result": "q"}) + call("q", query={"$result": "p"}) + call("w", query={"$result": "missing"})),
    ])
    first, message = got[1, 1]
    assert (first.n_calls, first.n_linked, first.n_invalid) == (4, 2, 1)
    assert [(c["id"], c["level"], c["result_turn"]) for c in message["tool_calls"]] == [("a", 0, 2), ("bad", 0, None), ("b", 1, 3), ("c", 2, None)]
    assert message["tool_calls"][1]["verdict"].startswith("$") and message["content"] == "text "
    assert got[1, 2][0].answers_turn == 1 and got[1, 2][1] == {"role": "tool", "content": {"z": 1, "b": [2]}, "tool_call_id": "a", "call_turn": 1}
    assert got[1, 4][0].answers_turn == -1 and got[1, 0][0].answers_turn is None
    assert {c["id"]: c["verdict"] for c in got[1, 5][1]["tool_calls"]} == {"a": "duplicate", "n": "unknown_tool", None: "malformed"}
    assert {c["id"]: c["level"] for c in got[2, 1][1]["tool_calls"]} == {"a": 0, "p": -1, "q": -1, "w": -1}
    assert got[2, 1][0].n_linked == 0
    assert all(r.message == chat.canonical(m) for r, m in got.values())


def test_long_chain_in_one_conversation(spark):
    calls = [call("s0", query="x")] + [call(f"s{i}", query={"$result": f"s{i - 1}"}) for i in range(1, 6)]
    got = rows_of(spark, [(7, i, "assistant", c) for i, c in enumerate(calls)])
    assert [got[7, i][1]["tool_calls"][0]["level"] for i in range(6)] == list(range(6))


@pytest.mark.parametrize("value, ok", [
    ({"query": "x"}, True), ({"query": 1}, False), ({}, False), ({"query": "x", "more": 1}, False), ({"query": "x", "limit": 101}, False),
    ({"query": "x", "limit": True}, False), ({"query": {"$result": "a"}}, True), ([], False), ({"query": "x", "limit": 2.0}, True),
])
def test_schema(value, ok):
    assert (chat.violation(value, chat.SCHEMAS["search"]) is None) == ok


def test_nested_schema():
    schema = {"type": "object", "properties": {"xs": {"type": "array", "items": {"enum": ["a", "b"]}}}}
    assert chat.violation({"xs": ["a", "c"]}, schema) == "$.xs[1]: not in enum"
    assert chat.references({"a": [{"$result": "1"}, {"b": {"$result": 2}}]}) == {"1", "2"}


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 1, "tool", "not json"), (1, 2, "tool", "[1]"), (None, 1, "assistant", call("a", query="x")), (1, 3, "assistant", call("k", query="x") + "<tool_call>[]</tool_call>")]
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)
    got = chat.format_chat(df).collect()
    assert len(got) == len(rows)
    assert chat.format_chat(df.limit(0)).count() == 0


MALFORMED = [
    call("a", query="x", limit=1).replace('"limit": 1', '"limit": ' + "9" * 400), call("a", query="x").replace('"x"', '"\\ud800"'), call("\ud800", query="\udc00x"),
    call("a", query="x", limit=1).replace('"limit": 1', '"limit": NaN'), call("a", query="x", limit=1).replace('"limit": 1', '"limit": 1e999'), call("a", query="x", limit=1).replace('"limit": 1', '"limit": -Infinity'),
    call("a", query="x").replace('"x"', "[" * 5000 + "]" * 5000), call("a", query="x").replace('"x"', "9" * 5000), call("a", query="x").replace('"x"', '{"$result":{"$result":[1]}}'),
    call({"a": 1}, query="x"), call(True, query="x"), call(7, query="x"), "<tool_call>" * 1000, "<tool_call></tool_call>", '{"tool_call_id": "\\ud800", "content": "\\udfff"}',
    '{"tool_call_id": 1, "content": ' + "[" * 3000 + "]" * 3000 + "}", '{"tool_call_id": 1, "content": [NaN]}', '{"tool_call_id": 1.5}', "[" * 100_000, '{"tool_call_id": "a"}', "null",
]


def test_ordinary_malformed_input(spark):
    """No text stops the job, and all that comes out is strict JSON."""
    rows = [(n, t, r, text, "x", None) for n, text in enumerate(MALFORMED) for t, r in enumerate(("assistant", "tool"))]
    got = chat.format_chat(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert chat.canonical(json.loads(r.message, parse_constant=chat._no_constant)) == r.message
        r.message.encode()


def test_canonical_numbers():
    assert chat.canonical(chat.parse('{"b":1.0,"a":-0.0,"c":1e3,"d":0.5,"e":1e300}')) == '{"a":0,"b":1,"c":1000,"d":0.5,"e":1e+300}'


def slow_levels(needs):
    """Longest chains by plain iteration."""
    level, changed = {}, True
    while changed:
        changed = False
        for id, ns in needs.items():
            if id not in level and all(n in level for n in ns):
                level[id], changed = 1 + max((level[n] for n in ns), default=-1), True
    return level


def slow_links(rows):
    """{(turn, place): (id, level, result_turn)} of primary calls, and {turn: answers_turn}, of one conversation."""
    calls, results = {}, {}
    for turn, role, ids, answered in rows:
        for place, (id, needs) in enumerate(ids):
            if id not in calls or (turn, place) < calls[id][:2]:
                calls[id] = (turn, place, needs)
        if role == "tool" and answered is not None:
            results[answered] = min(turn, results.get(answered, turn))
    level = slow_levels({id: needs for id, (_, _, needs) in calls.items()})
    found = {(t, p): (id, level.get(id, -1), results.get(id)) for id, (t, p, _) in calls.items()}
    answers = {t: (calls[a][0] if a in calls and results[a] == t else -1) for t, role, _, a in rows if role == "tool" and a is not None}
    return found, answers


@pytest.mark.parametrize("conversations, turns, chunk", [(10_000, 5, 50_000), (3, 400, 7), (40, 40, 3)])
def test_random_conversations_equal_brute_force(spark, monkeypatch, conversations, turns, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rng = random.Random(turns)
    made, rows = {}, []
    for conv in range(conversations):
        names = [f"i{n}" for n in range(turns)]
        for turn in range(rng.randint(1, turns)):
            if rng.random() < 0.3:
                answered = rng.choice(names)
                made.setdefault(conv, []).append((turn, "tool", [], answered))
                rows.append((conv, turn, "tool", result(answered, turn)))
                continue
            ids = []
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(turns)
                # Mostly earlier names, so that chains grow long; now and then any, so that some never end.
                needs = {names[rng.randrange(turns) if rng.random() < 0.05 or not at else rng.randrange(max(0, at - 3), at)] for _ in range(rng.randint(0, 2))}
                ids.append((names[at], needs))
            made.setdefault(conv, []).append((turn, "assistant", ids, None))
            rows.append((conv, turn, "assistant", "".join(call(i, query=[{"$result": n} for n in sorted(needs)]) for i, needs in ids)))
    got = rows_of(spark, rows)
    assert len(got) == len(rows)
    deepest = 0
    for conv, said in made.items():
        found, answers = slow_links(said)
        for turn, role, ids, answered in said:
            r, message = got[conv, turn]
            listed = [(c["id"], c["level"], c["result_turn"]) for c in message.get("tool_calls", []) if c["verdict"] != "duplicate"]
            want = [found[turn, p] for p in range(len(ids)) if (turn, p) in found]
            assert sorted(listed, key=str) == sorted(want, key=str)
            assert sum(c["verdict"] == "duplicate" for c in message.get("tool_calls", [])) == len(ids) - len(want)
            assert r.answers_turn == answers.get(turn)
            deepest = max(deepest, *[k for _, k, _ in want], 0)
    assert deepest >= 3


def test_deep_chain_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 500)
    n = 2000
    rows = [(1, i, f"s{i}", [f"s{i - 1}"] if i else []) for i in range(n)]
    got = chat.levels(spark.createDataFrame(rows, "conv_id long, turn long, id string, needs array<string>")).collect()
    assert {r.id: r.level for r in got} == {f"s{i}": i for i in range(n)}
    # One turn holds all: dealt by identifier.
    flat = chat.levels(spark.createDataFrame([(1, 0, f"s{i}", ["s0"] if i else []) for i in range(n)], "conv_id long, turn long, id string, needs array<string>"))
    assert {r.level for r in flat.where("id <> 's0'").collect()} == {1}


def test_query_equals_sql(spark, sf):
    assert compare(op9_chat(spark, sf), sf, chat.ORACLE) == []


def test_query_keeps_every_message(spark, sf):
    rows = table(spark, sf, "conversations").collect()
    got = op9_chat(spark, sf).collect()
    want = sorted((r.conv_id, r.turn, chat.canonical({"role": r.role, "content": r.text})) for r in rows)
    assert sorted((r.conv_id, r.turn, r.message) for r in got) == want


def test_linking_equals_sql(spark, sf):
    out = queries.chat_linking(spark, sf)
    assert compare(out, sf, queries.CHAT_LINKING) == []
    sums = out.selectExpr("max(level)", "sum(n_linked)", "sum(n_invalid)", "count_if(answers_turn = -1)", "count_if(answers_turn >= 0)").first()
    assert all(x > 0 for x in sums)
