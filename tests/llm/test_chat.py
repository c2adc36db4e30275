import json

import pytest

from notewell.llm.chat import canonical, link_tool_calls, problem

SCHEMA = {"dose": {"type": "object", "required": ["mg"], "properties": {"mg": {"type": "integer", "minimum": 1}, "unit": {"enum": ["mg", "g"]}}, "additionalProperties": False}}
KIND = "conv_id long, turn long, role string, text string, message string"


def call(i, name, args):
    return f"<tool_call>{json.dumps({'id': i, 'name': name, 'arguments': args})}</tool_call>"


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "user", "hi", ""),
        (1, 1, "assistant", "ok " + call("c1", "dose", {"mg": 5}) + call("c2", "dose", {"mg": 0, "x": 1}), ""),
        (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": {"b": 1, "a": 2.0}}), ""),
        (1, 3, "tool", '<tool_result>{"id": "zz", "content": null}</tool_result>', ""),
        (1, 4, "tool", json.dumps({"tool_call_id": "late", "content": 1}), ""),
        (1, 6, "assistant", call("late", "other", {}), ""),
        (1, 7, "tool", "broken {", ""),
        (2, 0, "assistant", "<tool_call>{nope</tool_call>", ""),
        (2, 1, "tool", json.dumps({"tool_call_id": "c1"}), ""),
        (None, 0, None, None, ""),
    ]
    df = spark.createDataFrame(rows, KIND)
    out = {(r.conv_id, r.turn): r for r in link_tool_calls(df, SCHEMA).collect()}
    assert len(out) == len(rows)
    a = out[1, 1]
    assert (a.n_calls, a.n_answered, a.n_invalid) == (2, 1, 1) and a.problems == ["$.mg: out of range"]
    assert a.message == '{"content":"ok","role":"assistant","tool_calls":[{"arguments":{"mg":5},"id":"c1","name":"dose"},{"arguments":{"mg":0,"x":1},"id":"c2","name":"dose"}]}'
    assert out[1, 2].result_status == "linked" and out[1, 2].message == '{"content":{"a":2,"b":1},"role":"tool","tool_call_id":"c1"}'
    assert out[1, 3].result_status == "orphan" and out[2, 1].result_status == "orphan" and out[1, 7].result_status == "unreadable"
    assert (out[1, 4].result_status, out[1, 4].order_turn, out[1, 4].order_rank) == ("early", 6, 1)
    assert out[1, 6].problems == ["unknown tool"] and out[2, 0].problems == ["not JSON"] and out[None, 0].message == '{"content":null,"role":null}'
    order = sorted((r.order_turn, r.order_rank, r.order_own) for r in out.values() if r.conv_id == 1)
    assert [t for *_, t in order] == [0, 1, 2, 3, 6, 4, 7]
    assert link_tool_calls(df.limit(0)).count() == 0 and link_tool_calls(df.unionByName(df)).count() == 2 * len(rows)


def test_canonical_and_schemas():
    assert canonical({"b": [1.0, "é"], "a": None}) == '{"a":null,"b":[1,"é"]}'
    with pytest.raises(ValueError):
        canonical(float("nan"))
    assert problem({"mg": True}, SCHEMA["dose"]) == "$.mg: not of type integer" and problem({}, SCHEMA["dose"]) == "$.mg: missing"
    assert problem({"mg": 2, "unit": "kg"}, SCHEMA["dose"]) and problem({"mg": 2, "q": 1}, SCHEMA["dose"]) and problem([1, "a"], {"items": {"type": "integer"}}) == "$[1]: not of type integer"
    assert problem({"mg": 2}, SCHEMA["dose"]) is None


def test_odd_names_surrogates_and_null_turns(spark):
    rows = [
        (1, 0, "assistant", '<tool_call>{"id": "a", "name": ["x"], "arguments": {"k\\ud800": "v\\udfff"}}</tool_call>', ""),
        (1, 1, "tool", '{"tool_call_id": "a", "content": "\\ud83d\\ude00 \\ud800"}', ""),
        (2, None, "assistant", call("n", "dose", {"mg": 1}), ""),
        (2, 5, "tool", '{"tool_call_id": "n"}', ""),
        (3, 4, "assistant", call("t", "dose", {"mg": 1}), ""),
        (3, None, "tool", '{"tool_call_id": "t"}', ""),
        (4, 0, "assistant", "word " * 200_000 + call("t", "dose", {"mg": 1}), ""),
    ]
    out = {(r.conv_id, r.role): r for r in link_tool_calls(spark.createDataFrame(rows, KIND), SCHEMA).collect()}
    assert out[1, "assistant"].problems == ["unknown tool"] and "k\ufffd" in out[1, "assistant"].message
    assert json.loads(out[1, "tool"].message)["content"] == "\U0001f600 \ufffd" and out[1, "tool"].result_status == "linked"
    assert out[2, "tool"].result_status == "linked" and out[2, "assistant"].n_answered == 1 and out[2, "tool"].order_turn == 5
    assert out[3, "tool"].result_status == "early" and (out[3, "tool"].order_turn, out[3, "tool"].order_rank) == (4, 1)
    assert out[4, "assistant"].n_calls == 1 and len(out[4, "assistant"].message) > 900_000


def test_the_query_equals_a_plain_version(spark):
    import duckdb

    from notewell.llm.queries import TOOLS, op5_tool_links, tool_chats
    from notewell.llm.runtime import table

    d = "/root/testdata/sf0.001"
    chats = [tuple(r) for r in tool_chats(table(spark, d, "conversations")).collect()]
    n, calls = duckdb.sql(f"select count(*), count(*) filter (role = 'assistant') from '{d}/conversations.parquet'").fetchall()[0]
    assert sum(r != "tool" for _, _, r, _ in chats) == n and 0.5 < sum(r == "tool" for _, _, r, _ in chats) / calls < 1
    made, want = {}, {}
    for c, t, r, x in chats:
        if r == "assistant":
            made[c, json.loads(x.split("<tool_call>")[1].split("</tool_call>")[0])["id"]] = t
    asked = {(c, json.loads(x)["tool_call_id"]) for c, _, r, x in chats if r == "tool"}
    for c, t, r, x in chats:
        if r == "tool":
            at = made.get((c, json.loads(x)["tool_call_id"]))
            status = "orphan" if at is None else "early" if at > t else "linked"
            want[c, t, r] = (at if status == "early" else t, int(status == "early"), t, status, 0, 0, [])
        elif r == "assistant":
            got = json.loads(x.split("<tool_call>")[1].split("</tool_call>")[0])
            a, bad = got["arguments"], []
            if got["name"] == "other":
                bad = ["unknown tool"]
            elif got["name"] == "lookup":
                bad = [] if 1 <= a["limit"] <= 5 else ["$.limit: out of range"]
            elif a["unit"] == "words":
                bad = ["$.unit: not one of the listed values"]
            want[c, t, r] = (t, 0, t, None, 1, int((c, got["id"]) in asked), bad)
        else:
            want[c, t, r] = (t, 0, t, None, 0, 0, [])
    out = op5_tool_links(spark, d).collect()
    assert {(r.conv_id, r.turn, r.role): (r.order_turn, r.order_rank, r.order_own, r.result_status, r.n_calls, r.n_answered, r.problems) for r in out} == want and len(out) == len(chats)
    assert {r.result_status for r in out} == {None, "linked", "early", "orphan"} and len({p for r in out for p in r.problems}) == 3
