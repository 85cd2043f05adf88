"""Tool calls linked, ordered, checked and serialised."""

import json
import random
import re

from cardwatch.llm import chat_tools

MESSAGES = "conv_id long, turn long, role string, text string"
TOOLS = "name string, parameters array<struct<name:string,type:string,required:boolean>>"


def call(**parts):
    return f"<tool_call>{json.dumps(parts)}</tool_call>"


def result(**parts):
    return f"<tool_result>{json.dumps(parts)}</tool_result>"


def linked(frame, rows):
    messages = frame(rows, MESSAGES)
    tools = frame([("f", [("a", "integer", True), ("b", "number", False), ("c", "array", False), ("d", "string", False)])], TOOLS)
    return chat_tools.link(chat_tools.marked_calls(messages), chat_tools.marked_results(messages), tools)


def test_links_errors_and_canonical_lines(frame):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", "x " + call(id="p", name="f", arguments={"b": 1, "a": 2}) + call(id="q", name="f", arguments={"a": "z", "zz": 1})),
        (1, 2, "tool", result(id="p", content="ok")),
        (1, 3, "assistant", call(id="s", name="g", arguments={}) + call(id="t", name="f", arguments=[1]) + call(id="u", name="f", arguments={"c": {}})),
        (1, 4, "tool", result(id="p", content="again") + result(id="none", content="o")),
        (2, 0, "assistant", call(id="p", name="f", arguments={"a": 1, "b": 2.5, "c": [1], "d": "é\n"})),
        (2, 1, "assistant", call(id="p", name="f", arguments={"a": 9})),
        (None, 0, "assistant", None), (None, 1, "assistant", "<tool_call>{bad</tool_call>"), (3, 0, "assistant", call(name="f", arguments={"a": 1})),
    ]
    found = {(r.conv_id, r.turn, r.call_id): r for r in linked(frame, rows + rows[:3]).collect()}
    errors = {k: json.loads(r.line)["errors"] for k, r in found.items()}
    assert errors == {
        (1, 1, "p"): ["duplicate_result"], (1, 1, "q"): ["type:a", "unknown:zz"], (1, 3, "s"): ["unknown_tool"], (1, 3, "t"): ["no_object"],
        (1, 3, "u"): ["missing:a", "type:c"], (1, 4, "none"): ["orphan"], (2, 0, "p"): ["duplicate_call"], (None, 1, None): ["no_name"], (3, 0, None): [],
    }
    assert found[1, 1, "p"].status == "answered" and json.loads(found[1, 1, "p"].line)["result"] == "ok"
    for r in found.values():
        assert r.line == json.dumps(json.loads(r.line), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_order_respects_needs_and_reports_circles(frame):
    r = random.Random(3)
    calls, needs = [], {}
    for k in range(30):
        needs[k] = {j for j in r.sample(range(30), 2) if j % 7 > k % 7}
        calls.append((1, k, "assistant", call(id=str(k), name="f", arguments={"a": k}, after=[str(j) for j in needs[k]])))
    calls += [(2, 0, "assistant", call(id="a", name="f", arguments={"a": 1}, after=["b"]) + call(id="b", name="f", arguments={"a": 1}, after=["a"]))]
    rows = linked(frame, calls).collect()
    order = {r.call_id: k for k, r in enumerate(sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.order_key))}
    assert all(order[str(j)] < order[str(k)] for k in range(30) for j in needs[k])
    assert all(json.loads(r.line)["errors"] == ["circle"] for r in rows if r.conv_id == 2)


def test_plain_turns(frame):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "r"), (2, 0, "assistant", "lone"), (1, 3, "user", "r")]
    messages = frame([(*x, "z") for x in rows], MESSAGES + ", status string")
    tools = frame([("answer", [("prompt", "string", True), ("turn", "integer", True)])], TOOLS)
    found = chat_tools.link(chat_tools.turn_calls(messages), chat_tools.turn_results(messages), tools).collect()
    assert sorted((r.conv_id, r.turn, r.status, r.n_errors) for r in found) == [(1, 1, "answered", 0), (1, 3, "unanswered", 0), (2, 0, "orphan", 1)]
    assert chat_tools.link(chat_tools.turn_calls(frame([], MESSAGES)), chat_tools.turn_results(frame([], MESSAGES)), tools).collect() == []


def test_plans_hold_no_python(frame, lm, sf):
    import __spark_entry__ as registered

    for name in ("op1_chat_tool_links", "op7_pii"):
        plan = registered.queries()[name](lm, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_every_call_and_result_of_an_identifier_is_kept(lm, tmp_path):
    from cardwatch.llm import queries

    def c(a, **more):
        return "assistant", call(id="call_0", name="answer", arguments={"prompt": a, "turn": 1}, **more)

    rows = [
        (1, 0, *c("first")), (1, 1, "tool", result(id="call_0", content="r1")), (1, 2, *c("second")), (1, 3, *c("third", after=["call_0"])),
        (1, 4, "tool", result(id="call_0", content="r2")), (1, 5, "tool", result(id="call_0", content="r3")), (1, 6, "tool", result(id="call_0", content="more")),
        (1, 7, *c("last")), (1, 7, *c("last")),
        (2, 1, "user", "one"), (2, 1, "user", "other"), (2, 2, "assistant", "to one"), (2, 2, "assistant", "to other"),
        (3, 0, *c("late", after=["call_1"])), (3, 1, "assistant", call(id="call_1", name="answer", arguments={})), (3, 2, *c("again")),
    ]
    lm.createDataFrame(rows, MESSAGES).write.parquet(f"{tmp_path}/conversations.parquet")
    found = [(r, json.loads(r.line)) for r in queries.op1_chat_tool_links(lm, str(tmp_path)).collect()]
    assert sorted((r.turn, r.status, (x["arguments"] or {}).get("prompt"), x["result"], x["errors"]) for r, x in found if r.conv_id == 1) == [
        (0, "answered", "first", "r1", []), (2, "answered", "second", "r2", ["duplicate_call"]), (3, "answered", "third", "r3", ["duplicate_call"]),
        (6, "duplicate", None, "more", ["duplicate_result"]), (7, "unanswered", "last", None, ["duplicate_call"]),
    ]
    assert sorted((x["arguments"]["prompt"], x["result"]) for r, x in found if r.conv_id == 2) == [("one", "to one"), ("other", "to other")]
    assert [x["arguments"].get("prompt") for r, x in sorted(found, key=lambda f: f[0].order_key) if r.conv_id == 3] == [None, "late", "again"]


def chained(n, back):
    """A conversation of n calls, each needing the one before, and call 0 a later one."""
    needs = {k: [k - 1] for k in range(1, n)} | {0: [back]}
    return [(1, k, "assistant", call(id=str(k), name="f", arguments={"a": k}, after=[str(j) for j in needs[k]])) for k in range(n)]


def rounds_of(monkeypatch):
    counted, plain = [], chat_tools.stash
    monkeypatch.setattr(chat_tools, "stash", lambda df, purpose: counted.append(purpose) or plain(df, purpose))
    return lambda: counted.count("labels") - 1


def test_a_small_circle_in_a_long_conversation_takes_few_rounds(frame, monkeypatch):
    rounds = rounds_of(monkeypatch)
    rows = [(1, k, "assistant", call(id=str(k), name="f", arguments={"a": k}, after=[str(k - 1)] if k else [])) for k in range(400)]
    rows += [(1, 400, "assistant", call(id="x", name="f", arguments={"a": 1}, after=["y"]) + call(id="y", name="f", arguments={"a": 1}, after=["x"]))]
    rows += [(1, 401, "assistant", call(id="z", name="f", arguments={"a": 1}, after=["y"]))]
    errors = {r.call_id: json.loads(r.line)["errors"] for r in linked(frame, rows).collect()}
    assert {k for k, e in errors.items() if e} == {"x", "y"} and rounds() <= 4


def test_a_circle_of_all_calls_and_a_long_chain_take_few_rounds(frame, monkeypatch):
    rounds = rounds_of(monkeypatch)
    rows = linked(frame, chained(300, 299)).collect()
    assert all(json.loads(r.line)["errors"] == ["circle"] for r in rows) and rounds() <= 14
    rows = [r for r in chained(300, 300)] + [(1, 300, "assistant", call(id="300", name="f", arguments={"a": 1}))]
    found = sorted(linked(frame, rows).collect(), key=lambda r: r.order_key)
    assert [r.call_id for r in found] == ["300"] + [str(k) for k in range(300)]
    assert all(json.loads(r.line)["errors"] == [] for r in found) and rounds() <= 28


def test_null_conversation_is_apart_from_minus_one(frame):
    def two(conv):
        return [(conv, 0, "assistant", call(id="a", name="f", arguments={"a": 1}, after=["b"])), (conv, 5 if conv else 2, "assistant", call(id="b", name="f", arguments={"a": 1}))]

    found = {(r.conv_id, r.call_id): r.order_key for r in linked(frame, two(-1) + two(None)).collect()}
    assert found[-1, "a"].startswith("000000000005.") and found[None, "a"].startswith("000000000002.")


def test_broken_calls_keep_their_text_and_texts_of_objects_are_objects(frame):
    rows = [
        (1, 0, "assistant", "<tool_call>{broken</tool_call>"), (1, 1, "assistant", call(id="s", name="f", arguments='{"a": 3}')),
        (1, 2, "assistant", call(id="t", name="f", arguments="plain")), (1, 3, "assistant", call(id="u", name="f")),
    ]
    found = {r.turn: json.loads(r.line) for r in linked(frame, rows).collect()}
    assert found[0]["arguments"] == {"raw": "{broken"} and found[0]["errors"] == ["no_name"]
    assert found[1]["arguments"] == {"a": 3} and found[1]["errors"] == []
    assert found[2]["errors"] == ["no_object"] and found[3]["errors"] == ["no_object"]


def test_texts_are_shuffled_once(lm, sf):
    import __spark_entry__ as registered

    plan = registered.queries()["op1_chat_tool_links"](lm, sf)._jdf.queryExecution().executedPlan().toString()
    # Events of an id come together once; the other exchange is for calls without an id.
    assert len(re.findall(r"Exchange hashpartitioning\(conv_id#\d+L, call_id#\d+, \d+\)", plan)) == 1
    assert plan.count("Exchange hashpartitioning(conv_id") == 2
