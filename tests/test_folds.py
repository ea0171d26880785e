import json

import pytest

from loomspan.operators import folds as D


def run(events, output=None):
    state = {"output": output or []}
    for e in events:
        state = D.response_step(state, e)
    return state


def ev(kind, **kw):
    return {"type": f"response.{kind}", **kw}


def test_message_grows_and_ends():
    item = {"type": "message"}
    state = run([ev("output_item.added", item=item), ev("content_part.added", part={"type": "text", "text": "a"}), ev("output_text.delta", delta="b"), ev("output_text.delta", delta="c", content_index=1), ev("reasoning_text.delta", delta="no")])
    assert state["output"] == [{"type": "message", "content": [{"type": "text", "text": "ab"}, {"type": "text", "text": "c"}]}]
    state = run([ev("output_text.done", text="final", content_index=1), ev("content_part.done", part={"type": "text", "text": "z"}, content_index=0), ev("output_item.done", item={"type": "x"})], state["output"])
    assert [p["text"] for p in state["output"][0]["content"]] == ["z", "final"]


def test_calls_reasoning_and_other_items():
    out = [{"type": "function_call"}, {"type": "reasoning", "summary": None}, {"type": "code"}]
    state = run(
        [ev("function_call_arguments.delta", output_index=0, delta='{"a"'), ev("function_call_arguments.delta", output_index=0, delta=":1}"), ev("reasoning_summary_part.added", output_index=1, part={"type": "summary_text", "text": ""}),
         ev("reasoning_summary_text.delta", output_index=1, delta="why"), ev("reasoning_text.delta", output_index=1, delta="so"), ev("content_part.added", output_index=1, part={"x": 1}), ev("audio.delta", output_index=2, delta={"n": "1"}),
         ev("audio.delta", output_index=2, delta={"n": "2"}), ev("text.delta", output_index=9, delta="lost"), ev("in_progress")], out,
    )
    call, thought, code = state["output"]
    assert call["arguments"] == '{"a":1}' and thought["summary"][0]["text"] == "why" and thought["content"] == [{"type": "text", "text": "so"}] and code["audio"] == {"n": "12"}
    state = run([ev("function_call_arguments.done", output_index=0, arguments="{}"), ev("reasoning_text.done", output_index=1, text="x"), ev("reasoning_summary_part.done", output_index=1, summary_index=0, part={"t": 1}), ev("audio.done", output_index=2, audio="all")], state["output"])
    assert state["output"][0]["arguments"] == "{}" and state["output"][1]["status"] == "completed" and state["output"][1]["summary"] == [{"t": 1}] and state["output"][2]["audio"] == "all"


def test_ends_of_a_response():
    done = run([ev("completed", response={"id": "r", "usage": {"n": 1}})], [{"type": "reasoning", "status": "in_progress"}])
    assert done["done"] and done["usage"] == {"n": 1} and done["output"][0]["status"] == "completed"
    assert run([ev("completed", response={"output": [{"type": "message"}]})])["output"] == [{"type": "message"}]
    assert run([ev("failed", response={"error": "e"}), {"type": "other"}, {}])["error"] == "e"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("  ", []), ("plain", [("message", "plain")]), ("<think>a</think> b", [("reasoning", "a"), ("message", "b")]), ("x<thinking>a", [("message", "x"), ("reasoning", "a")]),
        ("<thought>a <thought>b</thought>c", [("reasoning", "a b"), ("message", "c")]), ("<reason></reason>c", [("message", "c")]), ("◁think▷t◁/think▷", [("reasoning", "t")]),
        ('<code_interpreter type="code" lang="r">1+1</code_interpreter>', [("code_interpreter", "1+1")]), ("<|begin_of_solution|>s<|end_of_solution|>", [("solution", "s")]), ("a < b <thinker>", [("message", "a < b <thinker>")]),
    ],
)
def test_tags(text, want):
    assert [(b["kind"], b["text"]) for b in D.split_tags(text)] == want


def test_attributes_and_state():
    block = D.split_tags('<code_interpreter type="code" lang="r">1')[0]
    assert block["attributes"] == {"type": "code", "lang": "r"} and block["status"] == "in_progress" and block["tag"] == "<code_interpreter>"


def test_merged():
    assert D.merged({"a": "x", "b": {"c": "1"}, "n": 1}, {"a": "y", "b": {"c": "2", "d": 3}, "n": 2}) == {"a": "xy", "b": {"c": "12", "d": 3}, "n": 2}
    assert D.merged({"a": 1}, "s") == "s" and D.merged("s", None) is None


def test_folds_of_odd_rows(spark):
    rows = [(1, 2, '{"a": "y"}'), (1, 1, '{"a": "x"}'), (1, 3, "broken"), (1, 4, None), (None, 1, '{"a": "n"}'), (2, 1, "[1]")]
    got = {r["k"]: (json.loads(r["result"]), r["n_events"]) for r in D.merge_json(spark.createDataFrame(rows, "k int, seq int, data string"), "k", ["seq"], "data").collect()}
    assert got == {1: ({"a": "xy"}, 2), None: ({"a": "n"}, 1), 2: ({}, 0)}
    assert D.merge_json(spark.createDataFrame([], "k int, seq int, data string"), "k", ["seq"], "data").count() == 0
    items = [(1, 1, '{"index": 0, "text": "a", "n": 1}'), (1, 2, '{"index": 0, "text": "b", "n": 2}'), (1, 3, '{"text": "c"}'), (1, 4, '{"index": 1, "summary": "s"}')]
    (row,) = D.merge_reasoning(spark.createDataFrame(items, "k int, seq int, data string"), "k", ["seq"], "data").collect()
    assert json.loads(row["result"]) == [{"index": 0, "text": "ab", "n": 2}, {"text": "c"}, {"index": 1, "summary": "s"}]
