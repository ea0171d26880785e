"""Folds over ordered events of a key that need state: response events, tagged text, merged values.

A fold reads its key's events one after another from a sorted partition and holds only its
state, so the number of events of a key isn't bounded by memory. Results for odd input: events
that aren't a JSON object are skipped; a NULL key is a key; no events give no row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# The tags of streamed text, by what they hold.
REASONING_TAGS = [
    ("<think>", "</think>"), ("<thinking>", "</thinking>"), ("<reason>", "</reason>"), ("<reasoning>", "</reasoning>"), ("<thought>", "</thought>"),
    ("<Thought>", "</Thought>"), ("<|begin_of_thought|>", "<|end_of_thought|>"), ("◁think▷", "◁/think▷"),
]
SOLUTION_TAGS = [("<|begin_of_solution|>", "<|end_of_solution|>")]
CODE_TAGS = [("<code_interpreter>", "</code_interpreter>")]
_ROWS = 1024


def fold_sorted(events: DataFrame, key: str, order: list[str], data: str, start: Callable[[], Any], step: Callable[[Any, dict], Any]) -> DataFrame:
    """(``key``, result JSON, n_events) of every key: ``step`` over the JSON objects of ``data`` in order."""
    rows = events.select(key, *order, F.col(data).alias("_data")).repartition(F.col(key)).sortWithinPartitions(key, *order).select(key, "_data")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        at, state, n, any_row, arrow = None, None, 0, False, None
        for batch in batches:
            arrow = batch.schema.field(0).type
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not any_row or k != at:
                    if any_row:
                        done.append((at, json.dumps(state, ensure_ascii=False, sort_keys=True), n))
                    at, state, n, any_row = k, start(), 0, True
                if isinstance(event := _parsed(text), dict):
                    state, n = step(state, event), n + 1
            if len(done) >= _ROWS:
                yield _folded(done, arrow)
                done = []
        if any_row:
            done.append((at, json.dumps(state, ensure_ascii=False, sort_keys=True), n))
            yield _folded(done, arrow)

    return rows.mapInArrow(run, f"`{key}` {kind}, result string, n_events bigint")


def _folded(done: list[tuple], arrow: pa.DataType) -> pa.RecordBatch:
    keys, results, counts = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array(results, pa.string()), pa.array(counts, pa.int64())], names=["key", "result", "n_events"])


def _parsed(text: str | None) -> Any:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def merged(old: Any, new: Any) -> Any:
    """Objects are merged key by key, texts joined, anything else replaced."""
    if isinstance(old, str) and isinstance(new, str):
        return old + new
    if not (isinstance(old, dict) and isinstance(new, dict)):
        return new
    return {k: merged(old[k], new[k]) if k in old and k in new else new.get(k, old.get(k)) for k in [*old, *(k for k in new if k not in old)]}


def merge_json(deltas: DataFrame, key: str, order: list[str], data: str) -> DataFrame:
    """All JSON objects of a key merged in order."""
    return fold_sorted(deltas, key, order, data, dict, merged)


def merge_reasoning(deltas: DataFrame, key: str, order: list[str], data: str) -> DataFrame:
    """Reasoning details by their integer ``index``: ``text`` and ``summary`` grow, other fields are replaced; details without one are kept apart."""

    def step(state: list, item: dict) -> list:
        index = item.get("index")
        known = next((x for x in state if x.get("index") == index), None) if isinstance(index, int) else None
        if known is None:
            return [*state, item]
        for k, v in item.items():
            grows = k in ("text", "summary") and isinstance(v, str) and isinstance(known.get(k), str)
            known[k] = known[k] + v if grows else v
        return state

    return fold_sorted(deltas, key, order, data, list, step)


# Response events. An event's name is response.<what>.<phase>; what grows or ends lies in an item of the output.
_BODY, _THOUGHT = ("text", "output_text"), ("reasoning_text", "reasoning_summary_text")


def response_step(state: dict, event: dict) -> dict:
    """``state`` (output, and usage, done, response_id, error once known) after an event of a response."""
    name = str(event.get("type") or "")
    if not name.startswith("response."):
        return state
    what, _, phase = name.removeprefix("response.").rpartition(".")
    if not what:
        return _whole_response(state, phase, event.get("response") or {})
    output = state["output"]
    if (what, phase) == ("output_item", "added"):
        output += [event["item"]] if event.get("item") else []
        return state
    at = event.get("output_index", len(output) - 1)
    if what != "output_item" and 0 <= at < len(output):
        act = {"added": _open_part, "delta": _grow, "done": _settle}.get(phase)
        if act:
            act(output[at], what, event)
    return state


def _whole_response(state: dict, phase: str, response: dict) -> dict:
    if phase == "failed":
        return {**state, "error": response.get("error", {})}
    if phase != "completed":
        return state
    output = state["output"] if response.get("output") is None else response["output"]
    for item in output:
        if item.get("type") == "reasoning":
            item["status"] = "completed"
    return {**state, "output": output, "usage": response.get("usage"), "done": True, "response_id": response.get("id")}


def _open_part(item: dict, what: str, event: dict) -> None:
    field = {"content_part": "content", "reasoning_summary_part": "summary"}.get(what)
    if field:
        parts = item[field] = item.get(field) or []
        if field == "summary" or item.get("type") != "reasoning":
            parts.append(event.get("part", {}))


def _part_of(item: dict, field: str, index: int, empty: str) -> dict:
    parts = item[field] = item.get(field) or []
    parts.extend({"type": empty, "text": ""} for _ in range(index + 1 - len(parts)))
    return parts[index]


def _joined(place: dict, field: str, delta: Any) -> None:
    old = place.get(field)
    place[field] = merged(({} if isinstance(delta, dict) else "") if old is None else old, delta)


def _grow(item: dict, what: str, event: dict) -> None:
    kind, delta = item.get("type", ""), event.get("delta", "")
    if what == "function_call_arguments":
        if kind == "function_call":
            item["arguments"] = item.get("arguments", "") + str(delta)
    elif kind == "message":
        if what not in _THOUGHT:
            _joined(_part_of(item, "content", event.get("content_index", 0), "text"), "text" if what in _BODY else what, delta)
    elif kind == "reasoning":
        if what == "reasoning_summary_text":
            _joined(_part_of(item, "summary", event.get("summary_index", 0), "summary_text"), "text", delta)
        elif what == "reasoning_text":
            _joined(_part_of(item, "content", event.get("content_index", 0), "text"), "text", delta)
    else:
        _joined(item, "text" if what in _BODY else what, delta)


def _settle(item: dict, what: str, event: dict) -> None:
    field = {"content_part": "content", "reasoning_summary_part": "summary"}.get(what)
    if field:
        parts = item.get(field) or []
        index = event.get(f"{field}_index", len(parts) - 1)
        if event.get("part") and 0 <= index < len(parts):
            parts[index] = event["part"]
        return
    key = "arguments" if what == "function_call_arguments" else "text" if what in _BODY + _THOUGHT else what
    if key not in event:
        return
    kind = item.get("type", "")
    if kind == "reasoning":
        item["status"] = "completed"
    elif kind == "message" and key != "arguments":
        parts, index = item.get("content") or [], event.get("content_index", 0)
        if len(parts) > index:
            parts[index][key] = event[key]
    elif key != "arguments" or kind == "function_call":
        item[key] = event[key]


def reduce_responses(events: DataFrame, key: str, order: list[str], data: str) -> DataFrame:
    """The output items of each response, from its streamed events."""
    return fold_sorted(events, key, order, data, lambda: {"output": []}, response_step)


def _opener(tag: str) -> str:
    return rf"<{re.escape(tag[1:-1])}(?:\s[^>]*)?>" if tag.startswith("<") and tag.endswith(">") else re.escape(tag)


_KINDS = [(kind, start, end) for kind, tags in (("reasoning", REASONING_TAGS), ("solution", SOLUTION_TAGS), ("code_interpreter", CODE_TAGS)) for start, end in tags]
_OPEN = re.compile("|".join(f"({_opener(start)})" for _, start, _ in _KINDS), re.DOTALL)
_ATTRIBUTE = re.compile(r'(\w+)\s*=\s*"([^"]+)"')


def split_tags(text: str | None) -> list[dict]:
    """Blocks of a streamed text in order: kind (``message`` or what a tag holds), status, tag, attributes, text.

    A tag inside a block of its own kind only loses its mark. A block without end stays
    ``in_progress`` with the rest of the text; an empty block, and a blank message, are left out.
    """
    out, rest = [], text or ""
    while rest:
        found = _OPEN.search(rest)
        before = rest if found is None else rest[: found.start()]
        if before.strip():
            out.append({"kind": "message", "status": "completed", "tag": None, "attributes": {}, "text": before})
        if found is None:
            break
        kind, start, end = _KINDS[found.lastindex - 1]
        body, closed, rest = rest[found.end() :].partition(end)
        if closed:
            body, rest = re.sub(_opener(start), "", body, flags=re.DOTALL).strip(), rest.strip()
        if body or not closed:
            out.append({"kind": kind, "status": "completed" if closed else "in_progress", "tag": start, "attributes": dict(_ATTRIBUTE.findall(found.group())), "text": body})
    return out


_BLOCKS = "array<struct<kind:string,status:string,tag:string,attributes:map<string,string>,text:string>>"


def _blocks(texts: pd.Series) -> pd.Series:
    return texts.map(split_tags)


def tag_blocks(text: Column) -> Column:
    """``split_tags`` of a column."""
    return pandas_udf(_blocks, _BLOCKS)(text)
