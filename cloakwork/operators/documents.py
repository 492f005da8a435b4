"""Texts inside JSON payloads: a whitelist of paths is walked, everything else stays as it is."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The paths whose texts may be rewritten, with their kinds.
REQUEST = (
    ("system", "text"), ("system[*].text", "text"), ("messages[*].content", "text"), ("messages[*].content[*].text", "text"), ("messages[*].content[*].content", "text"),
    ("messages[*].content[*].content[*].text", "text"), ("messages[*].content[*].input", "object"), ("messages[*].tool_calls[*].function.arguments", "json"),
    ("messages[*].function_call.arguments", "json"), ("input", "text"), ("input[*]", "text"), ("input[*].content[*].text", "text"), ("prompt", "text"),
    ("tools[*].description", "text"), ("tools[*].function.description", "text"), ("tools[*].function.parameters.**.description", "text"),
)
RESPONSE = (
    ("choices[*].delta.content", "text"), ("choices[*].delta.reasoning_content", "text"), ("choices[*].message.content", "text"), ("choices[*].message.reasoning_content", "text"),
    ("choices[*].message.tool_calls[*].function.arguments", "json"), ("choices[*].message.function_call.arguments", "json"), ("content[*].text", "text"), ("content[*].input", "object"),
    ("content_block.text", "text"), ("delta.text", "text"), ("output[*].content[*].text", "text"),
)


def _steps(path: str) -> list[str]:
    return path.replace("[*]", ".[*]").split(".")


def element_id(item, position: int) -> str:
    """An element's own index, which streams keep from frame to frame, before its place in the list."""
    own = item.get("index") if isinstance(item, dict) else None
    return str(own) if isinstance(own, int) and not isinstance(own, bool) else str(position)


def _rewrite(node, steps: list[str], kind: str, at: tuple, f: Callable[[tuple, str], str]):
    """``node`` with the texts that the steps lead to passed through ``f``."""
    if not steps:
        if kind == "text":
            return f(at, node) if isinstance(node, str) else node
        if kind == "object":
            return _values(node, at, f) if isinstance(node, (dict, list)) else node
        try:
            inner = json.loads(node) if isinstance(node, str) else None
        except ValueError:  # malformed arguments pass through unchanged
            inner = None
        return dumps(_values(inner, at, f)) if isinstance(inner, (dict, list)) else node
    step, rest = steps[0], steps[1:]
    if step == "[*]":
        return [_rewrite(x, rest, kind, (*at, element_id(x, i)), f) for i, x in enumerate(node)] if isinstance(node, list) else node
    if step == "**":
        node = _rewrite(node, rest, kind, at, f)
        if isinstance(node, dict):
            return {k: _rewrite(v, steps, kind, (*at, k), f) if isinstance(v, (dict, list)) else v for k, v in node.items()}
        return [_rewrite(v, steps, kind, (*at, str(i)), f) for i, v in enumerate(node)] if isinstance(node, list) else node
    return {k: _rewrite(v, rest, kind, (*at, k), f) if k == step else v for k, v in node.items()} if isinstance(node, dict) else node


def _values(node, at: tuple, f: Callable[[tuple, str], str]):
    if isinstance(node, dict):
        return {k: _values(node[k], (*at, k), f) for k in sorted(node)}
    if isinstance(node, list):
        return [_values(x, (*at, str(i)), f) for i, x in enumerate(node)]
    return f(at, node) if isinstance(node, str) else node


def dumps(node) -> str:
    return json.dumps(node, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def walk(payload: str, rules: tuple, f: Callable[[tuple, str], str]) -> str | None:
    """The payload with its texts rewritten; None if it is no JSON object.  Integers stay exact."""
    try:
        node = json.loads(payload)
    except (TypeError, ValueError):
        return None
    return dumps(rewritten(node, rules, f)) if isinstance(node, dict) else None


def rewritten(node: dict, rules: tuple, f: Callable[[tuple, str], str]) -> dict:
    for path, kind in rules:
        node = _rewrite(node, _steps(path), kind, (), f)
    return node


def describe(rules: tuple = REQUEST) -> list[str]:
    """The whitelist in words, a line a rule."""
    return [f"{path}: {'values of the object' if kind == 'object' else 'values of the JSON inside' if kind == 'json' else 'text'}" for path, kind in rules]


def sanitize(docs: DataFrame, redact: Callable[[DataFrame], DataFrame], rules: tuple = REQUEST) -> DataFrame:
    """(doc_id, payload, status): payloads whose listed texts went through ``redact``, a function from (doc_id, text) to
    (doc_id, redacted, status).  A payload that is no object, or one of whose texts is blocked, is blocked as a whole."""
    found = leaves(docs, rules)
    keyed = found.select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("leaf_no").cast("string")).alias("doc_id"), "text")
    done = redact(keyed).select(F.split("doc_id", "/").alias("at"), "redacted", "status")
    done = done.select(F.get("at", F.lit(0)).cast("long").alias("doc_id"), F.get("at", F.lit(1)).cast("int").alias("leaf_no"), F.col("redacted").alias("text"), "status")
    bad = done.filter("status <> 'ok'").select("doc_id", F.lit(True).alias("bad")).distinct()
    out = put_back(docs, done.filter("status = 'ok'").select("doc_id", "leaf_no", "text"), rules).join(bad, "doc_id", "left")
    fine = F.col("bad").isNull() & F.col("payload").isNotNull()
    return out.select("doc_id", F.when(fine, F.col("payload")).alias("payload"), F.when(fine, "ok").otherwise("blocked").alias("status"))


def frame_class(frame: Column) -> Column:
    """What a stream's frame carries: text, tool_call or other."""
    choices = F.from_json(F.get_json_object(frame, "$.choices"), "array<string>")
    text = F.exists(choices, lambda c: F.concat(*(F.coalesce(F.get_json_object(c, f"$.delta.{k}"), F.lit("")) for k in ("content", "reasoning_content", "text"))) != "")
    calls = F.exists(choices, lambda c: F.get_json_object(c, "$.delta.tool_calls[0]").isNotNull())
    return F.when(F.coalesce(text, F.lit(False)), "text").when(F.coalesce(calls, F.lit(False)), "tool_call").otherwise("other")


def leaves(docs: DataFrame, rules: tuple = REQUEST) -> DataFrame:
    """(doc_id, leaf_no, path, text): each text of the column payload on the whitelist, in walking order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: list[tuple] = []
                walk(payload, rules, lambda at, x, found=found: found.append((at, x)) or x)
                rows += [(doc_id, i, "/".join(at), x) for i, (at, x) in enumerate(found)]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["doc_id", "leaf_no", "path", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("payload").cast("string")).mapInArrow(run, "doc_id long, leaf_no int, path string, text string")


def put_back(docs: DataFrame, replaced: DataFrame, rules: tuple = REQUEST) -> DataFrame:
    """(doc_id, payload): payloads with the texts of (doc_id, leaf_no, text) in place; null where the payload is no object."""
    new = replaced.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("leaf_no", "text"))).alias("new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for payload, new in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                texts, n = dict(new or []), iter(range(1 << 62))
                out.append(walk(payload, rules, lambda at, x, texts=texts, n=n: texts.get(next(n), x)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "payload"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("payload").cast("string").alias("payload")).join(new, "doc_id", "left")
    return rows.mapInArrow(run, "doc_id long, payload string")
