"""A firewall for telemetry: attribute values, names and bodies are redacted before they leave; ids never are."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import SKIP_KEYS
from .documents import dumps
from .flows import Flow, Matrix

#: Fixed value: bytes of a field that are looked at; the rest is cut off before.
MOST_BYTES = 32 * 1024


def truncated(text: Column, most: int = MOST_BYTES) -> Column:
    """At most so many bytes, cut between two runes."""
    raw = text.cast("binary")
    start = lambda n: (F.conv(F.hex(F.substring(raw, n + 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xC0))) != 0x80  # noqa: E731  a rune begins behind n bytes
    cut = F.when(start(most), most).when(start(most - 1), most - 1).when(start(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(raw, F.lit(1), cut).cast("string"))


def allowed(matrix: Matrix, destination: str) -> Flow:
    """The flow of a telemetry destination: nothing reads a span back, so it may neither mask nor restore."""
    flow = matrix.flows.get(destination)
    if flow is None:
        raise ValueError(f"no flow {destination}")
    used = [where for where, op in {"default": flow.default, **flow.by_type}.items() if op == "mask"]
    if used or flow.restores:
        raise ValueError(f"{destination}: telemetry can't {'restore' if flow.restores else 'use mask: ' + ', '.join(used)}")
    return flow


def scanned(fields: DataFrame, most: int = MOST_BYTES, skip: tuple[str, ...] = tuple(SKIP_KEYS)) -> DataFrame:
    """Fields (…, key, value) that are to be looked at: those of other keys and not empty, cut to size; ``cut`` tells which were."""
    rows = fields.filter(~F.coalesce(F.col("key").isin(*skip), F.lit(False)) & (F.coalesce("value", F.lit("")) != ""))
    return rows.withColumn("cut", F.octet_length("value") > most).withColumn("value", truncated(F.col("value"), most))


def stats(fields: DataFrame, looked: DataFrame, redacted: DataFrame) -> DataFrame:
    """Fields in all, looked at, cut, and redacted (rows of ``redacted`` with n_entities above zero)."""
    a = fields.agg(F.count("*").cast("long").alias("fields"))
    b = looked.agg(F.count("*").cast("long").alias("scanned"), F.sum(F.col("cut").cast("int")).cast("long").alias("truncated"))
    return a.join(b).join(redacted.agg(F.sum((F.col("n_entities") > 0).cast("int")).cast("long").alias("redacted")))


# Payloads of the open telemetry protocol ------------------------------------------------------

#: Lists of a payload, outer ones first, and what of each element is text.
SPANS = (("resourceSpans", "resource_spans"), ("scopeSpans", "scope_spans", "instrumentationLibrarySpans"), ("spans",))
LOGS = (("resourceLogs", "resource_logs"), ("scopeLogs", "scope_logs", "instrumentationLibraryLogs"), ("logRecords", "log_records"))
METRICS = (("resourceMetrics", "resource_metrics"), ("scopeMetrics", "scope_metrics", "instrumentationLibraryMetrics"), ("metrics",))
KINDS_OF_METRIC = ("gauge", "sum", "histogram", "exponentialHistogram", "exponential_histogram", "summary")

Visit = Callable[[str, str, str], str]


def _get(node, names: tuple[str, ...], kind: type):
    for name in names:
        if isinstance(node, dict) and isinstance(node.get(name), kind):
            return node[name]
    return kind()


def _objects(node, names: tuple[str, ...]) -> list[dict]:
    return [x for x in _get(node, names, list) if isinstance(x, dict)]


def _value(value: dict, kind: str, key: str, visit: Visit) -> None:
    """A value of any type: text, a list or named values, to any depth."""
    todo = [(value, key)]
    while todo:
        node, key = todo.pop()
        for name in ("stringValue", "string_value"):
            if isinstance(node.get(name), str):
                node[name] = visit(kind, key, node[name])
                break
        else:
            todo += [(x, key) for x in reversed(_objects(_get(node, ("arrayValue", "array_value"), dict), ("values",)))]
            for entry in reversed(_objects(_get(node, ("kvlistValue", "kvlist_value"), dict), ("values",))):
                if isinstance(entry.get("value"), dict):
                    own = entry.get("key") if isinstance(entry.get("key"), str) else ""
                    todo.append((entry["value"], ".".join(x for x in (key, own) if x)))


def _attributes(node: dict, kind: str, visit: Visit) -> None:
    for entry in _objects(node, ("attributes",)):
        if isinstance(entry.get("value"), dict):
            _value(entry["value"], kind, entry.get("key") if isinstance(entry.get("key"), str) else "", visit)


def _text(node: dict, name: str, kind: str, key: str, visit: Visit) -> None:
    if isinstance(node.get(name), str) and node[name]:
        node[name] = visit(kind, key, node[name])


def walk(doc: dict, visit: Visit) -> None:
    """Every text of a payload of spans, logs or metrics, rewritten in place by ``visit(kind, key, value)``."""
    for lists, label in ((SPANS, "attribute"), (LOGS, "attribute"), (METRICS, "label")):
        for resource in _objects(doc, lists[0]):
            _attributes(_get(resource, ("resource",), dict), label, visit)
            for scope in _objects(resource, lists[1]):
                _attributes(_get(scope, ("scope",), dict), label, visit)
                for item in _objects(scope, lists[2]):
                    _item(item, lists, visit)


def _item(item: dict, lists: tuple, visit: Visit) -> None:
    if lists is SPANS:
        _text(item, "name", "span_name", "", visit)
        _attributes(item, "attribute", visit)
        _text(_get(item, ("status",), dict), "message", "attribute", "status.message", visit)
        for event in _objects(item, ("events",)):
            _text(event, "name", "event", "event.name", visit)
            _attributes(event, "event", visit)
        for link in _objects(item, ("links",)):
            _attributes(link, "attribute", visit)
    elif lists is LOGS:
        if isinstance(item.get("body"), dict):
            _value(item["body"], "body", "body", visit)
        _attributes(item, "attribute", visit)
    else:
        for kind in KINDS_OF_METRIC:
            for point in _objects(_get(item, (kind,), dict), ("dataPoints", "data_points")):
                _attributes(point, "label", visit)
                for sample in _objects(point, ("exemplars",)):
                    _attributes(sample, "label", visit)


def fields(docs: DataFrame) -> DataFrame:
    """(doc_id, field_no, kind, key, value): the texts of each payload in walking order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: list[tuple] = []
                doc = _parsed(payload)
                if doc is not None:
                    walk(doc, lambda kind, key, value, found=found: found.append((kind, key, value)) or value)
                rows += [(doc_id, i, *x) for i, x in enumerate(found)]
            cols = list(zip(*rows)) or [[] for _ in range(5)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "field_no", "kind", "key", "value"])

    return docs.select(F.col("doc_id").cast("long"), F.col("payload").cast("string")).mapInArrow(run, "doc_id long, field_no int, kind string, key string, value string")


def _parsed(payload: str | None) -> dict | None:
    try:
        doc = json.loads(payload) if payload else None
    except ValueError:
        return None
    return doc if isinstance(doc, dict) else None


def put_back(docs: DataFrame, replaced: DataFrame) -> DataFrame:
    """(doc_id, payload): payloads with the fields of (doc_id, field_no, value) in place; null where there is no object."""
    new = replaced.groupBy(F.col("doc_id").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("field_no", "value"))).alias("new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for payload, new in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                doc, known, n = _parsed(payload), dict(new or []), iter(range(1 << 62))
                if doc is not None:
                    walk(doc, lambda kind, key, value, known=known, n=n: known.get(next(n), value))
                out.append(None if doc is None else dumps(doc))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "payload"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("payload").cast("string").alias("payload")).join(new, F.col("doc_id") == F.col("of"), "left").select("doc_id", "payload", "new")
    return rows.mapInArrow(run, "doc_id long, payload string")


def firewall(docs: DataFrame, redact: Callable[[DataFrame], DataFrame], most: int = MOST_BYTES, forward: bool = False) -> DataFrame:
    """(doc_id, payload, status): payloads with their fields cut and passed through ``redact``, which takes (doc_id, text)
    and gives (doc_id, redacted, status).  A payload with a field that is blocked is dropped, or with ``forward`` goes
    on as it came, status forwarded."""
    looked = scanned(fields(docs), most)
    done = redact(looked.select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("field_no").cast("string")).alias("doc_id"), F.col("value").alias("text")))
    at = F.split("doc_id", "/")
    done = done.select(F.get(at, F.lit(0)).cast("long").alias("doc_id"), F.get(at, F.lit(1)).cast("int").alias("field_no"), F.col("redacted").alias("value"), "status")
    bad = done.filter("status <> 'ok'").select(F.col("doc_id").alias("bad_id")).distinct()
    out = put_back(docs, done.filter("status = 'ok'").drop("status")).withColumnRenamed("payload", "clean")
    out = out.join(docs.select("doc_id", "payload"), "doc_id").join(bad, F.col("doc_id") == F.col("bad_id"), "left")
    fine = F.col("bad_id").isNull() & F.col("clean").isNotNull()
    out = out.select("doc_id", F.when(fine, F.col("clean")).when(F.lit(forward), F.col("payload")).alias("payload"), F.when(fine, "ok").otherwise("forwarded" if forward else "dropped").alias("status"))
    return out if forward else out.filter("status = 'ok'")
