"""Line formats as queries: server-sent events, read and written, and metrics text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dialect import Dialect

#: The metrics kept; the first three are those a snapshot can't do without.
METRICS = {
    "running": "vllm:num_requests_running", "waiting": "vllm:num_requests_waiting", "kv_usage": "vllm:gpu_cache_usage_perc", "prefix_hits": "vllm:prefix_cache_hits_total",
    "prefix_queries": "vllm:prefix_cache_queries_total", "preemptions": "vllm:num_preemptions_total",
}
#: Bytes of an event's data beyond which it is marked.
MOST_BYTES = 1 << 20


def events(d: Dialect, lines: str, most: int = MOST_BYTES) -> str:
    """(stream_id, line_no, line) to events: a blank line or the stream's end ends one, data lines are joined, of other
    fields the last counts, a line without colon is a field without value, comments are left out.  An event whose data
    is over ``most`` bytes is marked and its data null."""
    last = lambda f: f"max_by(v, line_no) FILTER (WHERE field = '{f}')"
    data = "listagg(CASE WHEN field = 'data' THEN v END, '\\n') WITHIN GROUP (ORDER BY line_no)" if d.spark else "string_agg(CASE WHEN field = 'data' THEN v END, chr(10) ORDER BY line_no)"
    at = "instr(line, ':')"
    value = f"CASE WHEN {at} = 0 THEN '' WHEN substr(line, {at} + 1, 1) = ' ' THEN substr(line, {at} + 2) ELSE substr(line, {at} + 1) END"
    return f"""SELECT stream_id, event_no, event, id, retry, CASE WHEN too_long THEN NULL ELSE data END AS data, too_long FROM (SELECT *, coalesce({d.bytes("data")} > {most}, false) AS too_long FROM (
        SELECT stream_id, cast(g as bigint) AS event_no, {last("event")} AS event, {last("id")} AS id, {last("retry")} AS retry, {data} AS data FROM (
            SELECT stream_id, line_no, g, CASE WHEN {at} = 0 THEN line ELSE substr(line, 1, {at} - 1) END AS field, {value} AS v FROM (
                SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g FROM ({lines})) WHERE line <> '' AND {at} <> 1) GROUP BY stream_id, g))"""


def written(event: Column, id: Column, retry: Column, data: Column) -> Column:
    """An event as text: event, id, retry, then a data line for each line of the data, and a blank line."""
    field = lambda name, x: F.when(x.isNotNull() & (x != ""), F.concat(F.lit(f"{name}: "), x, F.lit("\n"))).otherwise("")
    body = F.when(data.isNotNull(), F.concat_ws("", F.transform(F.split(data, "\n", -1), lambda x: F.concat(F.lit("data: "), x, F.lit("\n"))))).otherwise("")
    return F.concat(field("event", event), field("id", id), field("retry", retry), body, F.lit("\n"))


#: What ends a stream of events.
DONE = "data: [DONE]\n\n"


def snapshots(d: Dialect, lines: str) -> str:
    """(backend, line) to a row a backend: labels dropped, comments and other metrics left out; valid if the three core ones are there."""
    name, value = (f"regexp_extract(line, {d.raw('^([^{ ]+)[ ]*(?:[{].*[}])?[ ]+([0-9.eE+-]+)[ ]*$')}, {i})" for i in (1, 2))
    cols = ", ".join(f"max(CASE WHEN name = '{m}' THEN v END) AS {k}" for k, m in METRICS.items())
    return f"SELECT *, running IS NOT NULL AND waiting IS NOT NULL AND kv_usage IS NOT NULL AS valid FROM (SELECT backend, {cols} FROM (SELECT backend, {name} AS name, cast(nullif({value}, '') as double) AS v FROM ({lines}) WHERE NOT line LIKE '#%') GROUP BY backend)"
