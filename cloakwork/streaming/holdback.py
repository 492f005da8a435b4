"""Restoring placeholders in streams whose frames may cut one in two, and tool calls that come in pieces."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.documents import RESPONSE, dumps, element_id, rewritten
from ..operators.rewrite import BARE, PLACEHOLDER

#: What opens a placeholder, how far back an unfinished one may reach, and the brackets that go with one.
MARKER, LOOK_BACK, OPENERS = "ANONYMIZED_", 64, "`\\[{<【（("
COMPLETE, NAME = (re.compile(x.replace("(?i)", ""), re.I) for x in (PLACEHOLDER, BARE))
BLANK = "[\\t\\n\\f\\r ]*"


def _partial(marker: str) -> str:
    out = ""
    for c in reversed(marker):
        out = f"(?:{c}{out})?"
    return out


#: What may still grow into a placeholder or a token at the end of a buffer.
UNFINISHED = re.compile(rf"(?i)(?:[{OPENERS}]{BLANK})?(?:{MARKER}[A-Z_]*(?:[0-9]+{BLANK})?|{_partial(MARKER)})$|\[{_partial('tok:')}$|\[tok:[a-z0-9_]{{0,64}}(?::[0-9a-f]{{0,64}})?$")


def safe(text: str) -> int:
    """How much of a buffer can go out: up to where something may still be growing, LOOK_BACK characters back at most."""
    lowest = max(0, len(text) - LOOK_BACK)
    m = UNFINISHED.search(text, lowest)
    if not m:
        return len(text)
    for whole in COMPLETE.finditer(text, max(0, m.start() - LOOK_BACK)):
        if whole.start() < m.start() < whole.end():  # what looks like an opener closes a placeholder
            return whole.end()
    return m.start()


def put(text: str, known: dict[str, str]) -> str:
    """Known placeholders replaced, a bracket on each side with them; unknown ones stay as they stand."""

    def one(m: re.Match) -> str:
        value = known.get(NAME.search(m[0])[0].upper())
        return m[0] if value is None else value

    return COMPLETE.sub(one, text)


class FrameRestorer:
    """Restores a stream of JSON frames.  Texts are held back by path as long as a placeholder may be growing;
    arguments of tool calls are held until the call is over, and come in a frame of their own before the one that ends it."""

    def __init__(self, known: dict[str, str], state: str | None = None):
        self.known = known
        self.held, self.calls, self.shapes = json.loads(state) if state else ({}, {}, {})

    def state(self) -> str:
        return json.dumps([self.held, self.calls, self.shapes])

    def frame(self, data: str) -> list[str]:
        try:
            doc = json.loads(data)
        except (TypeError, ValueError):
            return [data]
        if not isinstance(doc, dict):
            return [data]
        over = self._take_choices(doc) + self._take_blocks(doc)
        doc = rewritten(doc, RESPONSE, self._text)
        return [*self._released(over), dumps(doc)]

    def _text(self, at: tuple, text: str) -> str:
        key = "/".join(at)
        line = self.held.pop(key, "") + text
        n = safe(line)
        if line[n:]:
            self.held[key] = line[n:]
        return put(line[:n], self.known)

    def _take_choices(self, doc: dict) -> list[str]:
        over = []
        for i, choice in enumerate(doc["choices"] if isinstance(doc.get("choices"), list) else ()):
            if not isinstance(choice, dict):
                continue
            own, delta = element_id(choice, i), choice.get("delta")
            calls = delta.get("tool_calls") if isinstance(delta, dict) else None
            for j, call in enumerate(calls if isinstance(calls, list) else ()):
                function = call.get("function") if isinstance(call, dict) else None
                if isinstance(function, dict) and isinstance(function.get("arguments"), str):
                    key = f"{own}:{element_id(call, j)}"
                    self.shapes.setdefault(key, {**{k: call[k] for k in ("index", "id", "type") if k in call}, "name": function.get("name")})
                    self.calls[key] = self.calls.get(key, "") + function["arguments"]
                    function["arguments"] = ""
            if choice.get("finish_reason") is not None:
                over += [k for k in self.calls if k.startswith(f"{own}:")]
        return over

    def _take_blocks(self, doc: dict) -> list[str]:
        index, delta = doc.get("index"), doc.get("delta")
        if isinstance(index, bool) or not isinstance(index, (int, float)):
            return []
        key = f"block:{int(index)}"
        if doc.get("type") == "content_block_delta" and isinstance(delta, dict) and delta.get("type") == "input_json_delta" and isinstance(delta.get("partial_json"), str):
            self.calls[key] = self.calls.get(key, "") + delta["partial_json"]
            delta["partial_json"] = ""
        return [key] if doc.get("type") == "content_block_stop" and key in self.calls else []

    def _arguments(self, raw: str) -> str:
        """Values of the JSON restored; text that isn't JSON passes unchanged."""
        try:
            node = json.loads(raw)
        except ValueError:
            return raw
        walk = lambda x: {k: walk(v) for k, v in x.items()} if isinstance(x, dict) else [walk(v) for v in x] if isinstance(x, list) else put(x, self.known) if isinstance(x, str) else x
        return dumps(walk(node)) if isinstance(node, (dict, list)) else raw

    def _released(self, keys: list[str]) -> list[str]:
        frames, by_choice = [], {}
        for key in keys:
            own, _, rest = key.partition(":")
            text = self._arguments(self.calls.pop(key))
            if own == "block":
                frames.append(dumps({"type": "content_block_delta", "index": int(rest), "delta": {"type": "input_json_delta", "partial_json": text}}))
                continue
            shape = self.shapes.pop(key, {})
            name = {"name": shape.pop("name")} if shape.get("name") is not None else {}
            shape.pop("name", None)
            by_choice.setdefault(own, []).append({**shape, "function": {**name, "arguments": text}})
        if by_choice:
            frames.append(dumps({"choices": [{**({"index": int(c)} if c.isdigit() else {}), "delta": {"tool_calls": calls}} for c, calls in by_choice.items()]}))
        return frames

    def flush(self) -> tuple[list[str], str]:
        """Frames of calls that never ended, and the texts still held, joined."""
        frames = self._released(list(self.calls))
        rest = "".join(put(x, self.known) for x in self.held.values())
        self.held = {}
        return frames, rest


def milliseconds(idle: str) -> int:
    """A number and a unit (seconds, minutes, hours)."""
    n, unit = idle.split()
    return int(float(n) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")])


def with_vault(frames: DataFrame, vaults: DataFrame) -> DataFrame:
    """Frames with ``known``: the placeholders of their own tenant and session, and of no other."""
    known = vaults.groupBy("tenant", "session").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("placeholder", "value")))).alias("known"))
    return frames.join(known, ["tenant", "session"], "left")


def _stateful(rows: DataFrame, idle: str, step, column: str) -> DataFrame:
    """Run ``step(state, row) -> (texts, state)`` and, at the end or when idle, ``step(state, None)`` over each stream."""
    wait, keys = milliseconds(idle), ["tenant", "session", "stream_id"]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, held = state.get if state.exists else ("", "")
        rows, over = [], state.hasTimedOut
        if not over:
            for r in pd.concat(list(batches)).sort_values("seq").itertuples():
                known = r.known if isinstance(r.known, str) else known
                texts, held = step(json.loads(known or "{}"), held, getattr(r, column), bool(r.final))
                rows += [(*key, r.seq, i, t) for i, t in enumerate(texts)]
                over = over or bool(r.final)
        else:
            texts, held = step(json.loads(known or "{}"), held, None, True)
            rows += [(*key, -1, i, t) for i, t in enumerate(texts)]
        if over:
            state.remove()
        else:
            state.update((known, held))
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(rows, columns=[*keys, "seq", "part", "text"])

    return rows.groupBy(*keys).applyInPandasWithState(run, "tenant string, session string, stream_id string, seq long, part int, text string", "known string, held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _text_step(known: dict, held: str, chunk: str | None, final: bool) -> tuple[list[str], str]:
    held += chunk if isinstance(chunk, str) else ""
    n = len(held) if final else safe(held)
    return [put(held[:n], known)], held[n:]


def _frame_step(known: dict, held: str, frame: str | None, final: bool) -> tuple[list[str], str]:
    r = FrameRestorer(known, held or None)
    out = r.frame(frame) if isinstance(frame, str) else []
    if final:
        frames, rest = r.flush()
        out += frames + ([dumps({"text": rest})] if rest else [])
    return out, r.state()


def restore_stream(frames: DataFrame, vaults: DataFrame, idle: str = "5 minutes") -> DataFrame:
    """``frames``: tenant, session, stream_id, seq, chunk, final.  Yields those keys and the text that each frame releases.

    The held tail lives in the state store under its stream; it goes out with the final frame, or when idle.
    """
    return _stateful(with_vault(frames, vaults), idle, _text_step, "chunk")


def restore_frames(frames: DataFrame, vaults: DataFrame, idle: str = "5 minutes") -> DataFrame:
    """The same for JSON frames in column ``frame``: one row for each frame that goes out, in order of seq and part."""
    return _stateful(with_vault(frames, vaults), idle, _frame_step, "frame")
