"""Payload walks and streams of frames."""

import json
import random

from pyspark.sql import functions as F

from cloakwork.operators import documents as D
from cloakwork.streaming import holdback


def test_walk_keeps_what_is_not_listed(spark):
    payload = {
        "model": "m", "big": 2**60 + 1, "system": "s", "messages": [{"role": "user", "content": "a"}, {"content": [{"type": "text", "text": "b"}, {"content": [{"text": "c"}], "input": {"k": ["d", 1], "j": "e"}}]},
        {"tool_calls": [{"function": {"name": "n", "arguments": '{"q": "f", "n": 12345678901234567890}'}}]}, {"function_call": {"arguments": "{broken"}}],
        "tools": [{"description": "g", "function": {"description": "h", "parameters": {"properties": {"description": {"description": "i"}, "x": {"description": "j", "enum": ["k"]}}}}}],
    }
    seen = []
    out = D.walk(json.dumps(payload), D.REQUEST, lambda at, x: seen.append(x) or x.upper())
    assert sorted(seen) == sorted("sabcdefghij")
    back = json.loads(out)
    assert back["big"] == 2**60 + 1 and back["model"] == "m" and back["messages"][3]["function_call"]["arguments"] == "{broken"
    assert json.loads(back["messages"][2]["tool_calls"][0]["function"]["arguments"]) == {"q": "F", "n": 12345678901234567890}
    assert D.walk("[1]", D.REQUEST, lambda at, x: x) is None and D.walk(None, D.REQUEST, lambda at, x: x) is None
    docs = spark.createDataFrame([(1, json.dumps(payload)), (2, "no json"), (3, None)], "doc_id long, payload string")
    found = D.leaves(docs)
    assert found.count() == 11
    got = {r.doc_id: r.payload for r in D.put_back(docs, found).collect()}
    assert json.loads(got[1])["messages"][0] == payload["messages"][0] and got[2] is None and got[3] is None


def test_split_placeholders_come_whole():
    known, rng = {"ANONYMIZED_NAME_0": "张伟", "ANONYMIZED_NAME_12": "Ann"}, random.Random(1)
    text = "hi ANONYMIZED_NAME_0, [ anonymized_name_12 ]! ANON (and ANONYMIZED_ORG_3 A `ANONYMIZED_NAME_12` [tok:name:12345678] x["
    for _ in range(300):
        cuts = sorted(rng.sample(range(len(text)), 6))
        held, out = "", ""
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            held += text[a:b]
            n = holdback.safe(held)
            assert len(held) - n <= holdback.LOOK_BACK
            out, held = out + holdback.put(held[:n], known), held[n:]
        assert out + holdback.put(held, known) == "hi 张伟, Ann! ANON (and ANONYMIZED_ORG_3 A Ann [tok:name:12345678] x["
    assert holdback.safe("A" * 10_000 + "NONYMIZED") == 10_009 - 10 and [holdback.milliseconds(x) for x in ("30 seconds", "5 minutes", "1 hour")] == [30_000, 300_000, 3_600_000]


VAULT = [("acme", "s1", "ANONYMIZED_NAME_0", "Ann"), ("acme", "s2", "ANONYMIZED_NAME_0", "Bob"), ("beta", "s1", "ANONYMIZED_NAME_0", "Eve")]


def streamed(spark, tmp_path, rows, schema, restore, column="text"):
    vaults = spark.createDataFrame(VAULT, "tenant string, session string, placeholder string, value string")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = restore(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), vaults)
    name = f"out_{abs(hash(str(tmp_path)))}"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else it goes on to wait for idle streams and never ends
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    return spark.table(name).orderBy("tenant", "session", "stream_id", "seq", "part").collect()


def test_each_session_has_its_own_values(spark, tmp_path):
    rows = [(t, s, "a", i, x, i == 2) for t, s in (("acme", "s1"), ("acme", "s2"), ("beta", "s1"), ("beta", "s2")) for i, x in enumerate(("x ANONYM", "IZED_NAME_0", " y"))]
    got = {}
    for r in streamed(spark, tmp_path, rows, "tenant string, session string, stream_id string, seq long, chunk string, final boolean", holdback.restore_stream):
        got[r.tenant, r.session] = got.get((r.tenant, r.session), "") + r.text
    assert got == {("acme", "s1"): "x Ann y", ("acme", "s2"): "x Bob y", ("beta", "s1"): "x Eve y", ("beta", "s2"): "x ANONYMIZED_NAME_0 y"}


def call(index, text, **more):
    return {"index": index, "function": {"arguments": text, **more}}


def test_tool_calls_come_whole_before_the_end():
    r = holdback.FrameRestorer({"ANONYMIZED_NAME_0": 'A "nn" \\'})
    frames = [
        {"choices": [{"index": 0, "delta": {"content": "to ANONYMIZED_"}}]},
        {"choices": [{"index": 0, "delta": {"content": "NAME_0!", "tool_calls": [{**call(1, '{"who": "ANONY', name="f"), "id": "c1"}]}}]},
        {"choices": [{"index": 0, "delta": {"tool_calls": [call(0, '["x"'), call(1, 'MIZED_NAME_0", "n": 12345678901234567890}')]}}]},
        {"choices": [{"index": 0, "delta": {"tool_calls": [call(0, "]")]}}, {"index": 1, "delta": {"tool_calls": [call(0, "{broken ANONYMIZED_NAME_0")]}}]},
        {"choices": [{"index": 0, "delta": {}, "finish_reason": "tool_calls"}]},
    ]
    out, state = [], None
    for f in frames:  # the state survives a round through the store
        r = holdback.FrameRestorer(r.known, state)
        out.append([json.loads(x) for x in r.frame(json.dumps(f))])
        state = r.state()
    assert [len(x) for x in out] == [1, 1, 1, 1, 2]
    text = "".join(x["choices"][0]["delta"].get("content", "") for xs in out for x in xs)
    assert text == 'to A "nn" \\!'
    assert all(c["function"]["arguments"] == "" for xs in out[:4] for x in xs for ch in x["choices"] for c in ch["delta"].get("tool_calls", []))
    released, end = out[4]
    calls = {c["index"]: c for c in released["choices"][0]["delta"]["tool_calls"]}
    assert json.loads(calls[1]["function"]["arguments"]) == {"who": 'A "nn" \\', "n": 12345678901234567890} and calls[1]["id"] == "c1" and calls[1]["function"]["name"] == "f"
    assert calls[0]["function"]["arguments"] == '["x"]' and end["choices"][0]["finish_reason"] == "tool_calls"
    left, rest = r.flush()
    assert json.loads(left[0])["choices"] == [{"index": 1, "delta": {"tool_calls": [{"index": 0, "function": {"arguments": "{broken ANONYMIZED_NAME_0"}}]}}] and rest == ""
    assert r.frame("no json") == ["no json"] and r.frame("[1]") == ["[1]"]


def test_blocks_of_a_stream(spark, tmp_path):
    frames = [
        {"type": "content_block_start", "index": 2, "content_block": {"type": "tool_use", "name": "f"}}, {"type": "content_block_delta", "index": 2, "delta": {"type": "input_json_delta", "partial_json": '{"a": "ANONYMIZED'}},
        {"type": "content_block_delta", "index": 2, "delta": {"type": "input_json_delta", "partial_json": '_NAME_0"}'}}, {"type": "content_block_stop", "index": 2}, {"delta": {"text": "bye ANONYMIZED_NAME_0"}},
    ]
    rows = [("acme", "s2", "q", i, json.dumps(f), i == 4) for i, f in enumerate(frames)]
    got = streamed(spark, tmp_path, rows, "tenant string, session string, stream_id string, seq long, frame string, final boolean", holdback.restore_frames)
    assert [r.seq for r in got] == [0, 1, 2, 3, 3, 4, 4]
    assert json.loads(got[3].text)["delta"]["partial_json"] == '{"a":"Bob"}' and json.loads(got[4].text)["type"] == "content_block_stop"
    assert json.loads(got[5].text)["delta"]["text"] + json.loads(got[6].text)["text"] == "bye Bob"


def test_frame_classes(spark):
    rows = [('{"choices":[{"delta":{"content":"x"}}]}', "text"), ('{"choices":[{"delta":{"content":""}},{"delta":{"tool_calls":[{}]}}]}', "tool_call"), ('{"choices":[{"delta":{"tool_calls":[]}}]}', "other"), ("{}", "other"), ("no", "other"), (None, "other"), ('{"choices":[1,{"delta":{"reasoning_content":"r"}}]}', "text")]
    df = spark.createDataFrame(rows, "frame string, want string")
    assert [r for r in df.select("frame", "want", D.frame_class(F.col("frame")).alias("got")).collect() if r.want != r.got] == []


def test_sanitized_payloads(spark):
    payload = json.dumps({"model": "m", "messages": [{"content": "mail a@b.cc"}, {"content": "fine"}]})
    docs = spark.createDataFrame([(1, payload), (2, "no"), (3, payload.replace("fine", "bad"))], "doc_id long, payload string")

    def redact(rows):
        return rows.select("doc_id", F.regexp_replace("text", "[a-z]@[a-z.]+", "#").alias("redacted"), F.when(F.col("text") == "bad", "blocked").otherwise("ok").alias("status"))

    got = {r.doc_id: (r.payload, r.status) for r in D.sanitize(docs, redact).collect()}
    assert json.loads(got[1][0])["messages"] == [{"content": "mail #"}, {"content": "fine"}] and got[2] == got[3] == (None, "blocked")
    assert len(D.describe()) == 16 and len(D.describe(D.RESPONSE)) == 11


def test_events_are_read_as_they_are_written(spark):
    from cloakwork.functions.dialect import SPARK
    from cloakwork.sources import lines as L

    rows = [(1, "delta", "7", "30", "one\ntwo"), (2, None, None, None, ""), (3, "e", "", None, "x" * 50)]
    df = spark.createDataFrame(rows, "n int, event string, id string, retry string, data string")
    text = "".join(r[0] for r in df.orderBy("n").select(L.written(*(F.col(c) for c in ("event", "id", "retry", "data")))).collect()) + L.DONE
    lined = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "stream_id int, line_no int, line string")
    lined.createOrReplaceTempView("sse_lines")
    got = spark.sql(L.events(SPARK, "SELECT * FROM sse_lines", 40)).orderBy("event_no").collect()
    assert [(r.event, r.id, r.retry, r.data, r.too_long) for r in got] == [("delta", "7", "30", "one\ntwo", False), (None, None, None, "", False), ("e", None, None, None, True), (None, None, None, "[DONE]", False)]
