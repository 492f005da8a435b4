"""Registered queries with their SQL twins: detection, check digits, rewriting, rosters, payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import words as WORDS
from ..functions.dialect import DUCK, SPARK
from ..functions.keys import hmac_hex
from ..operators import documents as D
from ..operators import recognizers as R
from ..operators import rewrite as W
from ..sources import lines as L
from .base import ALL_TEXTS, EVERY, KEY, MAIN, ORACLE, QUERIES, REDACTED, SYNTH, TABLES, K, _num, all_texts, both, frame, run

__all__ = ["ALL_TEXTS", "ORACLE", "QUERIES", "TABLES", "run"]

# Recognisers, alone and together -------------------------------------------------------------
for _r in (*EVERY, R.TENANT_RULE):
    frame(f"recognize_{_r.name}", lambda spark, d, r=_r: R.recognize(all_texts(spark, d), r), R.recognize_sql(ALL_TEXTS, _r))
frame("no_prefilter_email", lambda spark, d: R.recognize(all_texts(spark, d), R.without_prefilter(EVERY[0])), R.recognize_sql(ALL_TEXTS, EVERY[0]))
frame("detect_min_confidence", lambda spark, d: R.detect(all_texts(spark, d), MAIN, 0.85), R.detect_sql(ALL_TEXTS, MAIN, 0.85))
frame("resolve_overlaps", lambda spark, d: R.resolve_overlaps(R.detect(all_texts(spark, d), EVERY)), R.resolve_overlaps_sql(R.detect_sql(ALL_TEXTS, EVERY)))
_count = "SELECT type, detector, cast(count(*) as bigint) AS n, cast(count(DISTINCT doc_id) as bigint) AS n_docs FROM ({}) GROUP BY type, detector"
frame("counts_by_recognizer", lambda spark, d: R.detect(all_texts(spark, d), EVERY).groupBy("type", "detector").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")), _count.format(R.detect_sql(ALL_TEXTS, EVERY)))
frame("type_allow_list", lambda spark, d: R.detect(all_texts(spark, d), EVERY).filter(F.col("type").isin("EMAIL", "IP")), f"SELECT * FROM ({R.detect_sql(ALL_TEXTS, EVERY)}) WHERE type IN ('EMAIL', 'IP')")
_de = R.load("de", disabled=("USCC",))
frame("pack_de_without_uscc", lambda spark, d: R.detect(all_texts(spark, d), _de), R.detect_sql(ALL_TEXTS, _de))
_names = ", ".join(f"('{r.name}', '{r.type}')" for r in EVERY)
frame(
    "never_fired",
    lambda spark, d: run(spark, d, f"SELECT * FROM (VALUES {_names}) t(detector, type)").join(R.detect(run(spark, d, "SELECT doc_id, text FROM documents"), EVERY), "detector", "left_anti"),
    f"SELECT detector, type FROM (VALUES {_names}) t(detector, type) WHERE detector NOT IN (SELECT detector FROM ({R.detect_sql('SELECT doc_id, text FROM documents', EVERY)}))",
)
frame("coverage_gaps", lambda spark, d: run(spark, d, "SELECT * FROM (VALUES ('NAME'), ('ADDRESS'), ('ORG'), ('EMAIL')) t(type)").join(R.detect(all_texts(spark, d), EVERY), "type", "left_anti"), f"SELECT type FROM (VALUES ('NAME'), ('ADDRESS'), ('ORG'), ('EMAIL')) t(type) WHERE type NOT IN (SELECT type FROM ({R.detect_sql(ALL_TEXTS, EVERY)}))")
_amb = "case when type in ('BANK_CARD', 'IBAN', 'ID_CARD', 'USCC', 'EMAIL', 'CREDENTIAL') then 'direct' when type in ('ADDRESS', 'ORG', 'NAME', 'ACCOUNT') then 'verify' when confidence < 0.75 then 'verify' else 'direct' end"
frame("ambiguity_partition", lambda spark, d: R.detect(all_texts(spark, d), EVERY).select("doc_id", "type", "start", F.expr(_amb).alias("route")), f"SELECT doc_id, type, start, {_amb} AS route FROM ({R.detect_sql(ALL_TEXTS, EVERY)})")

# Check digits --------------------------------------------------------------------------------
_samples = {
    "luhn": f"'4' || {_num(f'{K} * 7919 % 1000000', 14)} || cast({K} % 10 as varchar(2))",
    "card": f"substr('4536', cast({K} % 4 as int) + 1, 1) || {_num(f'{K} * 104729 % 1000000000', 14)} || cast({K} % 10 as varchar(2))",
    "card_luhn": f"{_num(f'{K} * 104729 % 1000000000', 13)}",
    "cn_id": f"'11010519' || {_num(f'{K} % 100', 2)} || {_num(f'{K} % 14', 2)} || {_num(f'{K} % 33', 2)} || {_num(f'{K} % 1000', 3)} || substr('0123456789Xx', cast({K} % 12 as int) + 1, 1)",
    "uscc": f"'91350100M' || {_num(f'{K} * 13 % 100000000', 8)} || substr('{checks.USCC_ALPHABET}', cast({K} % 31 as int) + 1, 1)",
    "iban": f"substr('DEGBES', 2 * cast({K} % 3 as int) + 1, 2) || {_num(f'{K} % 100', 2)} || {_num(f'{K} * 7919 % 1000000', 18)}",
    "codice_fiscale": f"'RSSMRA' || {_num(f'{K} % 100', 2)} || 'A' || {_num(f'{K} % 31', 2)} || 'H' || {_num(f'{K} % 1000', 3)} || substr('{checks.LETTERS}', cast({K} % 26 as int) + 1, 1)",
    "steuer_id": _num(f"12345678000 + {K} * 7919 % 1000000", 11),
    "dni": f"{_num(f'{K} * 31 % 100000000', 8)} || substr('{checks.DNI_LETTERS}', cast({K} % 23 as int) + 1, 1)",
}
for _name, _sample in _samples.items():
    both(f"check_{_name}", lambda d, n=_name, s=_sample: f"SELECT k, v, {checks.CHECKS[n](d, 'v')} AS valid FROM (SELECT {K} AS k, {s} AS v FROM orders)")
both("card_network", lambda d: f"SELECT k, v, {checks.network('v')} AS network FROM (SELECT {K} AS k, {_num(f'{K} * 982451653', 12 + 4)} AS v FROM orders)")

# Text classes --------------------------------------------------------------------------------
both("ner_trigger", lambda d: f"SELECT doc_id, length(text) >= 2 AND {d.count('text', '\\p{L}')} >= 2 AS model_runs FROM ({ALL_TEXTS})")
both(
    "script_of",
    lambda d: f"""SELECT doc_id, CASE WHEN letters = 0 THEN 'unknown' WHEN han * 1.0 / letters >= 0.25 THEN 'han' WHEN latin * 1.0 / letters >= 0.5 THEN 'latin' ELSE 'unknown' END AS script
    FROM (SELECT doc_id, {d.count("text", d.script("Han"))} AS han, {d.count("text", d.script("Latin"))} AS latin, {d.count("text", "\\p{L}")} AS letters FROM ({ALL_TEXTS}))""",
)
both("byte_offsets", lambda d: f"SELECT doc_id, cast(length(text) as int) AS n_chars, cast({d.bytes('text')} as int) AS n_bytes FROM ({ALL_TEXTS})")

# Rewriting -----------------------------------------------------------------------------------
_found = R.resolve_overlaps_sql(R.detect_sql(ALL_TEXTS, REDACTED))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolve_overlaps(R.detect(all_texts(spark, sf_dir), REDACTED))


def _replaced(name: str, spark_value: str, duck_value: str) -> None:
    frame(name, lambda spark, d: _entities(spark, d).select("doc_id", "type", "start", F.expr(spark_value).alias("replacement")), f"SELECT doc_id, type, start, {duck_value} AS replacement FROM ({_found})")


_replaced("rewrite_hash", W.hashed(SPARK, KEY, 12), W.hashed(DUCK, KEY, 12))
_replaced("rewrite_token", W.token(SPARK, KEY), W.token(DUCK, KEY))
_replaced("rewrite_char_mask", W.char_mask(), W.char_mask())
_replaced("rewrite_drop", "''", "''")
_matrix = "case when type = 'EMAIL' then {h} when type = 'BANK_CARD' then {c} when type = 'IP' then '' else {t} end"
_replaced("matrix_by_type", _matrix.format(h=W.hashed(SPARK, KEY), c=W.char_mask(), t=W.token(SPARK, KEY)), _matrix.format(h=W.hashed(DUCK, KEY), c=W.char_mask(), t=W.token(DUCK, KEY)))
_dates = f"SELECT {K} AS k, CASE cast({K} % 4 as int) WHEN 0 THEN cast(1800 + {K} % 300 as varchar(6)) || '-' || cast({K} % 13 as varchar(3)) || '-3' WHEN 1 THEN cast(1790 + {K} % 320 as varchar(6)) || '年' WHEN 2 THEN '1987年6月5日' ELSE 'n/a' END AS value FROM orders"
both("generalize_decade", lambda d: f"SELECT k, value, coalesce({W.generalized(d)}, '') AS general FROM ({_dates})")
both("generalize_year", lambda d: f"SELECT k, value, coalesce({W.generalized(d, True)}, '') AS general FROM ({_dates})")
frame("redact_documents", lambda spark, d: W.splice(all_texts(spark, d), _entities(spark, d).select("doc_id", "start", "end", F.expr(W.hashed(SPARK, KEY)).alias("replacement"))), W.splice_sql(ALL_TEXTS, f"SELECT doc_id, start_cp, end_cp, {W.hashed(DUCK, KEY)} AS replacement FROM ({_found})"))

_session = f"SELECT doc_id, session, text FROM ({SYNTH})"
_session_found = R.resolve_overlaps_sql(R.detect_sql(_session, REDACTED))
_vault = f"""SELECT session, type, value, (row_number() OVER (PARTITION BY session, type ORDER BY first) - 1)::INT AS idx FROM (
    SELECT session, type, value, min({{'doc_id': doc_id, 'start': start}}) AS first FROM ({_session_found}) JOIN (SELECT doc_id, session FROM ({SYNTH})) USING (doc_id) GROUP BY session, type, value)"""
_vault = f"SELECT *, 'ANONYMIZED_' || type || '_' || idx AS placeholder FROM ({_vault})"


def _session_entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    texts = run(spark, sf_dir, _session).repartition(spark.sparkContext.defaultParallelism)
    found = R.resolve_overlaps(R.detect(texts, REDACTED)).join(texts.select("doc_id", "session"), "doc_id")
    return texts, found, W.vault(found, ["session"], ["doc_id", "start"])


def _masked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    texts, found, vaults = _session_entities(spark, sf_dir)
    spans = found.join(vaults, ["session", "type", "value"]).select("doc_id", "start", "end", F.col("placeholder").alias("replacement"))
    return texts, W.splice(texts, spans), vaults


def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, masked, vaults = _masked(spark, sf_dir)
    tail = F.lit(" [ANONYMIZED_NAME_9] ")
    reply = masked.join(texts.select("doc_id", "session"), "doc_id").select("doc_id", "session", F.concat("redacted", tail).alias("text"))
    back = W.restore(reply, ["session"], vaults).join(texts.select("doc_id", F.col("text").alias("original")), "doc_id")
    return back.select("doc_id", "n_found", "phantom", (F.col("restored") == F.concat("original", tail)).alias("same"))


frame("vault_numbering", lambda spark, d: _session_entities(spark, d)[2], _vault)
frame("mask_sessions", lambda spark, d: _masked(spark, d)[1], W.splice_sql(_session, f"SELECT f.doc_id, start_cp, end_cp, placeholder AS replacement FROM ({_session_found}) f JOIN (SELECT doc_id, session FROM ({SYNTH})) s USING (doc_id) JOIN ({_vault}) v ON v.session = s.session AND v.type = f.type AND v.value = f.value"))
frame("restore_round_trip", _restored, f"SELECT doc_id, (coalesce(n, 0) + 1)::INT AS n_found, 'ANONYMIZED_NAME_9' AS phantom, true AS same FROM (SELECT doc_id FROM ({SYNTH})) LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_session_found}) GROUP BY doc_id) USING (doc_id)")
frame("leak_scan", lambda spark, d: W.leaks(run(spark, d, _session), ["session"], _session_entities(spark, d)[2]).select("doc_id", "type"), f"SELECT DISTINCT t.doc_id, v.type FROM ({_session}) t JOIN ({_vault}) v ON t.session = v.session AND contains(t.text, v.value)")
frame("audit_counts", lambda spark, d: _session_entities(spark, d)[2].groupBy("session", "type").agg(F.count("*").alias("n")), f"SELECT session, type, count(*) AS n FROM ({_vault}) GROUP BY session, type")
both("session_fingerprint", lambda d: f"SELECT session, left({hmac_hex(d, KEY, "('session' || ':' || cast(session as varchar(20)))")}, 16) AS fingerprint FROM (SELECT DISTINCT cast(o_custkey as bigint) AS session FROM orders)")

# Relevance, frames and telemetry -------------------------------------------------------------
_asks = "SELECT * FROM (VALUES (1, 'where is 星辰科技 now', 'ORG', '星辰科技'), (2, '客户 家住 北京路1号', 'ADDRESS', '北京路1号'), (3, '北京路1号 怎么走', 'ADDRESS', '北京路1号'), (4, 'call 张伟', 'NAME', '张伟'), (5, '星辰科技 report', 'ORG', '星辰科技')) t(doc_id, text, type, value)"
_has = lambda words: "(" + " or ".join(f"contains(lower(text), '{w}')" for w in words) + ")"
both("relevance", f"SELECT doc_id, type, type IN ('ADDRESS', 'ORG') AND NOT {_has(WORDS.OWN)} AND {_has(WORDS.TOPIC)} AS preserved FROM ({_asks})")
both("snippet_offsets", f"SELECT doc_id, value, cast(instr(text, value) - 1 as int) AS evidence_start, instr(text, value) > 0 AS verbatim FROM ({_asks})")
_skip = ", ".join(f"('{k}')" for k in WORDS.SKIP_KEYS)
both("telemetry_fields", f"SELECT event_id, k FROM (SELECT event_id, CASE cast(event_id % 4 as int) WHEN 0 THEN 'http.method' WHEN 1 THEN 'user.note' WHEN 2 THEN 'span.kind' ELSE event_type END AS k FROM events) e LEFT ANTI JOIN (SELECT * FROM (VALUES {_skip}) t(key)) s ON k = key".replace("LEFT ANTI JOIN", "LEFT ANTI JOIN"))
ORACLE["telemetry_fields"] = ORACLE["telemetry_fields"].replace("LEFT ANTI JOIN", "ANTI JOIN")

# Streams and the control plane over events ---------------------------------------------------
_sec = lambda d: "unix_timestamp(ts)" if d.spark else "cast(floor(epoch(ts)) as bigint)"
both("token_window", lambda d: f"SELECT event_id, user_id, cast(sum(tokens) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) as bigint) AS used FROM (SELECT event_id, user_id, {_sec(d)} AS s, cast(floor(value) as bigint) + 1 AS tokens FROM events)")
both("usage_estimate", lambda d: f"SELECT cast(conv_id as bigint) AS conv_id, cast(sum(cast(floor({d.bytes('text')} / 3.0) as bigint)) as bigint) AS tokens, cast(count(*) as bigint) AS turns FROM conversations GROUP BY conv_id")
both("preemption_rise", "SELECT event_id, user_id, coalesce(p > lag(p) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS rose FROM (SELECT event_id, user_id, ts, event_id % 5 AS p FROM events)")
both("affinity_key", lambda d: f"SELECT conv_id, {'sha2(' if d.spark else 'sha256('}role || ':' || text{', 256)' if d.spark else ')'} AS prefix_key FROM conversations WHERE turn = 0")
both("cache_hits", "SELECT source, cast(count(*) as bigint) AS calls, cast(count(*) - count(DISTINCT text) as bigint) AS hits FROM documents GROUP BY source")
both("latency_percentiles", "SELECT event_type, max(CASE WHEN rn = cast(floor(0.5 * (n - 1)) as bigint) + 1 THEN value END) AS p50, max(CASE WHEN rn = cast(floor(0.99 * (n - 1)) as bigint) + 1 THEN value END) AS p99 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")


# Line formats and payloads --------------------------------------------------------------------
_lines = """SELECT conv_id AS stream_id, turn * 8 + n AS line_no, CASE n WHEN 0 THEN 'event: ' || role WHEN 1 THEN 'id:' || turn WHEN 2 THEN CASE WHEN turn % 2 = 0 THEN ': note' ELSE 'retry: 30' END
    WHEN 3 THEN 'data: ' || role || ': ' || length(text) WHEN 4 THEN 'data' WHEN 5 THEN 'data:' || conv_id WHEN 6 THEN 'event: again' ELSE CASE WHEN turn % 3 = 2 THEN 'other: x' ELSE '' END END AS line
    FROM conversations CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) t(n) WHERE text IS NOT NULL"""
both("sse_events", lambda d: L.events(d, _lines))
_metrics = """SELECT 'b' || cast(floor(event_id / 8) as bigint) AS backend, CASE event_id % 8 WHEN 0 THEN '# HELP x' WHEN 1 THEN 'vllm:num_requests_running{m="x y"} ' || event_id WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN 'vllm:num_requests_waiting 9' ELSE 'vllm:num_requests_waiting nothing' END
    WHEN 3 THEN 'vllm:gpu_cache_usage_perc{m="x"} 0.5' WHEN 4 THEN 'vllm:prefix_cache_hits_total 1e3' WHEN 5 THEN 'vllm:num_preemptions_total 2.0' WHEN 6 THEN 'other 5' ELSE 'vllm:prefix_cache_queries_total ' || event_id END AS line FROM events"""
both("load_snapshots", lambda d: L.snapshots(d, _metrics))
_payloads = "SELECT cast(conv_id * 1000 + turn as bigint) AS doc_id, to_json(named_struct('model', 'm', 'big', 9007199254740993, 'messages', array(named_struct('role', role, 'content', text)))) AS payload FROM conversations"
frame("payload_leaves", lambda spark, d: D.leaves(run(spark, d, _payloads)), "SELECT (conv_id * 1000 + turn)::BIGINT AS doc_id, 0 AS leaf_no, 'messages/0/content' AS path, text FROM conversations WHERE text IS NOT NULL")


def _sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = run(spark, sf_dir, _payloads)
    found = D.leaves(payloads).select("doc_id", "leaf_no", F.regexp_replace("text", "[0-9]", "#").alias("text"))
    out = D.put_back(payloads, found)
    return out.select("doc_id", F.get_json_object("payload", "$.messages[0].content").alias("content"), F.get_json_object("payload", "$.big").alias("big"))


frame("payload_round_trip", _sanitized, "SELECT (conv_id * 1000 + turn)::BIGINT AS doc_id, regexp_replace(text, '[0-9]', '#', 'g') AS content, '9007199254740993' AS big FROM conversations")


from . import control, names  # noqa: E402, F401  they register their queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by keyed hashes."""
    return QUERIES["redact_documents"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
