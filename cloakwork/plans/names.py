"""Registered queries: rosters, surnames, verification, chunks and tokens, with SQL written apart where there is some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.dialect import DUCK
from ..functions.keys import Keyring, derive, hmac_hex
from ..operators import evaluate, flows, rosters, tokens
from ..operators import recognizers as R
from ..operators import verify as V
from .base import ALL_TEXTS, MAIN, K, all_texts, frame, run

PEOPLE = "SELECT cast(c_custkey as bigint) AS doc_id, 'from ' || lower(n_name) || ' and ' || n_name || ' 张伟 小李娜 欧阳修的 ' || c_name || ' 经办人' || substr('上官诸葛司马欧阳南宫慕容', cast(c_custkey % 6 * 2 + 1 as int), 2) || '志远 已签' AS text FROM customer JOIN nation ON c_nationkey = n_nationkey"
ROSTER = "SELECT 'COUNTRY' AS type, lower(n_name) AS term FROM nation UNION ALL SELECT 'NAME', '张伟' UNION ALL SELECT 'NAME', '李娜'"
_place = "strlen(left(text, pos - 1))::INT AS start"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, PEOPLE)


frame(
    "roster_hits",
    lambda spark, d: rosters.find_terms(people(spark, d), run(spark, d, ROSTER)),
    f"""SELECT doc_id, 'roster' AS detector, type, substr(text, pos, length(term)) AS value, {_place}, (strlen(left(text, pos - 1)) + strlen(substr(text, pos, length(term))))::INT AS "end",
        (pos - 1)::INT AS start_cp, (pos - 1 + length(term))::INT AS end_cp, 0.98::DOUBLE AS confidence
    FROM (SELECT doc_id, text, lower(text) AS t, unnest(range(1, length(text) + 1)) AS pos FROM ({PEOPLE})) JOIN ({ROSTER}) r ON substr(t, pos, length(term)) = term WHERE length(term) >= 2""",
)
_list = ", ".join(f"('{s}')" for s in W.COMPOUND_SURNAMES)
frame(
    "surname_candidates",
    lambda spark, d: rosters.find_names(people(spark, d)),
    f"""SELECT doc_id, 'cn_surname' AS detector, 'NAME' AS type, substr(text, pos, 2 + n) AS value, {_place}, (strlen(left(text, pos - 1)) + strlen(substr(text, pos, 2 + n)))::INT AS "end", (pos - 1)::INT AS start_cp, (pos + 1 + n)::INT AS end_cp, 0.7::DOUBLE AS confidence
    FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS pos FROM ({PEOPLE})) CROSS JOIN (VALUES (1), (2)) g(n) JOIN (VALUES {_list}) s(surname) ON substr(text, pos, 2) = surname
    WHERE (pos = 1 OR strpos('{W.SURNAME_BLOCKS}', substr(text, pos - 1, 1)) = 0) AND regexp_full_match(substr(text, pos + 2, n), '\\p{{Han}}{{' || n || '}}') AND NOT regexp_matches(substr(text, pos + 2, n), '[{W.GIVEN_STOPS}]')""",
)

#: Candidates of the verifier, with right and wrong surroundings.
CASES = f"""
    SELECT {K} AS doc_id, CASE cast({K} % 12 as int) WHEN 0 THEN '请联系张伟处理' WHEN 1 THEN '寄往北京市海淀区大街' || {K} || '号。' WHEN 2 THEN '合同方为星辰科技有限公司。' WHEN 3 THEN 'invoice from Acme Global Ltd today'
        WHEN 4 THEN 'const MASK = ' || {K} || '; return MASK;' WHEN 5 THEN 'func retry(n int) error' WHEN 6 THEN '王者荣耀的新赛季' WHEN 7 THEN '请到北京市第一中级人民法院。' WHEN 8 THEN '住在广州市，联系' WHEN 9 THEN 'On Monday Acme Ltd filed' WHEN 10 THEN '由华为提供设备' ELSE 'Mr. Smith will attend 😀' END AS text,
      CASE cast({K} % 12 as int) WHEN 1 THEN 'ADDRESS' WHEN 2 THEN 'ORG' WHEN 3 THEN 'ORG' WHEN 7 THEN 'ORG' WHEN 8 THEN 'ADDRESS' WHEN 9 THEN 'ORG' WHEN 10 THEN 'ORG' ELSE 'NAME' END AS type,
      CASE cast({K} % 12 as int) WHEN 0 THEN '张伟' WHEN 1 THEN '北京市' WHEN 2 THEN '科技有限公司' WHEN 3 THEN 'Ltd' WHEN 4 THEN 'MASK' WHEN 5 THEN 'retry(n' WHEN 6 THEN '王者' WHEN 7 THEN '法院' WHEN 8 THEN '广州市' WHEN 9 THEN 'Ltd' WHEN 10 THEN '华为' ELSE 'Smith' END AS value,
      CASE WHEN {K} % 5 = 0 THEN 0.45 ELSE 0.9 END AS confidence
    FROM orders"""


def candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = run(spark, sf_dir, CASES)
    at = F.expr("instr(text, value)")
    found = rows.withColumn("at", at).withColumn("head", F.expr("left(text, at - 1)"))
    found = found.select("doc_id", F.lit("t").alias("detector"), "type", "value", F.octet_length("head").alias("start"), (F.octet_length("head") + F.octet_length("value")).alias("end"), F.length("head").alias("start_cp"), (F.length("head") + F.length("value")).alias("end_cp"), F.col("confidence").cast("double").alias("confidence"))
    return rows.select("doc_id", "text"), found


_cases = f"""SELECT doc_id, 't' AS detector, type, value, strlen(h)::INT AS start, (strlen(h) + strlen(value))::INT AS "end", length(h)::INT AS start_cp, (length(h) + length(value))::INT AS end_cp, confidence::DOUBLE AS confidence,
    h AS before, substr(text, length(h) + length(value) + 1) AS after FROM (SELECT *, left(text, strpos(text, value) - 1) AS h FROM ({CASES}))"""
frame("verify_decisions", lambda spark, d: V.decide(*candidates(spark, d)), V.decide_sql(DUCK, _cases))
frame("two_stage_summary", lambda spark, d: V.summary(V.pipeline(*candidates(spark, d))), None)
frame("core_preset", lambda spark, d: rosters.core(people(spark, d), ("CN",), run(spark, d, ROSTER)), None)
frame("chunked_scan", lambda spark, d: rosters.chunked(all_texts(spark, d), lambda docs: R.detect(docs, MAIN), 2048, 256), R.resolve_overlaps_sql(R.detect_sql(ALL_TEXTS, MAIN)))
frame("script_runs", lambda spark, d: rosters.script_runs(people(spark, d)), None)

RING = Keyring(bytes(range(32)), b"salt")
_id_key = derive(RING.root, RING.salt, "cloakwork/token-identity/e1/acme")
VALUES = "SELECT DISTINCT 'acme' AS tenant, 'CUSTOMER' AS namespace, c_name AS value FROM customer"
frame(
    "token_issue",
    lambda spark, d: tokens.issue(run(spark, d, VALUES), RING).select("tenant", "namespace", "token", "key_version", "epoch"),
    f"SELECT tenant, lower(namespace) AS namespace, left({hmac_hex(DUCK, _id_key, '(lower(namespace) || chr(0) || value)')}, 32) AS token, 'v1' AS key_version, 'e1' AS epoch FROM ({VALUES})",
)


def _tokens_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = run(spark, sf_dir, VALUES)
    store = tokens.issue(values, RING)
    marks = tokens._keyed(values, RING).select("tenant", "value", F.expr(f"'for [tok:customer:' || {tokens.token_id()} || '], and [tok:customer:00000000]'").alias("text"))
    back = tokens.restore_tokens(marks, store, RING)
    return back.select("value", "restored", "n_tokens", "phantom", "status")


frame("token_round_trip", _tokens_back, f"SELECT value, 'for ' || value || ', and [tok:customer:00000000]' AS restored, 2::INT AS n_tokens, '[tok:customer:00000000]' AS phantom, 'ok' AS status FROM ({VALUES})")

MATRIX = flows.Matrix(flows.Options(digits=12), {"Surgeon": "physician"}).add(flows.Flow("public", "mask", restores=True)).add(flows.Flow("stats", "hash", {"PHONE": "drop"}))


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to two destinations, redacted as each asks."""
    texts = run(spark, sf_dir, "SELECT cast(conv_id * 1000 + turn as bigint) AS doc_id, 'acme' AS tenant, cast(conv_id as string) AS session, cast(turn as int) AS seq, CASE WHEN conv_id % 2 = 0 THEN 'public' ELSE 'stats' END AS destination, text || ' call 13812345678 or a' || conv_id || '@mail.example' AS text FROM conversations WHERE text IS NOT NULL")
    found = R.resolve_overlaps(R.detect(texts, list(R.BUILT_IN)))
    return flows.redact_to(texts, found, MATRIX, RING)[0]


frame("redact_by_destination", _sent, None)


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = evaluate.corpus(spark, [("mail", "structured", "to {{EMAIL|a.b@example.com}} now"), ("card", "structured", "card {{BANK_CARD|4111 1111 1111 1111}}"), ("name", "names", "ask {{NAME|Ann}}"), ("none", "clean", "version 1.2.3.4")])
    found = R.resolve_overlaps(R.detect(samples.select("doc_id", "text"), list(R.BUILT_IN)))
    return evaluate.scores(evaluate.matches(samples, found))


frame("eval_by_category", _evaluated, "SELECT * FROM (VALUES ('structured', 2::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), ('names', 0, 0, 1, 0, 0, 0.0, 1.0, 0.0), ('clean', 0, 0, 0, 0, 0, 1.0, 1.0, 1.0), (NULL, 2, 0, 1, 0, 0, 2 / 3.0, 1.0, 0.8)) t(category, tp, fp, fn, partial, type_mismatch, recall, precision, f1)")
