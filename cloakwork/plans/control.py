"""Registered queries of the control plane over the events table; the SQL beside them is written another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import Keyring
from ..operators import audit, control
from ..operators import documents as D
from .base import frame, run

LOG = """SELECT 's' || cast(cast(floor(event_id / 3) as bigint) % 7 as varchar(3)) AS subject, cast(event_id * 7 as bigint) AS ts, cast(event_id as bigint) AS seq,
    CASE WHEN event_id % 3 = 1 AND cast(floor(event_id / 3) as bigint) % 2 = 0 THEN 'commit' WHEN event_id % 3 = 1 THEN 'release' ELSE 'reserve' END AS kind,
    cast(CASE WHEN event_id % 3 = 2 THEN -event_id ELSE floor(event_id / 3) END as bigint) AS request, cast(floor(value) + 1 as bigint) AS tokens FROM events"""
frame(
    "token_reservations",
    lambda spark, d: control.window_usage(run(spark, d, LOG)),
    f"""WITH log AS ({LOG}), held AS (SELECT subject, request, ts AS held_ts, tokens AS held FROM log WHERE kind = 'reserve'),
    charges AS (SELECT subject, ts AS own, ts AS known, seq, CASE kind WHEN 'release' THEN 0 ELSE tokens END AS amount FROM log
        UNION ALL SELECT l.subject, held_ts, l.ts, l.seq, -held FROM log l JOIN held USING (subject, request) WHERE l.kind <> 'reserve')
    SELECT l.subject, l.seq, l.ts, sum(c.amount)::BIGINT AS used FROM log l JOIN charges c ON c.subject = l.subject AND (c.known < l.ts OR (c.known = l.ts AND c.seq <= l.seq)) AND c.own > l.ts - 60 GROUP BY ALL""",
)

SAMPLES = "SELECT 'b' || cast(event_id % 5 as varchar(2)) AS backend, cast(event_id * 7 as bigint) AS ts, cast(event_id * 37 % 100 as double) / 100 AS kv, cast(event_id % 41 as int) AS waiting, cast(floor(event_id / 50) as double) AS preemptions, event_id % 11 <> 0 AS valid FROM events WHERE event_id % 3 = 0"
REQUESTS = "SELECT 'b' || cast(event_id % 6 as varchar(2)) AS backend, cast(event_id * 7 as bigint) AS ts, cast(event_id as bigint) AS request, cast(event_id % 10 as int) AS priority FROM events WHERE event_id % 3 <> 0"
frame(
    "admission",
    lambda spark, d: control.admission(run(spark, d, REQUESTS), run(spark, d, SAMPLES)),
    f"""WITH s AS (SELECT *, preemptions > lag(preemptions) OVER (PARTITION BY backend ORDER BY ts) AS rose FROM ({SAMPLES})), up AS (SELECT backend, ts AS up_ts FROM s WHERE rose), r AS ({REQUESTS}),
    j AS (SELECT r.*, s.ts AS sample_ts, kv, waiting, valid FROM r ASOF LEFT JOIN s ON r.backend = s.backend AND r.ts >= s.ts),
    p AS (SELECT j.*, up_ts, CASE WHEN sample_ts IS NULL OR NOT valid OR j.ts - sample_ts > 15 THEN 'unknown' WHEN kv >= 0.9 OR waiting >= 32 OR j.ts - up_ts <= 30 THEN 'critical' WHEN kv >= 0.75 OR waiting >= 8 THEN 'elevated' ELSE 'normal' END AS pressure
        FROM j ASOF LEFT JOIN up ON j.backend = up.backend AND j.ts >= up.up_ts)
    SELECT backend, ts, request, priority, pressure, CASE pressure WHEN 'normal' THEN true WHEN 'critical' THEN priority >= 8 ELSE priority >= 4 END AS admitted FROM p""",
)

HEADS = "SELECT cast(event_id as bigint) AS request, map('x-tenant', 't' || event_id % 3, 'x-app', event_type || '/' || event_id % 4, 'x-priority', cast(event_id % 12 as string), 'x-task', CASE WHEN event_id % 5 = 0 THEN 'code' ELSE 'chat' END, 'x-tier', CASE WHEN event_id % 11 = 0 THEN 'Fast' ELSE '' END) AS headers FROM events"
RULES = [{"name": "bulk", "tier": "slow", "app": "*/3"}, {"name": "code", "tier": "big", "task": "code", "priority": 5}, {"name": "vip", "tier": "big", "min_priority": 9, "tenant": "t1"}]


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, HEADS).select("request", control.identity(F.col("headers")).alias("i")).select("request", "i.*")
    return control.route(rows, RULES, {"chat": "mid"}, {"fast"}).select("request", "tenant", "app", "task", "priority", "session", "rule", "target_tier")


frame(
    "route_decision",
    _routed,
    """WITH r AS (SELECT event_id::BIGINT AS request, 't' || event_id % 3 AS tenant, event_type || '/' || event_id % 4 AS app, CASE WHEN event_id % 5 = 0 THEN 'code' ELSE 'chat' END AS task, least(9, event_id % 12)::INT AS priority, event_id % 11 = 0 AS fast, event_id % 4 = 3 AS bulk FROM events)
    SELECT request, tenant, app, task, priority, tenant || '/' || app AS session, CASE WHEN fast THEN 'explicit' WHEN task = 'code' THEN 'code' WHEN bulk THEN 'bulk' WHEN priority >= 9 AND tenant = 't1' THEN 'vip' ELSE 'default' END AS rule,
        CASE WHEN fast THEN 'fast' WHEN task = 'code' THEN 'big' WHEN bulk THEN 'slow' WHEN priority >= 9 AND tenant = 't1' THEN 'big' ELSE 'mid' END AS target_tier FROM r""",
)
SPENT = "SELECT 't' || cast(user_id % 9 as varchar(3)) AS tenant, cast(event_id as bigint) AS ts, cast(event_id as bigint) AS seq, CASE WHEN event_id % 2 = 0 THEN 'big' ELSE 'mid' END AS tier, cast(event_id % 7 as double) AS cost FROM events"
frame(
    "budget_crossing",
    lambda spark, d: control.budgets(run(spark, d, SPENT), run(spark, d, "SELECT * FROM (VALUES ('t1', 100D), ('t2', 50D)) t(tenant, budget)"), {"big": "mid", "mid": "slow"}).select("tenant", "seq", "tier", "spent", "goes_to"),
    f"""WITH s AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY tenant ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM ({SPENT})), b AS (SELECT * FROM s LEFT JOIN (VALUES ('t1', 100), ('t2', 50)) t(tenant, budget) USING (tenant))
    SELECT tenant, seq, tier, spent, CASE WHEN spent >= budget THEN 'slow' WHEN spent >= 0.8 * budget THEN CASE tier WHEN 'big' THEN 'mid' ELSE 'slow' END ELSE tier END AS goes_to FROM b""",
)
TARGETS = "SELECT * FROM (VALUES ('t0'), ('t1'), ('t2'), ('t3'), ('t4')) t(target)"
KEYS = "SELECT DISTINCT 'conversation ' || cast(conv_id as varchar(20)) AS key FROM conversations"
frame(
    "ring_assignment",
    lambda spark, d: control.assign(run(spark, d, KEYS), run(spark, d, TARGETS)),
    f"""WITH ring AS (SELECT target, ('0x' || substr(sha256(target || '#' || v), 1, 15))::BIGINT AS place FROM ({TARGETS}) CROSS JOIN (SELECT unnest(range(0, 128)) AS v)), k AS (SELECT key, ('0x' || substr(sha256(key), 1, 15))::BIGINT AS place FROM ({KEYS}))
    SELECT key, coalesce((SELECT arg_min(target, r.place) FROM ring r WHERE r.place >= k.place), (SELECT arg_min(target, place) FROM ring)) AS target FROM k""",
)
CALLS = "SELECT 'u' || cast(user_id % 20 as varchar(3)) AS target, cast(event_id * 3 as bigint) AS ts, cast(event_id as bigint) AS seq, event_id % 3 > 0 AS failed FROM events"
frame("breaker_states", lambda spark, d: control.breaker(run(spark, d, CALLS)), None)
FRAMES = "SELECT cast(floor(event_id / 4) as bigint) AS request, cast(event_id as bigint) AS ts, cast(event_id % 4 as bigint) AS seq, CASE WHEN event_id % 3 = 0 THEN 'other' WHEN event_id % 7 = 0 THEN 'tool_call' ELSE 'text' END AS class FROM events"
frame(
    "first_token_gap",
    lambda spark, d: control.first_frames(run(spark, d, "SELECT DISTINCT cast(floor(event_id / 4) as bigint) AS request, cast(floor(event_id / 4) * 4 - 1 as bigint) AS started FROM events"), run(spark, d, FRAMES)).select("class", "n", F.round("mean_gap", 6).alias("mean_gap")),
    f"SELECT class, count(*)::BIGINT AS n, round(avg(ts - (request * 4 - 1)), 6) AS mean_gap FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY ts, seq) AS rn FROM ({FRAMES}) WHERE class <> 'other') WHERE rn = 1 GROUP BY class",
)
frame(
    "frame_classes",
    lambda spark, d: run(spark, d, "SELECT cast(conv_id * 1000 + turn as bigint) AS doc_id, to_json(named_struct('choices', array(named_struct('delta', named_struct('content', CASE WHEN role = 'user' THEN text ELSE '' END, 'tool_calls', CASE WHEN role = 'assistant' THEN array(text) END))))) AS frame FROM conversations").select("doc_id", D.frame_class(F.col("frame")).alias("class")),
    "SELECT (conv_id * 1000 + turn)::BIGINT AS doc_id, CASE WHEN role = 'user' AND coalesce(text, '') <> '' THEN 'text' WHEN role = 'assistant' THEN 'tool_call' ELSE 'other' END AS class FROM conversations WHERE text IS NOT NULL",
)


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT 'acme' AS tenant, cast(user_id as string) AS session, event_id AS request, event_id AS ts, CASE WHEN event_id % 10 = 0 THEN 'blocked' ELSE 'ok' END AS status, CASE WHEN event_id % 10 = 0 THEN 'strategy' END AS error_class, map('EMAIL', cast(event_id % 3 as bigint)) AS entities, cast(event_id % 2 as bigint) AS restored FROM events")
    return audit.totals(audit.events(rows, Keyring(bytes(range(32)), b"salt").frame(spark, ["acme"]), "redact"))


frame("audit_totals", _audited, "SELECT 'acme' AS tenant, count(*) AS events, sum((event_id % 10 = 0)::INT)::BIGINT AS blocked, count(DISTINCT user_id) AS sessions, sum(event_id % 3)::BIGINT AS entities, sum(event_id % 2)::BIGINT AS restored FROM events")
