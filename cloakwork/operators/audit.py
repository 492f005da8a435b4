"""Audit events: what was done, never what it was done to. Builders, merged counts, sinks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import hmac_under

SCHEMA = "cloakwork.audit.v1"
#: Closed lists: free text has no place in an event.
ACTIONS, OUTCOMES = ("redact", "restore", "block", "erase"), ("ok", "blocked", "degraded", "error")
ERRORS = ("strategy", "unknown_destination", "overlap", "detector", "token_store", "invalid_payload")
COUNTS = "map<string,long>"


def fingerprint() -> str:
    """A session's name as its tenant's key makes it (over session, own_in, own_out)."""
    return f"left({hmac_under('(\"session\" || char(0) || session)'.replace(chr(34), chr(39)), 'own_in', 'own_out')}, 16)"


def counted(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Counts of a column's values as one sorted map for each key."""
    per = rows.groupBy(*keys, column).agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(column), "n")))).alias(name))


def merged(a: Column, b: Column) -> Column:
    """Two maps of counts as one."""
    none = F.create_map().cast(COUNTS)
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def events(rows: DataFrame, keys: DataFrame, action: str) -> DataFrame:
    """``rows`` (tenant, session, request, ts, status, error_class and, where they apply, destination, entities, strategies,
    recognizers, restored, phantom) as events.

    The id comes from what the event is about, so an event that is built twice has one id.  An error class that isn't
    on the list becomes ``detector``; values and texts have no column here.
    """
    if action not in ACTIONS:
        raise ValueError(f"not an action: {action}")
    has = set(rows.columns)
    opt = lambda c, kind: F.col(c).cast(kind).alias(c) if c in has else F.lit(None).cast(kind).alias(c)
    kept = rows.join(F.broadcast(keys.select("tenant", "own_in", "own_out")), "tenant").withColumn("session_fingerprint", F.expr(fingerprint()))
    blocked = F.col("status") == "blocked"
    outcome = F.when(F.col("status").isin(*OUTCOMES), F.col("status")).otherwise("error")
    error = F.when(F.col("error_class").isNull(), F.lit(None).cast("string")).when(F.col("error_class").isin(*ERRORS), F.col("error_class")).otherwise("detector") if "error_class" in has else F.lit(None).cast("string")
    name = F.when(blocked, "block").otherwise(action)
    event_id = F.left(F.sha2(F.concat_ws("|", "tenant", "session_fingerprint", F.col("request").cast("string"), name, F.col("ts").cast("string")), 256), F.lit(32))
    return kept.select(
        F.lit(SCHEMA).alias("schema"), event_id.alias("event_id"), "ts", "tenant", "session_fingerprint", name.alias("action"), outcome.alias("outcome"), opt("destination", "string"),
        opt("entities", COUNTS), opt("strategies", COUNTS), opt("recognizers", COUNTS), opt("restored", "long"), opt("phantom", "long"), error.alias("error_class"),
    )


def write_lines(log: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    log.write.mode("append").json(path)


def stream_to(log: DataFrame, sinks: list, checkpoint: str, every: str = "2 seconds"):
    """Send a stream of events to several sinks, each a function of (frame, batch number), in micro-batches.

    A batch that a sink fails on is sent again; sinks know it by its number."""

    def send(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return log.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def totals(log: DataFrame) -> DataFrame:
    """By tenant: events, blocked ones, distinct sessions, entities redacted, placeholders restored."""
    size = F.aggregate(F.map_values(F.coalesce("entities", F.create_map().cast(COUNTS))), F.lit(0).cast("long"), lambda a, x: a + x)
    return log.groupBy("tenant").agg(F.count("*").alias("events"), F.sum((F.col("action") == "block").cast("long")).alias("blocked"), F.countDistinct("session_fingerprint").alias("sessions"), F.sum(size).alias("entities"), F.coalesce(F.sum("restored"), F.lit(0)).alias("restored"))


def end_sessions(vaults: DataFrame, ended: DataFrame) -> DataFrame:
    """The vault without the sessions (tenant, session) that have ended."""
    return vaults.join(ended.select("tenant", "session").distinct(), ["tenant", "session"], "left_anti")


def expired(vaults: DataFrame, created: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """The vault's sessions that are not older than ``seconds``; use doesn't make them younger.  ``created``: tenant, session, created_at."""
    young = created.filter(F.unix_timestamp("created_at") + seconds > F.unix_timestamp(now)).select("tenant", "session")
    return vaults.join(young, ["tenant", "session"], "left_semi")
