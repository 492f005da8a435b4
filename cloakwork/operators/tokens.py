"""Tokens for values and the table that resolves them: idempotent issue, authenticated encryption, expiry, erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import NAMESPACE, Keyring, hmac_under

#: Fixed form of a token in a text.
TOKEN = r"\[tok:([a-z0-9_]+):([0-9a-fA-F]{8,64})\]"
RECORD = "ctr1"
STORE = "tenant string, namespace string, token string, key_version string, epoch string, nonce binary, cipher binary, expires_at timestamp"


def tenants_of(rows: DataFrame) -> list[str]:
    """The tenants of a frame: as many as there are customers, never as many as rows."""
    return [r.tenant for r in rows.select("tenant").distinct().collect()]


def _keyed(rows: DataFrame, ring: Keyring) -> DataFrame:
    return rows.join(F.broadcast(ring.frame(rows.sparkSession, tenants_of(rows))), "tenant")


def token_id() -> str:
    """32 hex digits that only the tenant's key, the namespace and the value determine."""
    return f"left({hmac_under('(lower(namespace) || char(0) || value)', 'id_in', 'id_out')}, 32)"


def _aad() -> str:
    return "concat_ws('|', tenant, namespace, token, key_version, epoch)"


def issue(values: DataFrame, ring: Keyring, store: DataFrame | None = None, ttl_seconds: int | None = None, now: Column | None = None) -> DataFrame:
    """Records to append for ``values`` (tenant, namespace, value): one for each distinct value that has no live record.

    Issue is idempotent: token, nonce and cipher depend on keys and value alone.  A record's expiry is set once and isn't
    moved by later issues.
    """
    now = now if now is not None else F.current_timestamp()
    rows = values.select("tenant", F.lower("namespace").alias("namespace"), "value").filter(F.col("value").isNotNull()).distinct()
    if bad := rows.filter(~F.col("namespace").rlike(NAMESPACE)).select("namespace").distinct().limit(5).collect():
        raise ValueError(f"not namespaces: {', '.join(r.namespace for r in bad)}")
    rows = _keyed(rows, ring).withColumn("token", F.expr(token_id())).withColumns({"key_version": F.lit(ring.version), "epoch": F.lit(ring.epoch)})
    if store is not None:
        rows = rows.join(live(store, now).select("tenant", "namespace", "token"), ["tenant", "namespace", "token"], "left_anti")
    nonce = F.expr(f"substring(unhex({hmac_under('token', 'id_in', 'id_out')}), 1, 12)")
    rows = rows.withColumn("nonce", nonce).withColumn("cipher", F.expr(f"aes_encrypt(cast(value as binary), data_key, 'GCM', 'DEFAULT', nonce, {_aad()})"))
    expires = (now + F.expr(f"interval {ttl_seconds} seconds")) if ttl_seconds else F.lit(None)
    return rows.withColumn("expires_at", expires.cast("timestamp")).select(*(c.split()[0] for c in STORE.split(", ")))


def live(store: DataFrame, now: Column | None = None) -> DataFrame:
    now = now if now is not None else F.current_timestamp()
    return store.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def resolve(tokens: DataFrame, store: DataFrame, ring: Keyring, now: Column | None = None) -> DataFrame:
    """``tokens`` (tenant, namespace, token) with value and status: ok, unknown (none, expired, or another tenant's) or
    store_error (a record that its key and labels don't open)."""
    known = _keyed(live(store, now), ring) if store.head(1) else store.select("*", *(F.lit(None).cast("binary").alias(c) for c in ("data_key",)))
    opened = known.withColumn("value", F.expr(f"cast(try_aes_decrypt(cipher, data_key, 'GCM', 'DEFAULT', {_aad()}) as string)"))
    own = (F.col("key_version") == ring.version) & (F.col("epoch") == ring.epoch)
    opened = opened.select("tenant", "namespace", "token", F.when(own, F.col("value")).alias("value"), F.lit(True).alias("found")).dropDuplicates(["tenant", "namespace", "token"])
    rows = tokens.join(opened, ["tenant", "namespace", "token"], "left")
    status = F.when(F.col("found").isNull(), "unknown").when(F.col("value").isNull(), "store_error").otherwise("ok")
    return rows.withColumn("status", status).drop("found")


def erase(store: DataFrame, tenant: str) -> tuple[DataFrame, int]:
    """The store without a tenant's records, and how many those were."""
    return store.filter(~F.col("tenant").eqNullSafe(F.lit(tenant))), store.filter(F.col("tenant") == tenant).count()


def encode(store: DataFrame) -> DataFrame:
    """Records as one line each: schema, key version, epoch, nonce, cipher, expiry in seconds (0: never)."""
    plain = lambda c: F.rtrim(F.regexp_replace(F.base64(c), "[\\r\\n=]", ""))
    line = F.concat_ws(".", F.lit(RECORD), "key_version", "epoch", plain("nonce"), plain("cipher"), F.coalesce(F.unix_timestamp("expires_at"), F.lit(0)).cast("string"))
    return store.select("tenant", "namespace", "token", line.alias("record"))


def decode(lines: DataFrame) -> DataFrame:
    """The store's columns and ``bad`` for lines of another schema or number of fields."""
    p = F.split("record", "[.]")
    fine = (F.size(p) == 6) & (F.get(p, F.lit(0)) == RECORD)
    part = lambda i: F.when(fine, F.get(p, F.lit(i)))
    full = lambda x: F.unbase64(F.rpad(x, F.ceil(F.length(x) / 4).cast("int") * 4, F.lit("=")))
    seconds = part(5).try_cast("long")
    rows = lines.select("tenant", "namespace", "token", part(1).alias("key_version"), part(2).alias("epoch"), full(part(3)).alias("nonce"), full(part(4)).alias("cipher"), F.when(seconds > 0, F.timestamp_seconds(seconds)).alias("expires_at"), (~fine | seconds.isNull()).alias("bad"))
    return rows


def restore_tokens(texts: DataFrame, store: DataFrame, ring: Keyring, now: Column | None = None) -> DataFrame:
    """``texts`` (tenant, text, …) with ``restored``, n_tokens, ``phantom`` (unknown tokens) and ``status``: store_error
    where a record couldn't be opened, as that isn't the same as an unknown token.  Unresolved tokens stay as they are."""
    rows = texts.withColumn("row_no", F.monotonically_increasing_id())
    whole = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    rows = rows.withColumn("whole", F.coalesce(whole, F.array().cast("array<string>"))).withColumn("gaps", F.split("text", TOKEN, -1))
    asked = rows.select("tenant", F.explode("whole").alias("mark")).distinct()
    asked = asked.select("tenant", "mark", F.regexp_extract("mark", TOKEN, 1).alias("namespace"), F.lower(F.regexp_extract("mark", TOKEN, 2)).alias("token"))
    told = resolve(asked, store, ring, now)
    found = rows.select("row_no", "tenant", F.explode(F.array_distinct("whole")).alias("mark")).join(told, ["tenant", "mark"]).groupBy("row_no")
    found = found.agg(F.map_from_entries(F.collect_list(F.when(F.col("status") == "ok", F.struct("mark", "value")))).alias("known"), F.sort_array(F.collect_set(F.when(F.col("status") == "unknown", F.col("mark")))).alias("lost"), F.max(F.col("status") == "store_error").alias("broken"))
    rows = rows.join(found, "row_no", "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,string>")))
    out = F.expr("concat_ws('', transform(gaps, (g, i) -> g || case when i < size(whole) then coalesce(try_element_at(known, get(whole, i)), get(whole, i)) else '' end))")
    status = F.when(F.coalesce("broken", F.lit(False)), "store_error").otherwise("ok")
    return rows.select(*(F.col(c) for c in texts.columns), F.when(F.col("text").isNotNull(), out).alias("restored"), F.size("whole").alias("n_tokens"), F.array_join(F.coalesce("lost", F.array().cast("array<string>")), ",").alias("phantom"), status.alias("status"))
