"""The control plane as queries over request logs and load samples: windows, pressure, admission, routing, budgets, rings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of a window; thresholds of pressure; seconds until a sample is stale and a preemption forgotten.
WINDOW_SECONDS = 60
KV_HIGH, KV_CRITICAL, WAIT_HIGH, WAIT_CRITICAL, STALE, REMEMBER = 0.75, 0.90, 8, 32, 15, 30
#: Failures that open a breaker, seconds it stays open, calls it lets through then.
FAILURES, OPEN_SECONDS, PROBES = 5, 30, 2
VNODES, LOAD_FACTOR = 128, 1.25


def window_usage(log: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Tokens in the sliding window after each row of ``log`` (subject, ts in seconds, seq, kind, request, tokens).

    ``reserve`` charges prompt and most output at once; ``commit`` takes that back and charges what was used, now;
    ``release`` only takes it back.  A charge leaves the window ``seconds`` after its own time.  Every charge is a step
    up and, later, a step down, so one running sum over a subject's steps gives the usage at any time.
    """
    held = log.filter("kind = 'reserve'").select("subject", "request", F.col("ts").alias("held_ts"), F.col("tokens").alias("held"))
    rows = log.join(held, ["subject", "request"], "left")
    step = lambda ts, amount, rank: F.struct(ts.cast("long").alias("at"), F.lit(rank).alias("rank"), amount.cast("long").alias("amount"))
    own, due, back = F.col("tokens"), F.col("held_ts") + seconds, F.coalesce(F.when((F.col("kind") != "reserve") & (F.col("held_ts") + seconds > F.col("ts")), F.col("held")), F.lit(0))
    charge = F.when(F.col("kind") == "release", 0).otherwise(own)
    steps = F.array(step(F.col("ts"), charge - back, 1), step(F.col("ts") + seconds, -charge, 0), step(F.coalesce(due, F.col("ts")), back, 0))
    flat = rows.select("subject", "seq", F.posexplode(steps).alias("n", "s")).select("subject", "seq", "n", "s.*")
    order = Window.partitionBy("subject").orderBy("at", "rank", "seq", "n").rowsBetween(Window.unboundedPreceding, 0)
    return flat.withColumn("used", F.sum("amount").over(order)).filter("n = 0").select("subject", "seq", F.col("at").alias("ts"), "used")


def pressure(kv: Column, waiting: Column, valid: Column, age: Column, since_preemption: Column) -> Column:
    """unknown without a fresh valid sample; critical by cache, queue or a preemption not long ago; elevated; normal."""
    fresh = valid & (age <= STALE)
    critical = (kv >= KV_CRITICAL) | (waiting >= WAIT_CRITICAL) | F.coalesce(since_preemption <= REMEMBER, F.lit(False))
    high = (kv >= KV_HIGH) | (waiting >= WAIT_HIGH)
    return F.when(~F.coalesce(fresh, F.lit(False)), "unknown").when(critical, "critical").when(high, "elevated").otherwise("normal")


def admitted(pressure_of: Column, priority: Column) -> Column:
    """Under unknown or elevated pressure from priority 4 on, under critical from 8 on."""
    return F.when(pressure_of == "normal", True).when(pressure_of == "critical", priority >= 8).otherwise(priority >= 4)


def admission(requests: DataFrame, samples: DataFrame) -> DataFrame:
    """``requests`` (backend, ts, request, priority) with the pressure by the last sample before each, and whether admitted.

    ``samples``: backend, ts, kv, waiting, preemptions, valid.  An as-of join without a join: requests and samples of a
    backend stand in one order and each request looks back at the last sample.
    """
    before = Window.partitionBy("backend").orderBy("ts")
    rose = samples.withColumn("rose_at", F.when(F.col("preemptions") > F.lag("preemptions").over(before), F.col("ts")))
    nulls = lambda df, cols: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols]
    kept = ["kv", "waiting", "valid", "rose_at"]
    a = rose.select("backend", "ts", F.lit(0).alias("is_request"), F.col("ts").alias("sample_ts"), *kept, *nulls(requests, ("request", "priority")))
    b = requests.select("backend", "ts", F.lit(1).alias("is_request"), F.lit(None).cast(samples.schema["ts"].dataType).alias("sample_ts"), *nulls(rose, kept), "request", "priority")
    last = Window.partitionBy("backend").orderBy("ts", "is_request").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).select("backend", "ts", "is_request", "request", "priority", *(F.last(c, True).over(last).alias(c) for c in ("sample_ts", *kept)))
    rows = rows.filter("is_request = 1").withColumn("pressure", pressure(F.col("kv"), F.col("waiting"), F.col("valid"), F.col("ts") - F.col("sample_ts"), F.col("ts") - F.col("rose_at")))
    return rows.select("backend", "ts", "request", "priority", "pressure", admitted(F.col("pressure"), F.col("priority")).alias("admitted"))


def breaker(calls: DataFrame) -> DataFrame:
    """``calls`` (target, ts in seconds, seq, failed) with ``allowed`` and the ``state`` after each: closed, open, half_open.

    A target's calls pass in order through a task that holds three numbers, however many there are.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, state, failures, until, probes = None, "closed", 0, 0, 0
        for frame in frames:
            out = []
            for r in frame.itertuples():
                if r.target != target:
                    target, state, failures, until, probes = r.target, "closed", 0, 0, 0
                if state == "open" and r.ts >= until:
                    state, probes = "half_open", 0
                allowed = state == "closed" or (state == "half_open" and probes < PROBES)
                if allowed:
                    probes += state == "half_open"
                    if not r.failed:
                        state, failures = "closed", 0
                    else:
                        failures += 1
                        if state == "half_open" or failures >= FAILURES:
                            state, until = "open", r.ts + OPEN_SECONDS
                out.append((r.target, r.ts, r.seq, allowed, state))
            yield pd.DataFrame(out, columns=["target", "ts", "seq", "allowed", "state"])

    rows = calls.select("target", "ts", "seq", "failed").repartition("target").sortWithinPartitions("target", "ts", "seq")
    return rows.mapInPandas(run, "target string, ts long, seq long, allowed boolean, state string")


def glob(pattern: str) -> str:
    """A file name pattern (*, ?, [set]) as a regular expression; * doesn't cross a slash."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 1)) > 0:
            out, i = out + "[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]", end
        else:
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"


def identity(headers: Column) -> Column:
    """tenant, app, task, priority, tier, session of a request's headers (a map with lower-case names), defaults filled in."""
    h = lambda name, other="": F.coalesce(F.nullif(F.trim(F.element_at(headers, f"x-{name}")), F.lit("")), F.lit(other))
    priority = F.coalesce(h("priority").try_cast("int"), F.lit(5))
    task = F.when(F.lower(h("task")).isin("chat", "code", "extract", "embed", "agent"), F.lower(h("task"))).otherwise("chat")
    tenant, app = h("tenant", "default"), h("app", "unknown")
    session = F.coalesce(F.nullif(h("session"), F.lit("")), F.nullif(h("conversation"), F.lit("")), F.concat_ws("/", tenant, app))
    return F.struct(tenant.alias("tenant"), app.alias("app"), task.alias("task"), F.least(F.greatest(priority, F.lit(0)), F.lit(9)).alias("priority"), F.lower(h("tier")).alias("tier"), session.alias("session"))


def check_rules(rules: list[dict], tiers: set[str], fallback: dict[str, str]) -> None:
    """Rules and the chain of cheaper tiers: every tier exists, names are told apart, and the chain ends."""
    wrong = [f"{r['name']}: no tier {r['tier']}" for r in rules if r["tier"] not in tiers] + [f"no tier {t}" for t in {*fallback, *fallback.values()} - tiers]
    names = [r["name"] for r in rules]
    wrong += [f"a rule twice: {n}" for n in sorted({n for n in names if names.count(n) > 1})]
    for start in fallback:
        seen, at = set(), start
        while at in fallback and at not in seen:
            seen.add(at)
            at = fallback[at]
        wrong += [f"the chain from {start} comes back to {at}"] if at in seen else []
    if wrong:
        raise ValueError("; ".join(wrong))


def route(requests: DataFrame, rules: list[dict], defaults: dict[str, str], live: set[str]) -> DataFrame:
    """``requests`` (tenant, app, task, priority, tier) with ``rule`` and ``target_tier``: an explicit tier that is live,
    else the first rule that holds (app pattern, task, tenant, least priority; in order of priority, then of the list), else the task's default."""
    tier, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: -r.get("priority", 0))[::-1]:
        test = F.lit(True)
        for column, key in (("task", "task"), ("tenant", "tenant")):
            test = test & (F.col(column) == r[key]) if r.get(key) else test
        test = test & F.col("app").rlike(glob(r["app"])) if r.get("app") else test
        test = test & (F.col("priority") >= r["min_priority"]) if r.get("min_priority") is not None else test
        tier, name = F.when(test, r["tier"]).otherwise(tier), F.when(test, r["name"]).otherwise(name)
    explicit = F.col("tier").isin(*live) if live else F.lit(False)
    fallback = F.lit(None).cast("string")
    for task, t in defaults.items():
        fallback = F.when(F.col("task") == task, t).otherwise(fallback)
    return requests.withColumn("rule", F.when(explicit, "explicit").otherwise(F.coalesce(name, F.lit("default")))).withColumn("target_tier", F.when(explicit, F.col("tier")).otherwise(F.coalesce(tier, fallback)))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are per million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / F.lit(1_000_000.0)


def budgets(spending: DataFrame, limits: DataFrame, fallback: dict[str, str], soft: float = 0.8) -> DataFrame:
    """``spending`` (tenant, ts, seq, tier, cost) with what was spent before and the tier it goes to: beyond the soft share of
    ``limits`` (tenant, budget) one step down the chain, beyond the whole to its end."""
    before = F.coalesce(F.sum("cost").over(Window.partitionBy("tenant").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    end = dict(fallback)
    for t in end:
        while end[t] in fallback:
            end[t] = fallback[end[t]]
    down = lambda to: F.coalesce(F.create_map(*(F.lit(x) for kv in to.items() for x in kv))[F.col("tier")], F.col("tier")) if to else F.col("tier")
    rows = spending.withColumn("spent", before).join(limits, "tenant", "left")
    over, near = F.col("spent") >= F.col("budget"), F.col("spent") >= soft * F.col("budget")
    return rows.withColumn("goes_to", F.when(F.coalesce(over, F.lit(False)), down(end)).when(F.coalesce(near, F.lit(False)), down(fallback)).otherwise(F.col("tier")))


def place(key: Column) -> Column:
    """A place on the ring: the first 60 bits of a digest."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long")


def prefix_key(model: Column, system: Column, tools: Column) -> Column:
    """What requests that can share a cached prefix have in common."""
    return F.sha2(F.concat_ws("\x00", F.coalesce(model, F.lit("")), F.coalesce(system, F.lit("")), F.coalesce(tools, F.lit(""))), 256)


def assign(requests: DataFrame, targets: DataFrame, load: DataFrame | None = None, vnodes: int = VNODES) -> DataFrame:
    """``requests`` (…, key) with ``target``: the next on a ring of ``vnodes`` places a target, passing over those whose
    load (target, inflight) is beyond LOAD_FACTOR times the mean; if all are, the next one whatever its load.

    The ring is as large as targets x vnodes: a few thousand rows, held as one sorted array.
    """
    ring = targets.select("target", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v")).select("target", place(F.concat_ws("#", "target", F.col("v").cast("string"))).alias("at"))
    if load is not None:
        mean = load.agg(F.avg(F.col("inflight") + 1)).first()[0] or 1.0
        ring = ring.join(load, "target", "left").withColumn("free", F.coalesce("inflight", F.lit(0)) + 1 <= LOAD_FACTOR * mean)
    else:
        ring = ring.withColumn("free", F.lit(True))
    whole = F.broadcast(ring.agg(F.sort_array(F.collect_list(F.struct("at", "target", "free"))).alias("ring")))
    rows = requests.withColumn("at", place(F.col("key"))).join(whole)
    pick = "coalesce(get(filter(ring, x -> x.free and x.at >= at), 0), get(filter(ring, x -> x.free), 0), get(filter(ring, x -> x.at >= at), 0), get(ring, 0)).target"
    return rows.withColumn("target", F.expr(pick)).drop("ring", "at")


def candidates(targets: DataFrame) -> Column:
    """Rank of a target (tier, breaker, pressure, order) within its tier: closed breakers without critical pressure first."""
    return F.row_number().over(Window.partitionBy("tier").orderBy((F.col("breaker") == "open").cast("int"), (F.col("pressure") == "critical").cast("int"), "order"))


def first_frames(requests: DataFrame, frames: DataFrame) -> DataFrame:
    """Mean and count of the time to a request's first text or tool call, by what that was.

    ``requests``: request, started.  ``frames``: request, ts, seq, class; other classes don't count."""
    first = frames.filter(F.col("class").isin("text", "tool_call")).groupBy("request").agg(F.min_by(F.struct("ts", "class"), F.struct("ts", "seq")).alias("f"))
    rows = requests.join(first, "request").select(F.col("f.class").alias("class"), (F.col("f.ts") - F.col("started")).alias("gap"))
    return rows.groupBy("class").agg(F.count("*").cast("long").alias("n"), F.avg("gap").alias("mean_gap"))
