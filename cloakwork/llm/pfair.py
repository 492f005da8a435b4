"""Mixing sources to target weights by Pfair scheduling.

The stream is cut into slots, a block of one source in each.  Block i of a source of weight w
may not start before slot floor(i / w) and is due by slot ceil((i + 1) / w); the earliest
deadline among the released blocks goes first.  With weights in whole parts of one period the
plan repeats after a period, so the driver works one period out and every block finds its slot
from that table: no step walks over all blocks in one place.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

NO_SOURCE = "\x00"


@dataclass(frozen=True)
class Settings:
    """``weights``: target weight of each source, ``rest`` for each one not named; or None for counts to the power ``flatten``.
    ``period``: slots of a period; a weight is rounded to whole slots, one at least.
    ``block``: documents of a block.  ``slice_rows``, ``slices``: a source is ranked in slices of
    about so many rows, and of no more than so many slices over all sources."""

    weights: dict[str, float] | None = None
    rest: float = 1.0
    flatten: float = 0.7
    period: int = 4096
    block: int = 16
    slice_rows: int = 256
    slices: int = 20_000
    max_sources: int = 50_000
    seed: int = 7


def quotas(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots of a period for each source, one at least, adding up to the period (largest remainders)."""
    period = max(period, 2 * len(weights))
    total = sum(weights.values())
    share = {k: max(1.0, period * w / total) for k, w in weights.items()}
    out = {k: int(x) for k, x in share.items()}
    order = sorted(share, key=lambda k: (out[k] - share[k], k))
    while (gap := period - sum(out.values())) != 0:
        for k in order if gap > 0 else sorted(out, key=lambda k: (-out[k], k)):
            if gap == 0:
                break
            if gap > 0 or out[k] > 1:
                out[k] += 1 if gap > 0 else -1
                gap += -1 if gap > 0 else 1
    return out


def window(i: int, quota: int, period: int) -> tuple[int, int]:
    """Release slot and deadline of block i of a source with quota / period of the slots."""
    return i * period // quota, -(-(i + 1) * period // quota)


def one_period(share: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block of the period, slot, release, deadline), earliest deadline first.

    Ties go to the block whose window overlaps its successor's, then to the heavier source, then by name.
    """
    period = sum(share.values())
    waiting: list[tuple[int, str, int]] = [(0, k, 0) for k in share]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, str, int]] = []
    plan = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (window(i, share[k], period)[1], -((i + 1) * period % share[k] != 0), -share[k], k, i))
        _, _, _, k, i = heapq.heappop(ready)
        plan.append((k, i, slot, *window(i, share[k], period)))
        if i + 1 < share[k]:
            heapq.heappush(waiting, (window(i + 1, share[k], period)[0], k, i + 1))
    return plan


def _table(spark: SparkSession, rows: list[tuple], longs: list[str]) -> DataFrame:
    """(mix_k, longs) from the driver as Arrow: rows given as a list go through Python workers of their own on the executors."""
    key, *rest = zip(*rows, strict=True)
    return spark.createDataFrame(pa.table([pa.array(key, pa.string()), *(pa.array(c, pa.int64()) for c in rest)], names=["mix_k", *longs]))


def schedule(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with mix_block, mix_slot, mix_release, mix_deadline and mix_rank (place in its block).

    Columns of ``docs`` that bear one of these names are left out.  A null source is a source of its own.
    No row is dropped or repeated: when a source has run out, its slots stay empty and the others go on in their
    proportions.  Documents of a source come in an order that a seeded hash of their ids gives, of their other
    columns where the id is null; equal rows follow each other.  An empty table stays empty.
    """
    s, spark = settings, docs.sparkSession
    source = F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE))
    counts = {r[0]: r[1] for r in docs.groupBy(source.alias("k")).count().limit(s.max_sources + 1).collect()}
    if len(counts) > s.max_sources:
        raise ValueError(f"more than {s.max_sources} sources")
    added = {"mix_block": "long", "mix_slot": "long", "mix_release": "long", "mix_deadline": "long", "mix_rank": "int"}
    own = [f"`{c.replace('`', '``')}`" for c in docs.columns if c.lower() not in added]
    if not counts:
        return docs.select(*own, *(F.lit(None).cast(t).alias(c) for c, t in added.items()))
    weights = {k: max(1e-9, float(s.weights.get(k, s.rest))) if s.weights else n**s.flatten for k, n in counts.items()}
    share = quotas(weights, s.period)
    period = sum(share.values())
    rows = max(s.slice_rows, sum(counts.values()) // s.slices + 1)
    of_source = _table(spark, [(k, -(-n // rows), share[k]) for k, n in counts.items()], ["mix_slices", "mix_quota"])
    plan = _table(spark, one_period(share), ["mix_i", "mix_at", "mix_from", "mix_by"])
    plain = [F.col(f"`{f.name.replace('`', '``')}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    mixed = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(s.seed), *plain)).otherwise(F.xxhash64(F.lit(s.seed), F.col("doc_id")))
    row, id_ = F.struct(*own) if own else F.struct(F.lit(0).alias("mix")), F.col("doc_id")
    dealt = docs.select(row.alias("mix_row"), source.alias("mix_k"), mixed.alias("mix_h"), id_.alias("mix_id")).join(F.broadcast(of_source), "mix_k")
    dealt = dealt.withColumn("mix_slice", F.floor((F.col("mix_h") / F.lit(2.0**64) + 0.5) * F.col("mix_slices")).cast("long"))
    sizes = dealt.groupBy("mix_k", "mix_slice").count()
    before = sizes.select("mix_k", "mix_slice", F.coalesce(F.sum("count").over(Window.partitionBy("mix_k").orderBy("mix_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("mix_before"))
    before = staged(before.coalesce(1), "slices")  # slices + sources rows at most
    placed = dealt.join(F.broadcast(before), ["mix_k", "mix_slice"])
    order = Window.partitionBy("mix_k", "mix_slice").orderBy("mix_h", "mix_id")
    placed = placed.withColumn("mix_n", F.col("mix_before") + F.row_number().over(order) - 1)
    placed = placed.withColumn("mix_block", F.floor(F.col("mix_n") / s.block).cast("long")).withColumn("mix_rank", (F.col("mix_n") % s.block).cast("int"))
    placed = placed.withColumn("mix_i", F.col("mix_block") % F.col("mix_quota")).withColumn("mix_turn", F.floor(F.col("mix_block") / F.col("mix_quota")).cast("long") * period)
    out = placed.join(F.broadcast(plan), ["mix_k", "mix_i"])
    return out.select(*([f"mix_row.{c}" for c in own]), "mix_block", (F.col("mix_turn") + F.col("mix_at")).alias("mix_slot"), (F.col("mix_turn") + F.col("mix_from")).alias("mix_release"), (F.col("mix_turn") + F.col("mix_by")).alias("mix_deadline"), "mix_rank")


def mix(docs: DataFrame, settings: Settings = Settings(), part_rows: int = 8192, most_parts: int = 100_000) -> DataFrame:
    """The documents in mixed order: partition by partition, sorted inside each, with all their own columns.

    Beyond ``part_rows`` x ``most_parts`` documents the partitions grow.
    """
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "source")
    out = schedule(packed, settings)
    top = out.agg(F.max("mix_slot"), F.count("*")).first()
    if not top[1]:
        return docs
    parts = max(1, min(-(-top[1] // part_rows), most_parts))
    at = F.floor(F.col("mix_slot") * F.lit(parts) / F.lit(top[0] + 1)).cast("int")
    return out.repartitionById(parts, at).sortWithinPartitions("mix_slot", "mix_rank").select("row.*")
