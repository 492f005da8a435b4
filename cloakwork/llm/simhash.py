"""Near-duplicates by 64-bit SimHash and a binary trie self-join.

Equal fingerprints are folded first.  If two fingerprints differ in at most b of 64 bits cut into
m blocks, m - b blocks at least are equal; so for each choice of m - b blocks the fingerprints are
grouped by those bits, which become the first levels of a trie.  Below them node pairs are walked
together, level by level; a pair is given up once its differing bits exceed the budget.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, map_batches, staged, texts

BITS, HASH_SEED = 64, 42
LEAF_PAIRS, PAIRS_AT_ONCE, ROWS_AT_ONCE = 4096, 2_000_000, 150_000


@dataclass(frozen=True)
class Settings:
    """``shingle``: words of a shingle.  ``budget``: differing bits of a link at most.  ``group``: wanted
    size of a trie's root group, which sets the number of blocks.  ``hot``: larger groups are split into pairs
    of parts; a fingerprint is then copied once for each part, so work grows with the square of such a group's
    distinct fingerprints, as comparing them does.  ``spread``: parts in which a class's members learn its least id."""

    shingle: int = 4
    budget: int = 4
    group: int = 4096
    hot: int = 16_384
    spread: int = 16


def fingerprint(text: str, shingle: int) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    line = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(line, HASH_SEED)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[: n - 1]]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        h = np.array([digest(line[a : b - 1], HASH_SEED) for a, b in zip(starts[at : at + 65_536], ends[at + shingle - 1 : min(n, at + 65_536) + shingle - 1])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _prints(batches: Iterator[pa.RecordBatch], shingle: int, kept: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[str, int] = {}
        out = [seen[t] if t in seen else seen.setdefault(t, fingerprint(t, shingle)) for t in texts(batch, "text")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.array(out, np.uint64).view(np.int64))], [*kept, "fp"])


def _row_key() -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def fingerprints(docs: DataFrame, settings: Settings = Settings(), keyed: bool = False) -> DataFrame:
    """(doc_id, fp as a signed long), with ``keyed`` row_key too.  Null or empty texts have fingerprint zero."""
    kept = ["doc_id", "row_key"] if keyed else ["doc_id"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *([_row_key().alias("row_key")] if keyed else []), F.col("text").cast("string").alias("text"))
    return map_batches(rows, _prints, "".join(f"{c} long, " for c in kept) + "fp long", settings.shingle, kept)


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of linked rows; a label is the smallest row of its class."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _near(codes: np.ndarray, pairs: tuple[np.ndarray, ...], budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows of pairs of small nodes, compared bit by bit."""
    alo, ahi, blo, bhi = pairs
    sizes = (ahi - alo) * (bhi - blo)
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS_AT_ONCE, prepend=0)) if len(sizes) else []
    for part in np.split(np.arange(len(sizes)), cut):
        if not len(part):
            continue
        n, width = sizes[part], (bhi - blo)[part]
        at = np.repeat(np.arange(len(part)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = alo[part][at] + k // width[at], blo[part][at] + k % width[at]
        ok = i < j
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(codes[i] ^ codes[j]) <= budget
        yield i[ok], j[ok]


def trie_links(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the budget, inside root nodes [lo, hi) of sorted codes that share ``depth`` bits."""
    wide = np.flatnonzero(hi - lo > 1)
    stack = [(depth, lo[wide], hi[wide], lo[wide], hi[wide], np.zeros(len(wide), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > 500_000:  # walk a broad level in parts
            half = len(alo) // 2
            stack += [(depth, *(x[:half] for x in (alo, ahi, blo, bhi, err))), (depth, *(x[half:] for x in (alo, ahi, blo, bhi, err)))]
            continue
        small = ((ahi - alo) * (bhi - blo) <= LEAF_PAIRS) | (depth == BITS)
        yield from _near(codes, (alo[small], ahi[small], blo[small], bhi[small]), budget)
        alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        ones = np.concatenate([[0], np.cumsum((codes >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)])
        amid, bmid, self = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo]), alo == blo
        child = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1), tuple(x[~self] for x in (amid, ahi, blo, bmid, err + 1))]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*child))
        ok = (ahi > alo) & (bhi > blo) & (err <= budget) & ~((alo == blo) & (ahi - alo < 2))
        stack.append((depth + 1, *(x[ok] for x in (alo, ahi, blo, bhi, err))))


def _links(batches: Iterator[pa.RecordBatch], prefix: int, budget: int) -> Iterator[pa.RecordBatch]:
    """Star edges (fp, smaller row's fp) of the linked classes; rows come sorted by group."""

    def solve(group: np.ndarray, code: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((code, group))
        group, code, fp = group[order], code[order], fp[order]
        edge = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(group) else np.zeros(0, np.int64)
        label = np.arange(len(code))
        for i, j in trie_links(code, edge[:-1], edge[1:], prefix, budget):
            _unite(label, i, j)
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[label[at]])], ["u", "v"])

    held: list[tuple] = []
    last, number, rows = None, 0, 0
    for batch in batches:
        k, v, task = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "v", "task"))
        code, fp = batch.column("code").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("fp").to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        new = np.concatenate([[last is not None and last != (k[0], v[0], task[0])], (np.diff(k) != 0) | (np.diff(v) != 0) | (np.diff(task) != 0)])
        group = number + np.cumsum(new)
        number, last = int(group[-1]), (k[-1], v[-1], task[-1])
        held.append((group, code, fp))
        rows += len(k)
        if rows >= ROWS_AT_ONCE:
            full = [np.concatenate(x) for x in zip(*held)]
            done = full[0] < number
            yield solve(*(x[done] for x in full))
            held, rows = [tuple(x[~done].copy() for x in full)], int((~done).sum())
    if held:
        yield solve(*(np.concatenate(x) for x in zip(*held)))


def _choices(blocks: int, budget: int) -> tuple[int, list[list[tuple[int, int]]]]:
    """Bits that the equal blocks surely have, and for each choice of them all blocks (shift, width), chosen ones first."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    cut = [(BITS - b, b - a) for a, b in itertools.pairwise(edges)]
    out = []
    for chosen in itertools.combinations(range(blocks), blocks - budget):
        out.append([cut[i] for i in chosen] + [cut[i] for i in range(blocks) if i not in chosen])
    return min(sum(w for _, w in c[: blocks - budget]) for c in out), out


def _arranged(fp: Column, parts: list[tuple[int, int]]) -> Column:
    out, left = None, BITS
    for shift, width in parts:
        left -= width
        bits = F.shiftleft(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")), left)
        out = bits if out is None else out.bitwiseOR(bits)
    return out


def links(prints: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect exactly what the budget links."""
    s = settings
    n, blocks = prints.count(), s.budget + 1
    while n / 2 ** _choices(blocks, s.budget)[0] > s.group and blocks < s.budget + 4:
        blocks += 1
    prefix, choices = _choices(blocks, s.budget)
    keyed = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _arranged(F.col("fp"), c).alias("code")) for k, c in enumerate(choices)))).alias("x"))
    keyed = keyed.select("fp", "x.k", "x.code", F.shiftrightunsigned("x.code", BITS - prefix).alias("v"))
    hot = keyed.groupBy("k", "v").count().filter(F.col("count") > s.hot).select("k", "v", F.ceil(F.col("count") / (s.hot / 2)).cast("int").alias("parts"))
    keyed = keyed.join(hot, ["k", "v"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tasks = F.transform(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), own), lambda x: F.least(x, own) * F.col("parts") + F.greatest(x, own))
    keyed = keyed.withColumn("task", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(tasks)))
    dealt = keyed.select("k", "v", "task", "code", "fp").repartition("k", "v", "task").sortWithinPartitions("k", "v", "task")
    return map_batches(dealt, _links, "u long, v long", prefix, s.budget)


def components(edges: DataFrame) -> DataFrame:
    """(u, root): each node's smallest node reachable, for nodes that aren't roots.  Alternating large and small stars.

    Goes on until nothing changes; the rounds grow with the logarithm of the longest chain.
    """
    cur = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while (now := cur.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != state:
        state = now
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = staged(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(cur)
        cur = nxt
    return cur.select("u", F.col("v").alias("root"))


def _heads(prints: DataFrame, column: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Least ``column`` of each class: (fp, column) of fingerprints linked to others, and of those on their own.

    A crowded class is split: its members meet the class's least value in ``spread`` parts.
    """
    root = staged(components(links(prints.select("fp"), settings)), "roots")
    every = root.select(F.col("u").alias("fp"), "root").union(root.select(F.col("root").alias("fp"), "root").distinct())
    linked = prints.join(every, "fp").select("fp", column, "root", F.pmod(F.xxhash64("fp"), F.lit(settings.spread)).cast("int").alias("part"))
    least = linked.groupBy("root").agg(F.min(column).alias("least"))
    least = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(settings.spread - 1))))
    return linked.join(least, ["root", "part"]).select("fp", F.col("least").alias(column), "root"), prints.join(every, "fp", "left_anti").select("fp", column, F.col("fp").alias("root"))


def classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links lead to, its own included.

    Empty and null texts share fingerprint zero and link like others.  Rows that repeat an id get a row each; rows
    without id link like others, and a class of such rows only has no component_id.
    """
    rows = staged(fingerprints(docs, settings), "prints")
    prints = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("component_id")), "classes")
    linked, alone = _heads(prints, "component_id", settings)
    return rows.join(linked.union(alone).drop("root"), "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    found = classes(docs, settings)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document of each group, that of the smallest id, with all its columns, whatever their names.

    Rows are told apart by id and text, so an id may stand on several texts.  A null id comes after all
    others and is kept if its group has no other; of equal rows one is kept.  An empty table stays empty.
    """
    rows = staged(fingerprints(docs, settings, keyed=True), "prints")
    alike = rows.groupBy("fp", "doc_id", "row_key").agg(F.count("*").alias("times"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "times")
    prints = staged(alike.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    linked, alone = _heads(prints, "first", settings)
    heads = alone.select("first").union(linked.filter("fp = root").select("first"))
    keep = heads.select(F.col("first.doc_id").alias("keep_id"), F.col("first.row_key").alias("keep_key"), F.col("first.times").alias("times"))
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), _row_key().alias("own_key"))
    out = own.join(keep, F.col("own_id").eqNullSafe(F.col("keep_id")) & (F.col("own_key") == F.col("keep_key")))
    return out.filter("times = 1").select("row.*").union(out.filter("times > 1").dropDuplicates(["own_id", "own_key"]).select("row.*"))
