"""Removal of repeated passages, found with a compressed FM-index per shard.

Equal windows must meet in one shard without every shard being searched for every document.  So a
window is sent by its minimizer, the smallest hash of the word groups inside it: consecutive windows
whose minimizer stands at one place form a segment.  A minimizer seen once can't belong to a repeated window.  Of the
others, equal segments are folded into one with a count; the distinct ones are indexed per shard with their counts,
and all windows of all of them are streamed through the index, backwards: what it counts twice or more is repeated.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix64, scratch_path, staged, texts
from .fmindex import Index
from .wavelet import get, put


@dataclass(frozen=True)
class Settings:
    """``window``: words that must repeat.  ``gram``: words of a minimizer.  ``segment``: windows of a segment
    at most.  ``shard_words``: words of an index, about.  ``hot``: a minimizer with more distinct segments
    is split into single windows, which are folded and dealt out by their own hashes.  ``small``: fewer words are one
    shard, more are twelve at least.  ``most_shards``: beyond them shards grow; results are the same at every size."""

    window: int = 35
    gram: int = 6
    segment: int = 256
    shard_words: int = 500_000
    hot: int = 2_048
    small: int = 50_000
    most_shards: int = 200_000


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


#: Odd multipliers, each with its inverse modulo 2^64.
FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
INVERSE = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PIECE_BYTES, STREAMED = 1 << 20, 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words in a buffer: where each starts, and two hashes of its bytes.  Long buffers go in pieces cut at white space."""
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE_BYTES)
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        space = SPACE[data[at:end]]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(first):
            letters, length = data[at:end][~space].astype(np.uint64) + np.uint64(1), last - first
            off = np.cumsum(length) - length
            pos = np.arange(len(letters)) - np.repeat(off, length)
            found.append((first + at, *(np.add.reduceat(letters * _powers(f, int(length.max()))[pos], off) for f in FACTORS[:2])))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts of an Arrow column in groups of about PIECE_BYTES: first row, bytes with a space after each text, text ends."""
    rows, size, first = [], 0, 0
    for i, x in enumerate(column.cast(pa.binary()).to_pylist()):
        rows.append(x or b"")
        size += len(rows[-1]) + 1
        if size >= PIECE_BYTES:
            yield first, np.frombuffer(b" ".join(rows) + b" ", np.uint8), np.cumsum([len(r) + 1 for r in rows])
            rows, size, first = [], 0, i + 1
    if rows:
        yield first, np.frombuffer(b" ".join(rows) + b" ", np.uint8), np.cumsum([len(r) + 1 for r in rows])


def segments(data: np.ndarray, ends: np.ndarray, s: Settings, contents: bool) -> tuple[np.ndarray, ...]:
    """Segments of a group of texts: minimizer, hash of the words, text, first window, windows.

    Equal words have equal hashes, so equal windows have equal minimizers; a clash only sends more to one place.
    Segments count as equal by both 64-bit hashes, which come from two hashes of the words.
    """
    first, one, two = hashes(data)
    n = len(first) - s.window + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 5
    doc = np.searchsorted(ends, first, "right")
    base = np.searchsorted(doc, np.arange(len(ends)))
    with np.errstate(over="ignore"):
        word, grams = mix64(one), np.zeros(len(first) - s.gram + 1, np.uint64)
        for i in range(s.gram):
            grams = grams * FACTORS[0] + word[i : len(grams) + i]
        low, have, want = mix64(grams), 1, s.window - s.gram + 1
        place = np.arange(len(low))
        while have < want:  # minima of doubling ranges, the leftmost among equals
            step = min(have, want - have)
            right = low[step:] < low[: len(low) - step]
            low, place = np.where(right, low[step:], low[: len(low) - step]), np.where(right, place[step:], place[: len(place) - step])
            have += step
        inside = np.flatnonzero(doc[:n] == doc[s.window - 1 :])
        if not len(inside):
            return (np.zeros(0, np.int64),) * 5
        new = np.flatnonzero(np.concatenate([[True], (np.diff(place[inside]) != 0) | (np.diff(doc[inside]) != 0)]))
        run = np.arange(len(inside)) - np.repeat(new, np.diff(np.append(new, len(inside))))
        new = np.flatnonzero(run % s.segment == 0)
        start, count = inside[new], np.diff(np.append(new, len(inside)))
        same = np.zeros(0, np.int64)
        if contents:
            upto = np.concatenate([[np.uint64(0)], np.cumsum(mix64(two) * _powers(FACTORS[2], len(two)), dtype=np.uint64)])
            same = mix64((upto[start + count + s.window - 1] - upto[start]) * _powers(INVERSE, len(two))[start] + count.astype(np.uint64)).view(np.int64)
    return low[start].view(np.int64), same, doc[start], start - base[doc[start]], count


def _minimizers(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, ends in _groups(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(segments(data, ends, s, False)[0])], ["mh"])


def _occurrences(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, ends in _groups(batch.column("text")):
            mh, sh, doc, at, n = segments(data, ends, s, True)
            of = pa.array(doc + row)
            yield pa.RecordBatch.from_arrays([pa.array(mh), pa.array(sh), batch.column("doc_id").take(of), batch.column("th").take(of), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["mh", "sh", "doc_id", "th", "at", "n"])


def _contents(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Words of the chosen segments; those of a hot minimizer come as single windows with hashes of their own."""
    names = ["mh", "sh", "sub", "w", "times", "words"]
    for batch in batches:
        rows = []
        for wanted, text in zip(batch.column("wanted").to_pylist(), texts(batch, "text"), strict=True):
            words = split(text)
            for x in wanted:
                size = s.window - 1 + x["n"]
                if x["hot"]:
                    for w in range(x["n"]):
                        line = b" ".join(words[x["at"] + w : x["at"] + w + s.window])
                        rows.append((x["mh"], x["sh"], int(np.uint64(xxhash.xxh64_intdigest(line)).view(np.int64)), w, x["times"], line))
                else:
                    rows.append((x["mh"], x["sh"], None, 0, x["times"], b" ".join(words[x["at"] : x["at"] + size])))
            if len(rows) > 20_000:
                yield _batch(rows, names)
                rows = []
        if rows:
            yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"w": pa.int32(), "words": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.int64())) for c, k in zip(zip(*rows), names, strict=True)], names)


def _solve(rows: pa.RecordBatch, folder: str, s: Settings) -> Iterator[pa.RecordBatch]:
    """Index a shard's segments in a file and stream their windows through it: (mh, key, runs of repeated windows) of
    those that have some.  A segment that stands for several is held once with its count."""
    words = pc.split_pattern(rows.column("words"), b" ")
    edges, flat = words.offsets.to_numpy().astype(np.int64), words.flatten().dictionary_encode()
    edges = edges - edges[0]
    size, n = np.diff(edges), len(rows)
    first = edges[:-1] + np.arange(n) + 1  # a zero stands before each segment and at the end
    symbols, times = np.zeros(len(flat) + n + 1, np.int64), np.ones(len(flat) + n + 1, np.int64)
    inside = np.arange(len(flat)) + np.repeat(np.arange(n) + 1, size)
    symbols[inside] = flat.indices.to_numpy().astype(np.int64) + 1
    times[inside] = np.repeat(rows.column("times").to_numpy(), size)
    path = f"{folder}/{uuid.uuid4().hex}.cwfm"
    put(path, Index.build(symbols, times, 1 << s.window.bit_length()).save(flat.dictionary))
    index, _ = Index.load(get(path))
    count = size - s.window + 1
    for lo in range(0, n, STREAMED):
        part = slice(lo, lo + STREAMED)
        yield _runs(rows.slice(lo, STREAMED), index.repeated(symbols, first[part], count[part], s.window), count[part])


def _runs(rows: pa.RecordBatch, again: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Marked windows of segments as ranges."""
    base = np.cumsum(count) - count
    head = np.zeros(len(again), bool)
    head[base] = True
    tail = np.append(head[1:], True)
    lo = np.flatnonzero(again & (head | ~np.concatenate([[False], again[:-1]])))
    hi = np.flatnonzero(again & (tail | ~np.append(again[1:], False))) + 1
    of = np.searchsorted(base, lo, "right") - 1
    some, per = np.unique(of, return_counts=True)
    pair = pa.StructArray.from_arrays([pa.array((lo - base[of]).astype(np.int32)), pa.array((hi - base[of]).astype(np.int32))], ["lo", "hi"])
    runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pair)
    at = pa.array(some)
    return pa.RecordBatch.from_arrays([rows.column("mh").take(at), rows.column("key").take(at), runs], ["mh", "key", "runs"])


def _search(batches: Iterator[pa.RecordBatch], folder: str, s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; one shard is held at a time."""
    held, last = [], None
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else [0]
        for i, j in zip(cut, cut[1:]):
            if held and shard[i] != last:
                yield from _solve(pa.concat_batches(held), folder, s)
                held = []
            last = shard[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield from _solve(pa.concat_batches(held), folder, s)


def _remove(batches: Iterator[pa.RecordBatch], s: Settings, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, runs, text in zip(batch.column("doc_id").to_pylist(), batch.column("runs").to_pylist(), texts(batch, "text"), strict=True):
            words, gone = split(text), 0
            n = len(words)
            if runs:
                keep = np.ones(n, bool)
                for r in runs:
                    keep[r["lo"] : r["hi"] + s.window - 1] = False
                gone = n - int(keep.sum())
                words = [words[i] for i in np.flatnonzero(keep)]
            line = b" ".join(words)
            out.append((doc_id, n, gone, hashlib.sha256(line).hexdigest() if digest else line.decode("utf-8", "surrogatepass")))
        cols = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, th, runs): starts of repeated windows of each text that has some, as ranges [lo, hi).

    A text is known by its id and a hash, so rows that repeat an id are told apart by their texts.
    """
    s = settings
    rows = _keyed(docs)
    seen = map_batches(rows.select("text"), _minimizers, "mh long", s)
    twice = staged(seen.groupBy("mh").count().filter("count > 1").select("mh"), "minimizers")
    spots = map_batches(rows, _occurrences, "mh long, sh long, doc_id long, th long, at int, n int", s)
    spots = staged(spots.join(twice, "mh", "left_semi"), "segments")
    kinds = spots.groupBy("mh", "sh").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "th", "at", "n")).alias("x"))
    kinds = staged(kinds.select("mh", "sh", "times", "x.*"), "kinds")
    crowded = staged(kinds.groupBy("mh").count().filter(F.col("count") > s.hot).select(F.col("mh").alias("hot_mh")), "crowded")  # joined by its size: broadcast while small
    wanted = kinds.join(crowded, F.col("mh") == F.col("hot_mh"), "left").select("mh", "sh", "times", F.col("doc_id").alias("of"), F.col("th").alias("of_th"), "at", "n", F.col("hot_mh").isNotNull().alias("hot"))
    wanted = wanted.groupBy("of", "of_th").agg(F.collect_list(F.struct("mh", "sh", "times", "at", "n", "hot")).alias("wanted"))
    texts_of = rows.dropDuplicates(["doc_id", "th"]) if _has_copies(rows) else rows
    words = texts_of.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th"))).select("text", "wanted")
    words = staged(map_batches(words, _contents, "mh long, sh long, sub long, w int, times long, words binary", s), "contents")
    whole = words.filter("sub is null").select("mh", F.col("sh").alias("key"), "times", "words", F.lit(0).cast("long").alias("route"))
    single = words.filter("sub is not null").groupBy("mh", F.col("sub").alias("key")).agg(F.sum("times").alias("times"), F.min("words").alias("words")).withColumn("route", F.col("key"))
    folder = scratch_path(docs.sparkSession, "indexes")
    total = kinds.agg(F.sum(F.col("n") + s.window)).first()[0] or 0
    shards = int(min(s.most_shards, max(1, -(-total // s.shard_words), *(() if total < s.small else (12,)))))
    dealt = whole.union(single).withColumn("shard", F.pmod(F.xxhash64("mh", "route"), F.lit(shards)).cast("int"))
    found = staged(map_batches(dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard"), _search, "mh long, key long, runs array<struct<lo: int, hi: int>>", folder, s), "runs")
    hot = words.filter("sub is not null").select("mh", "sh", "w", F.col("sub").alias("key")).join(found, ["mh", "key"]).groupBy("mh", "sh").agg(F.collect_list(F.struct(F.col("w").alias("lo"), (F.col("w") + 1).alias("hi"))).alias("runs"))
    plain = found.select("mh", F.col("key").alias("sh"), "runs").join(crowded, F.col("mh") == F.col("hot_mh"), "left_anti")
    marked = spots.join(plain.union(hot), ["mh", "sh"])
    moved = F.transform("runs", lambda r: F.struct((r["lo"] + F.col("at")).alias("lo"), (r["hi"] + F.col("at")).alias("hi")))
    return staged(marked.select("doc_id", "th", moved.alias("runs")).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("runs")).alias("runs")), "repeats")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _has_copies(rows: DataFrame) -> bool:
    return bool(rows.groupBy("doc_id", "th").count().filter("count > 1").head(1))


def _cleaned(docs: DataFrame, s: Settings, digest: bool) -> DataFrame:
    found = repeats(docs, s).select(F.col("doc_id").alias("of"), F.col("th").alias("of_th"), "runs")
    rows = _keyed(docs)
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")), "left").select("doc_id", "text", "runs")
    return map_batches(rows, _remove, "doc_id long, n_words long, n_removed long, kept string", s, digest)


def report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; null texts have no words."""
    return _cleaned(docs, settings, True).withColumnRenamed("kept", "kept_sha256")


def cleaned(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words as text."""
    return _cleaned(docs, settings, False).withColumnRenamed("kept", "text")
