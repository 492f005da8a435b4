"""Quality classifier by importance resampling of hashed n-gram models.

Two bags of hashed features, one of the target texts and one of all raw texts, are generative models; a document's
weight is the logarithm of the ratio of its likelihoods under them, summed over all its features.  Gumbel noise added
to that and a top-k cut draw k documents without replacement in proportion to their weights.  Toxic texts, which such
a ratio doesn't tell, are ruled out before by a lexicon of the words and word beginnings that labelled ones hold.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import kth_largest, map_batches, mix64, ordered_bits, staged, texts

TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE_WORDS = 150_000
USABLE = "n_features > 0 and not toxic_text"


@dataclass(frozen=True)
class Settings:
    """``buckets``: size of the hashed feature space.  ``labelled_rows``: at most so many labelled
    documents (those of the smallest hashes) are used: two thirds form the target model, on the
    rest the cuts are set; the raw model counts every document.  ``prior``: pseudo-count that draws a
    bucket's ratio of target count to the count expected from raw text towards one.
    ``temperature``: divides the log-ratio; more of it lets the noise decide more.
    ``keep``: documents to draw, or ``share`` of those with text; with neither, as many as lie above the cut that
    splits the labelled rest best.
    ``reject_toxic``: toxic labelled rows of any quality are bad, told by a lexicon; without it the cut is on quality alone.
    ``evidence``: log-likelihood statistic (G squared) over labelled documents from which a word, or a beginning of
    ``stems`` letters, speaks for a toxic text, ``toxic_words`` of the strongest at most.
    ``clean_weight``: what the share of good rows lost weighs against the share of bad ones kept when a cut is set."""

    buckets: int = 65_536
    labelled_rows: int = 8_192
    prior: float = 16.0
    temperature: float = 1.0
    keep: int | None = None
    share: float | None = None
    reject_toxic: bool = False
    evidence: float = 8.0
    stems: tuple[int, ...] = (4, 5, 6)
    toxic_words: int = 4_096
    clean_weight: float = 10.0
    seed: int = 20_240_607


class Features:
    """Hashed words and word pairs of a text.  The word cache is bounded."""

    def __init__(self, buckets: int):
        self.buckets, self.seen = np.uint64(buckets), {}

    def __call__(self, text: str) -> np.ndarray:
        return self.of(TOKEN.findall(text))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        seen = self.seen
        try:
            ids = [seen[w] for w in words]
        except KeyError:
            for w in words:
                if w not in seen:
                    seen[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) + 1
            ids = [seen[w] for w in words]
        one = np.array(ids, dtype=np.uint64)
        with np.errstate(over="ignore"):
            two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
        return (mix64(np.concatenate([one, two])) % self.buckets).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    features, total = Features(buckets), np.zeros((2, buckets), np.int64)
    for batch in batches:
        for text, good in zip(texts(batch, "text"), batch.column("good").to_pylist(), strict=True):
            n = np.bincount(features(text), minlength=buckets) if len(text) > 4 * buckets else None
            for model in (0, 1) if good else (0,):
                if n is None:
                    np.add.at(total[model], features(text), 1)
                else:
                    total[model] += n
    for model in (0, 1):
        at = np.flatnonzero(total[model])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), model, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[model][at])], ["model", "bucket", "n"])


def _stems(word: str, stems: tuple[int, ...]) -> list[str]:
    """The word and its beginnings, which are marked."""
    return [word, *("^" + word[:n] for n in stems if len(word) > n)]


def _words(batches: Iterator[pa.RecordBatch], stems: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The distinct words and word beginnings of labelled documents, with what the cut on them needs."""
    for batch in batches:
        found = [set(TOKEN.findall(t)) for t in texts(batch, "text")]
        words = pa.array([sorted({x for w in ws for x in _stems(w, stems)}) for ws in found], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("toxic", "held", "clean", "pick")), pa.array([len(ws) for ws in found], pa.int32()), words], ["toxic", "held", "clean", "pick", "n", "words"])


class Lexicon:
    """Log-odds of what speaks for a toxic text, and the cut on their sum over a text's distinct words."""

    def __init__(self, odds: dict[str, float], stems: tuple[int, ...], cut: float = 0.0):
        self.odds, self.stems, self.cut, self.seen = odds, stems, cut, {}

    def score(self, told, n: int) -> float:
        """Texts of many words hold some of them by chance: the sum is taken against the root of their number."""
        return sum(self.odds[x] for x in sorted(told)) / (n + 10) ** 0.5

    def __call__(self, words: list[str]) -> float:
        if not self.odds:
            return 0.0
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        told, seen, distinct = set(), self.seen, set(words)
        for w in distinct:
            hit = seen.get(w)
            if hit is None:
                hit = seen[w] = tuple(x for x in _stems(w, self.stems) if x in self.odds)
            if hit:
                told.update(hit)
        return self.score(told, len(distinct)) if told else 0.0


def _toxic(labelled: DataFrame, s: Settings) -> Lexicon:
    """Learned on two thirds of the labelled rows, cut on the rest; empty if nothing has the evidence, as when few
    toxic documents are labelled."""
    none = Lexicon({}, s.stems)
    schema = "toxic int, held boolean, clean boolean, pick long, n int, words array<string>"
    rows = staged(map_batches(labelled, _words, schema, s.stems), "toxic")
    n = {r.toxic: r.n for r in rows.filter("not held").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return none
    each = rows.filter("not held").select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    share = F.lit(n[1] / (n[0] + n[1]))
    expected = (F.col("a") + F.col("b")) * share
    both = F.col("a") * F.log(F.col("a") / expected) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / ((F.col("a") + F.col("b")) * (1 - share)))).otherwise(0.0)
    told = each.filter(F.col("a") > expected).select("word", (2 * both).alias("g"), F.log((F.col("a") + 1) / (F.col("b") * F.lit(n[1] / n[0]) + 1)).alias("odds")).filter(F.col("g") >= s.evidence)
    odds = {r.word: r.odds for r in told.orderBy(F.desc("g"), "word").limit(s.toxic_words).collect()}
    if not odds:
        return none
    found = Lexicon(odds, s.stems)
    held = rows.filter(F.col("held") & ((F.col("toxic") == 1) | F.col("clean"))).select("toxic", "pick", "n", F.array_intersect("words", F.array(*map(F.lit, odds))).alias("words"))
    peaks = [(-found.score(r.words, r.n), 1 - r.toxic) for r in held.orderBy("pick", "n").limit(s.labelled_rows).collect()]
    edge = -_threshold(peaks, s.clean_weight)
    return Lexicon(odds, s.stems, max(edge, 1e-9)) if np.isfinite(edge) else none


def _gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    u = ((mix64(ids.astype(np.uint64) ^ mix64(np.array([seed], np.uint64))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def _score_batches(batches: Iterator[pa.RecordBatch], ratio: np.ndarray, toxic: Lexicon, s: Settings) -> Iterator[pa.RecordBatch]:
    """The batch's columns but for the text, and its documents' scores."""
    features = Features(s.buckets)
    for batch in batches:
        got = []
        for text in texts(batch, "text"):
            words = TOKEN.findall(text)
            at = features.of(words)
            got.append((len(at), float(ratio[at].sum()), toxic(words)))
        n, weight, told = (np.array([x[i] for x in got], t) for i, t in enumerate((np.int64, np.float64, np.float64)))
        weight = weight / s.temperature
        ids = np.array([-1 if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
        key = ordered_bits(weight + _gumbel(ids, s.seed))
        bad = (told >= toxic.cut) & (told > 0)
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, (n, weight, told, bad, key))], [*kept, "n_features", "log_weight", "toxic_score", "toxic_text", "draw_key"])


@dataclass(frozen=True)
class Fitted:
    """``ratio``: log-ratio of each bucket.  ``scores``: a row for each document, its whole row in ``row``."""

    ratio: np.ndarray
    toxic: Lexicon
    scores: DataFrame
    cut: int | None
    kept: int
    settings: Settings

    def drawn(self) -> Column:
        return F.expr(USABLE) & (F.col("draw_key") >= F.lit(self.cut)) if self.cut is not None else F.lit(False)


def _threshold(rows: list[tuple[float, int]], good_weight: float = 1.0) -> float:
    """The score that splits labelled good (1) from bad best: highest weighted sum of both recalls."""
    good, bad = np.sort([m for m, q in rows if q == 1]), np.sort([m for m, q in rows if q == 0])
    if not len(good) or not len(bad):
        return -np.inf
    at = np.unique(np.concatenate([good, bad]))
    edges = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2])
    gain = good_weight * (1 - np.searchsorted(good, edges) / len(good)) + np.searchsorted(bad, edges) / len(bad)
    return float(edges[int(np.argmax(gain))])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), carry: bool = False) -> Fitted:
    """Count both models over the corpus, score every document and find the top-k cut.

    Documents without text have no features and are never drawn; null ids draw one noise value; rows that repeat get a
    row each.  Without labelled good and bad rows every document with text is drawn.  With ``carry`` the scores hold
    each whole row, so that nothing is scored twice or shuffled.
    """
    s = settings
    told = F.col("quality").isNotNull() | F.lit(s.reject_toxic) & (F.coalesce("toxic", F.lit(0)) != 0)
    chosen = labels.filter(told & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce((F.col("toxic") != 0).cast("int"), F.lit(0))).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(s.labelled_rows)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct("*").alias("row")] if carry else []))
    read = read.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"), "left")
    rows = read.select("doc_id", "text", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"), *(["row"] if carry else []))
    held_out = F.pmod(F.xxhash64(F.lit(s.seed), "doc_id"), F.lit(3)) == 0
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0) & ~held_out, F.lit(False))
    counted = map_batches(rows.select("text", good.alias("good")), _counts, "model int, bucket int, n long", s.buckets)
    total = np.zeros((2, s.buckets))  # raw, target
    for r in counted.groupBy("model", "bucket").agg(F.sum("n").alias("n")).collect():  # 2 x buckets rows at most
        total[r.model, r.bucket] = r.n
    if total[1].sum():
        expected = total[0] * (total[1].sum() / total[0].sum())
        ratio = np.log((total[1] + s.prior) / (expected + s.prior))
    else:
        ratio = np.zeros(s.buckets)
    toxic = Lexicon({}, s.stems)
    if s.reject_toxic:
        clean = (F.col("quality") == 1) & (F.col("toxic") == 0)
        toxic = _toxic(rows.filter(F.col("toxic").isNotNull()).select("text", "toxic", held_out.alias("held"), F.coalesce(clean, F.lit(False)).alias("clean"), F.xxhash64("doc_id").alias("pick")), s)
    schema = StructType([f for f in rows.schema if f.name != "text"])
    for name, kind in (("n_features", "long"), ("log_weight", "double"), ("toxic_score", "double"), ("toxic_text", "boolean"), ("draw_key", "long")):
        schema = schema.add(name, kind)
    scores = staged(map_batches(rows, _score_batches, schema, ratio, toxic, s), "importance")
    if s.keep is not None or s.share is not None:
        k = s.keep if s.keep is not None else round(s.share * scores.filter(USABLE).count())
    else:
        seen = scores.filter(held_out & F.col("quality").isNotNull() & (F.col("n_features") > 0) & ((F.col("toxic") == 0) | (F.col("quality") == 0))).select("log_weight", "quality", F.xxhash64("doc_id", "log_weight").alias("pick"))
        edge = _threshold([(r[0], r[1]) for r in seen.orderBy("pick", "log_weight").limit(s.labelled_rows).collect()], s.clean_weight)
        k = scores.filter(USABLE).filter(F.col("log_weight") >= F.lit(edge)).count()
    return Fitted(ratio, toxic, scores, kth_largest(scores.filter(USABLE), "draw_key", k), k, s)


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row for each document: its weight, its draw key, whether it is toxic and whether it was drawn (``kept``)."""
    m = fit(docs, labels, settings)
    return m.scores.select("doc_id", "n_features", "log_weight", "toxic_score", "toxic_text", "draw_key", m.drawn().alias("kept"))


def keep_drawn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The drawn documents with all their columns, whatever their names."""
    m = fit(docs, labels, settings, carry=True)
    return m.scores.filter(m.drawn()).select("row.*")
