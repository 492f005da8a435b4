"""Quality rules: a decision list learned from labelled statistics by sequential covering.

A rule is a conjunction of thresholds.  It grows one condition at a time by information gain on one
part of the labelled rows, is pruned back on the other part, and what it covers is set aside before
the next rule grows.  The list becomes one ordered Spark conditional.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged, texts

#: Fixed by the query's contract.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")
SPACES, SYMBOLS, WINDOW = "\x20\x09\x0a\x0b\x0c\x0d", "#*$%&|<>", 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines", "n_words_seen")

#: What rules may look at, as expressions over the counts.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "marks_per_word": "n_marks / n_words",
    "upper_share": "n_upper / greatest(word_chars, 1L)",
    "digit_share": "n_digits / greatest(word_chars, 1L)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1L)",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_words_seen / n_words",
}


@dataclass(frozen=True)
class Settings:
    """``labelled_rows``: at most so many labelled rows, those of the smallest hashes, are learned from.
    ``cuts``: thresholds tried for a feature.  A rule is kept if its precision on the pruning part is
    ``precision`` at least and it covers ``covers`` rows there."""

    labelled_rows: int = 8_192
    cuts: int = 64
    conditions: int = 4
    rules: int = 16
    precision: float = 0.95
    covers: int = 3


def repeated_words(words: list[str]) -> int:
    """Words inside a window of five that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    local: dict[str, int] = {}
    ids = np.array([local.setdefault(w, len(local)) for w in words], np.int64)
    key, base = ids, len(local)
    if base**WINDOW < 2**62:
        key = sum(ids[i : n + i] * base ** (WINDOW - 1 - i) for i in range(WINDOW))
    else:  # number the windows of two, four and five words
        two = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
        four = np.unique(two[:-2] * (two.max() + 1) + two[2:], return_inverse=True)[1]
        key = four[:n] * base + ids[WINDOW - 1 :]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n, np.int64)
    twice[order[:-1][same]] = 1
    twice[order[1:][same]] = 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    words, lines, seen, dup, held = WORD.findall(text), text.split("\n"), set(), 0, 0
    for line in lines:
        if WORD.search(line):
            held += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words),
        len(UPPER.findall(text)), sum(map(text.count, "0123456789")), sum(map(text.count, "!?.,;:")), held, len(set(words)),
    )


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t) for t in texts(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(STATS)))], ["doc_id", *STATS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text; null has no words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, _stats, "doc_id long, " + ", ".join(f"{c} long" for c in STATS))


Condition = tuple[str, bool, float]  # feature, whether at least, threshold


def _covers(rule: list[Condition], x: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    for name, least, cut in rule:
        out &= x[name] >= cut if least else x[name] <= cut
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, s: Settings) -> list[Condition]:
    rule, at = [], rows.copy()
    while len(rule) < s.conditions and (at & ~bad).any():
        p, n, best = int((at & bad).sum()), int((at & ~bad).sum()), (1e-9, None)
        if not p:
            break
        for name in sorted(x):
            value = np.sort(x[name][at])
            cuts = np.unique(np.quantile(x[name][at & bad], np.linspace(0, 1, s.cuts)))
            for cut in cuts:
                for least in (True, False):
                    # halfway to the next value outside, so that a cut doesn't hang on one row
                    i = np.searchsorted(value, cut, "left" if least else "right")
                    edge = cut if (i == 0 if least else i == len(value)) else (value[i - 1] + cut) / 2 if least else (value[i] + cut) / 2
                    hit = at & (x[name] >= edge if least else x[name] <= edge)
                    p1, n1 = int((hit & bad).sum()), int((hit & ~bad).sum())
                    if p1:
                        gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n)))
                        if gain > best[0]:
                            best = (gain, (name, least, float(edge)))
        if best[1] is None:
            break
        rule.append(best[1])
        at = _covers([best[1]], x, at)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, settings: Settings = Settings()) -> list[list[Condition]]:
    """Ordered rules that call a row bad.  ``prune`` marks the rows that rules are pruned and judged on."""
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < settings.rules and (left & bad & ~prune).any():
        rule = _grow(x, bad, left & ~prune, settings)
        worth = []
        for k in range(1, len(rule) + 1):
            hit = _covers(rule[:k], x, left & prune)
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            worth.append((p - n) / (p + n) if p + n else -1.0)
        if not worth:
            break
        rule = rule[: int(np.argmax(worth)) + 1]
        hit = _covers(rule, x, left & prune)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p + n < settings.covers or p / (p + n) < settings.precision:
            break
        rules.append(rule)
        left &= ~_covers(rule, x, left)
    return rules


def expression(rules: list[list[Condition]]) -> Column:
    """The list as a conditional: the name of the first rule that holds, else null."""
    out = F.when(F.lit(False), F.lit(""))
    for i, rule in enumerate(rules):
        test = F.lit(True)
        for name, least, cut in rule:
            value = F.expr(FEATURES[name])
            test = test & ((value >= F.lit(cut)) if least else (value <= F.lit(cut)))
        out = out.when(test, F.lit(f"rule {i + 1}: " + " and ".join(f"{n} {'>=' if a else '<='} {c:.4g}" for n, a, c in rule)))
    return out


def fit(stats: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> list[list[Condition]]:
    """Rules from a bounded sample of labelled rows; texts without words are left to the base test."""
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(settings.labelled_rows)
    rows = stats.filter("n_words > 0").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    rows = rows.select("doc_id", "quality", *(F.expr(e).alias(n) for n, e in FEATURES.items())).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.labelled_rows).collect()
    if not rows:
        return []
    x = {n: np.array([float(r[n]) for r in rows]) for n in FEATURES}
    return learn(x, np.array([r.quality == 0 for r in rows]), np.arange(len(rows)) % 3 == 0, settings)


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Each document's counts, base_failed, kept and the rule that rejected it.  Rows that repeat get a row each."""
    stats = staged(statistics(docs), "stats")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rule = F.when(F.col("n_words") > 0, expression(fit(stats, labels, settings)))
    out = stats.withColumn("base_failed", base).withColumn("rule", rule)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
