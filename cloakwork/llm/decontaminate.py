"""Benchmark decontamination with DataFrame functions only.

The windows of the test items form a broadcast hash set.  Each window is filed under its longest
word, so that a scan over the words of the training texts finds the few places where a window can
lie; there the whole window is compared word by word, and only equal ones count.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Fixed by the query's contract.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    """``window``: words of a window.  ``broadcast_windows``: so many windows are broadcast at most
    (they are counted first); a larger set is joined by a shuffle of the words, each window in ``salts`` copies."""

    window: int = 10
    broadcast_windows: int = 1_000_000
    salts: int = 8


def words(text: Column) -> Column:
    """ASCII letters in lower case, split at what is no word; null has none."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.array_remove(F.split(low, NOT_WORD), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(key, off, len, gram, item_ids): each distinct window once, filed under its longest word."""
    n = settings.window
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter((F.size("w") > 0) & F.col("item_id").isNotNull())
    w = w.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - n))))
    w = w.select("item_id", F.slice("w", F.col("at") + 1, n).alias("gram"))
    w = w.groupBy("gram").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    best = F.array_max(F.transform("gram", lambda x, i: F.struct(F.length(x).alias("l"), F.xxhash64(x).alias("h"), i.alias("off"))))
    w = w.withColumn("off", best["off"])
    return w.select(F.element_at("gram", F.col("off") + 1).alias("key"), "off", F.size("gram").alias("len"), "gram", "item_ids")


def scan(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: doc_id, row_key, text_key, n_words, spans (hit windows as start and end words), items.

    Null or empty texts have no words and no hits; rows that repeat or have no id are judged each on its own; an
    item without words or id is skipped; without items nothing is hit.  The windows are broadcast if their count is
    within the bound.  Else the documents' words are shuffled to them: the few places found come back by row, and
    each window stands in ``salts`` parts so that a frequent word is no single task's.  Both ways give the same rows.
    """
    grams = staged(item_windows(items, settings), "windows")
    small = grams.count() <= settings.broadcast_windows
    read = docs.select(F.col("doc_id"), F.monotonically_increasing_id().alias("row_key"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), words(F.col("text").cast("string")).alias("w"))
    row = ["doc_id", "row_key", "text_key"]
    start, n = F.col("at") - F.col("off"), F.size("w")
    fits = (start >= 0) & (start + F.col("len") <= n)
    first = F.get("w", F.greatest(start, F.lit(0))) == F.get("gram", F.lit(0))
    same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.greatest(F.col("len"), F.lit(1))) == F.col("gram")
    whole = F.when(~fits, False).when(~first, False).otherwise(same)
    spans = F.sort_array(F.collect_set(F.when(F.col("len") > 0, F.struct(start.cast("int").alias("start"), (start + F.col("len")).cast("int").alias("end"))))).alias("spans")
    found = F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items")
    if small:  # an end mark in every text meets a mark in the set, so that texts without hits stay
        none = F.array().cast("array<string>")
        mark = grams.sparkSession.range(1).select(F.lit("").alias("key"), F.lit(-1).alias("off"), F.lit(0).alias("len"), none.alias("gram"), none.alias("item_ids"))
        spread = read.select(*row, "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("at", "key"))
        hit = spread.join(F.broadcast(grams.unionByName(mark)), "key").filter(F.when(F.col("len") == 0, True).otherwise(whole))
        return hit.groupBy(*row).agg(F.max(n).cast("long").alias("n_words"), spans, found)
    read, salts = staged(read, "words"), F.lit(settings.salts)
    places = read.select("row_key", F.posexplode("w").alias("at", "key")).withColumn("salt", F.pmod(F.xxhash64("row_key", "at"), salts).cast("int"))
    near = places.join(grams.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), ["key", "salt"]).drop("key", "salt")
    hits = near.join(read.select("row_key", "w"), "row_key").filter(whole).groupBy("row_key").agg(spans, found)
    empty = lambda c: F.coalesce(c, F.expr(f"filter(array(cast(null as {dict(hits.dtypes)[c][6:-1]})), x -> false)"))
    return read.join(hits, "row_key", "left").select(*row, n.cast("long").alias("n_words"), empty("spans").alias("spans"), empty("items").alias("items"))


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["upto"], x["start"]))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto"))
    return F.aggregate(spans, zero, step)["n"]


def report(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The contract's digest of every document."""
    found = scan(docs, items, settings)
    n_hit = covered(F.col("spans")).cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Documents without any hit, all columns kept, whatever their names.

    A verdict hangs on the text alone, so rows are told apart by id (null ones included) and text: a clean row that
    shares an id with a hit one stays.  An empty table stays empty.
    """
    bad = scan(docs, items, settings).filter(F.size("spans") > 0).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_key"))
    return own.join(bad, F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_key") == F.col("bad_key")), "left_anti").select("row.*")


def cut_spans(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row's doc_id and ``cleaned``: the text with the hit words taken out, the kept words joined by spaces; unhit texts as they are."""
    found = scan(docs, items, settings).filter(F.size("spans") > 0).groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(F.first("spans").alias("spans"))
    text = F.col("text").cast("string")
    every = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("own_key"))
    every = every.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("own_key") == F.col("hit_key")), "left")
    gone = F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["end"] - 1)))
    kept = F.filter(words(F.col("text")), lambda x, i: ~F.array_contains(F.col("gone"), i))
    return every.withColumn("gone", F.array_distinct(gone)).select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(kept, " ")).alias("cleaned"))
