"""Scoring of detectors against marked texts: templates, one-to-one matching, recall and precision by category."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = re.compile(r"\{\{([A-Z_]+)\|(.*?)\}\}")


def parse(template: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text of a template and its marked spans (type, start, end in bytes)."""
    text, spans, at = "", [], 0
    for m in MARK.finditer(template):
        text += template[at : m.start()]
        start = len(text.encode())
        text += m[2]
        spans.append((m[1], start, len(text.encode())))
        at = m.end()
    return text + template[at:], spans


def corpus(spark: SparkSession, samples: list[tuple[str, str, str]]) -> DataFrame:
    """(doc_id, name, category, text, gold) from (name, category, template).  A name twice or an empty mark is refused."""
    names = [n for n, _, _ in samples]
    if len(set(names)) < len(names):
        raise ValueError("a sample's name twice")
    rows = []
    for i, (name, category, template) in enumerate(samples):
        text, gold = parse(template)
        if "{{" in text or any(a == b for _, a, b in gold):
            raise ValueError(f"{name}: a mark that isn't one")
        rows.append((i, name, category, text, [dict(type=t, start=a, end=b) for t, a, b in gold]))
    return spark.createDataFrame(rows, "doc_id long, name string, category string, text string, gold array<struct<type: string, start: int, `end`: int>>")


#: The three rounds of matching: what counts as the same, and what a match counts as.
ROUNDS = (("exact", "g.start = p.start and g.`end` = p.`end` and g.type = p.type"), ("type_mismatch", "g.start = p.start and g.`end` = p.`end`"), ("partial", "p.start < g.`end` and g.start < p.`end`"))


def matches(samples: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, category and, per text, tp, fp, fn, partial and type_mismatch.

    Each found span in order takes the first gold span still free: exact ones first, then those of another type, then
    those that overlap.  What is left over is spurious or missed.
    """
    told = found.groupBy(F.col("doc_id").alias("of")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "type"))).alias("p"))
    none = F.array().cast("array<struct<start:int,end:int,type:string>>")
    rows = samples.join(told, F.col("doc_id") == F.col("of"), "left").select("doc_id", "category", F.col("gold").alias("g"), F.coalesce(F.col("p").cast("array<struct<start:int,end:int,type:string>>"), none).alias("p"))
    rows = rows.withColumn("free", F.expr("filter(sequence(0, greatest(size(g) - 1, 0)), i -> i < size(g))")).withColumn("open", F.expr("filter(sequence(0, greatest(size(p) - 1, 0)), i -> i < size(p))"))
    for name, same in ROUNDS:
        test = same.replace("g.", "get(g, j).").replace("p.", "get(p, i).")
        fold = f"aggregate(open, struct(free as free, cast(array() as array<int>) as done), (a, i) -> case when exists(a.free, j -> {test}) then struct(array_remove(a.free, element_at(filter(a.free, j -> {test}), 1)) as free, concat(a.done, array(i)) as done) else a end)"
        rows = rows.withColumn("a", F.expr(fold)).withColumn("free", F.col("a.free")).withColumn("open", F.array_except("open", "a.done")).withColumn(name, F.size("a.done"))
    return rows.select("doc_id", "category", F.col("exact").alias("tp"), F.size("open").alias("fp"), F.size("free").alias("fn"), "partial", "type_mismatch")


def scores(matched: DataFrame) -> DataFrame:
    """Counts, recall, precision and f1 of each category and, under a null category, of all."""
    counts = ("tp", "fp", "fn", "partial", "type_mismatch")
    total = matched.rollup("category").agg(*(F.sum(c).cast("long").alias(c) for c in counts))
    ratio = lambda miss: F.when(F.col("tp") + F.col(miss) + F.col("partial") + F.col("type_mismatch") == 0, F.lit(1.0)).otherwise(F.col("tp") / (F.col("tp") + F.col(miss) + F.col("partial") + F.col("type_mismatch")))
    out = total.withColumn("recall", ratio("fn")).withColumn("precision", ratio("fp"))
    f1 = F.when(F.col("recall") + F.col("precision") == 0, 0.0).otherwise(2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision")))
    return out.withColumn("f1", f1)
