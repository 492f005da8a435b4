"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, importance, pages, personal, pfair, rules, simhash, substrings, tokens, warc
from .common import table


#: Target weights of the mixture; a source not named here weighs 1.
WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 2.0, "src3": 2.0, "src4": 1.5, "src5": 0.5}


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), importance.Settings(reject_toxic=True))


def op2_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair.schedule(docs, pfair.Settings(weights=WEIGHTS))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.detect(table(spark, sf_dir, "documents")).drop("found")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.report(table(spark, sf_dir, "documents"), tokens.Settings(tokens.default_tokenizer()))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_importance, op2_pfair, op3_decontaminate, op4_simhash, op5_warc, op6_rules, op7_personal, op8_tokens, op9_substrings, op10_pages)
}

#: 160 bits of a SHA-1 in hex as base32: eight groups of five hex digits give four letters each.
_BASE32 = "list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, 1 + (i // 4) * 5, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), lambda a, b: a || b)"

ORACLE: dict[str, str] = {
    "op5_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
        q AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first_id FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM q""",
}
