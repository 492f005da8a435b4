"""What the query catalogue is made of: registration, tables, and texts that hold identifiers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import checks
from ..functions.dialect import DUCK, SPARK
from ..functions.keys import tenant_key
from ..operators import recognizers as R

#: A fixed key, so that keyed results can be compared; real keys come from the caller.
KEY = tenant_key(bytes(range(32)), b"salt", "acme")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _num(x: str, width: int) -> str:
    return f"lpad(cast({x} as varchar(30)), {width}, '0')"


K = "cast(o_orderkey as bigint)"
#: Texts that hold identifiers, right and wrong ones, made of order keys in either dialect.
SYNTH = f"""
    SELECT 1000000000 + {K} AS doc_id, cast(o_custkey as bigint) AS session, CASE cast({K} % 17 as int)
      WHEN 0 THEN 'mail user' || {_num(f'{K} % 50', 2)} || '.x@mail.example.com, 电话 138' || {_num(f'{K} * 37 % 100000000', 8)} || ' ok'
      WHEN 1 THEN 'card 4' || {_num(f'{K} * 7919 % 1000000', 14)} || cast({K} % 10 as varchar(2)) || '; IP 1.2.3.4'
      WHEN 2 THEN '银行卡 4111 1111 1111 ' || {_num(f'{K} % 10000', 4)} || ' é'
      WHEN 3 THEN '身份证 11010519' || {_num(f'{K} % 100', 2)} || {_num(f'{K} % 13', 2)} || {_num(f'{K} % 33', 2)} || {_num(f'{K} % 1000', 3)} || substr('0123456789X', cast({K} % 11 as int) + 1, 1)
      WHEN 4 THEN 'iban DE' || {_num(f'{K} % 100', 2)} || {_num(f'{K} * 7919 % 1000000', 18)} || '.'
      WHEN 5 THEN 'call +49 ' || {_num(f'{K} * 31', 9)} || ' or 010-' || {_num(K, 8)}
      WHEN 6 THEN 'server 10.' || cast({K} % 300 as varchar(5)) || '.0.' || cast({K} % 256 as varchar(5)) || ' runs it'
      WHEN 7 THEN 'sk-' || {_num(K, 20)} || ' AKIA' || {_num(K, 16)} || ' ghp_' || {_num(K, 22)}
      WHEN 8 THEN 'eyJ' || {_num(K, 12)} || '.' || {_num(K, 12)} || '.' || {_num(K, 12)} || ' 😀 x@y.com'
      WHEN 9 THEN 'code 91350100M' || {_num(f'{K} * 13 % 100000000', 8)} || substr('{checks.USCC_ALPHABET}', cast({K} % 31 as int) + 1, 1)
      WHEN 10 THEN '护照 E' || {_num(K, 8)} || ' 车 京A' || {_num(f'{K} % 100000', 5)}
      WHEN 11 THEN 'steuer ' || {_num(f'12345678000 + {K} * 7919 % 1000000', 11)} || ' 税号'
      WHEN 12 THEN 'vat DE' || {_num(K, 9)} || ' partita iva ' || {_num(f'{K} * 7919', 11)}
      WHEN 13 THEN 'dni ' || {_num(f'{K} * 31 % 100000000', 8)} || substr('{checks.DNI_LETTERS}', cast({K} * 31 % 23 as int) + 1, 1) || ' 😀 é X' || {_num(f'{K} % 10000000', 7)} || 'Q'
      WHEN 14 THEN 'cf RSSMRA' || {_num(f'{K} % 100', 2)} || 'A' || {_num(f'{K} % 31', 2)} || 'H' || {_num(f'{K} % 1000', 3)} || substr('{checks.LETTERS}', cast({K} % 26 as int) + 1, 1)
      WHEN 15 THEN 'ssn ' || {_num(f'{K} % 1000', 3)} || '-' || {_num(f'{K} % 100', 2)} || '-' || {_num(f'{K} % 10000', 4)}
      ELSE '1990-02-03 and 4111111111111111 with 13812345678, token ' || {_num(K, 40)} END AS text
    FROM orders"""
ALL_TEXTS = f"SELECT doc_id, text FROM ({SYNTH}) UNION ALL SELECT doc_id, text FROM documents"
EVERY = list(R.BUILT_IN)
MAIN = [r for r in EVERY if r.name in ("email", "bank_card_plain", "bank_card_grouped", "ipv4", "cn_mobile")]
#: What texts are redacted of: everything that has a pattern, tenants' tokens too.
REDACTED = [*EVERY, R.TENANT_RULE]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the tables of a folder; nothing is registered in the session."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    if not used:
        return spark.sql(sql)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        sql = re.sub(rf"(?i)(\b(?:from|join)\s+){t}\b", rf"\1{{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def both(name: str, sql: Callable | str) -> None:
    """A query whose text is the same in both dialects, or a function of the dialect."""
    text = sql if callable(sql) else lambda d: sql
    QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir, text(SPARK))
    ORACLE[name] = text(DUCK)


def frame(name: str, make: Callable[[SparkSession, str], DataFrame], oracle: str | None) -> None:
    QUERIES[name] = make
    if oracle:
        ORACLE[name] = oracle


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, dealt over the cores: the driver's tables are single small files."""
    return run(spark, sf_dir, ALL_TEXTS).repartition(spark.sparkContext.defaultParallelism)
