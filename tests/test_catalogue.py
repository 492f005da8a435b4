"""Queries against their SQL twins, and rules that SQL can't state."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cloakwork.functions import checks, keys
from cloakwork.functions.dialect import SPARK
from cloakwork.operators import recognizers as R
from cloakwork.operators import rewrite as W
from cloakwork.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_twin(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    plain = lambda x: sorted(map(str, x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_a_twin_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    ("check", "value", "ok"),
    [("luhn", "79927398713", True), ("luhn", "79927398710", False), ("card", "4111111111111111", True), ("card", "9111111111111111", False), ("iban", "DE89370400440532013000", True), ("iban", "GB82WEST12345698765432", True),
     ("iban", "GB82WEST12345698765433", False), ("dni", "12345678Z", True), ("dni", "X1234567L", True), ("dni", "12345678A", False), ("codice_fiscale", "RSSMRA85T10A562S", True), ("steuer_id", "86095742719", True),
     ("steuer_id", "11095742719", False), ("cn_id", "11010519491231002X", True), ("cn_id", "110105194912310021", False), ("uscc", "91350100M000100Y43", True)],
)
def test_known_numbers(spark, check, value, ok):
    assert spark.sql(f"SELECT {checks.CHECKS[check](SPARK, 'v')} FROM (SELECT '{value}' AS v)").first()[0] is ok


def test_packs_and_tenant_rules():
    assert {r.pack for r in R.load("de", " DE ", "us")} == {"GEN", "DE", "US"} and not [r for r in R.load(disabled=("IP",)) if r.type == "IP"]
    with pytest.raises(ValueError):
        R.load("XX")
    good = {"name": "badge", "type": "CUSTOM_BADGE", "pattern": "B-[0-9]{4}", "score": 0.7, "samples": {"match": ["B-1234"], "no_match": ["B-12"]}}
    assert R.tenant_rule(good).type == "CUSTOM_BADGE"
    for wrong in ({"pattern": "x*"}, {"type": "BADGE"}, {"other": 1}, {"samples": {"match": ["none"]}}, {"samples": {"no_match": ["B-1234"]}}):
        with pytest.raises(ValueError):
            R.tenant_rule({**good, **wrong})


def test_restore_forms(spark):
    vaults = spark.createDataFrame([(1, "NAME", "张伟 \\ $1", 0, "ANONYMIZED_NAME_0")], "session int, type string, value string, idx int, placeholder string")
    texts = spark.createDataFrame([(1, 1, "hi [ anonymized_name_0 ], ANONYMIZED_NAME_7 and (ANONYMIZED_NAME_0"), (2, 2, "ANONYMIZED_NAME_0"), (3, 1, "none")], "doc_id int, session int, text string")
    got = {r.doc_id: (r.restored, r.phantom) for r in W.restore(texts, ["session"], vaults).collect()}
    assert got == {1: ("hi 张伟 \\ $1, ANONYMIZED_NAME_7 and (张伟 \\ $1", "ANONYMIZED_NAME_7"), 2: ("ANONYMIZED_NAME_0", "ANONYMIZED_NAME_0"), 3: ("none", "")}


def test_overlap_blocks_a_row(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (2, "abc")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, 0, 3, "x"), (1, 2, 4, "y"), (2, 1, 2, "Z")], "doc_id int, start int, end int, replacement string")
    assert {r.doc_id: (r.redacted, r.status) for r in W.splice(docs, spans).collect()} == {1: (None, "blocked"), 2: ("aZc", "ok")}


def test_filters_stay_small(spark):
    """No filter repeats what made its columns: contexts and places stand in the plan once."""
    docs = spark.createDataFrame([(1, "a@b.cc")], "doc_id long, text string")
    for r in (*R.BUILT_IN, R.TENANT_RULE):
        plan = R.detect(docs, [r], 0.5)._jdf.queryExecution().optimizedPlan().toString()
        assert max(len(line) for line in plan.split("\n") if "Filter" in line) < 10_000, r.name
    assert spark.readStream.format("rate").load().selectExpr("value AS doc_id", "cast(value AS string) AS text").transform(lambda d: R.detect(d, list(R.BUILT_IN))).isStreaming


def test_dense_texts(spark):
    """Many matches in one text: places by running sums, and overlaps by islands, in time that grows with the text."""
    parts = [["a@b.cc", "é 13812345678", "4111111111111111", "😀", "10.0.0.1 server"][i % 5] for i in range(20_000)]
    text = " ".join(parts)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = R.resolve_overlaps(R.detect(docs, list(R.BUILT_IN))).collect()
    raw = text.encode()
    assert len(got) > 15_000 and all(raw[r.start : r.end].decode() == r.value == text[r.start_cp : r.end_cp] for r in got)


def test_keys():
    assert keys.tenant_key(bytes(32), b"s", "a") != keys.tenant_key(bytes(32), b"s", "b")
    for wrong in ((bytes(31), "a"), (bytes(32), "-a")):
        with pytest.raises(ValueError):
            keys.tenant_key(wrong[0], b"s", wrong[1])


def test_prefilters_lose_nothing(spark):
    texts = catalogue.run(spark, SF, catalogue.ALL_TEXTS).persist()
    for r in (r for r in R.BUILT_IN if r.name != "cn_uscc"):  # its prefilter refuses codes of digits alone, by design
        assert R.recognize(texts, r).count() == R.recognize(texts, R.without_prefilter(r)).count(), r.name
    assert R.recognize(texts.withColumn("value", F.lit("clash")), R.BUILT_IN[0]).count() > 0
