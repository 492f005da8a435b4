"""Flows, ontologies, rules from files, and tokens that come back."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from cloakwork.functions.keys import Keyring, derive
from cloakwork.operators import flows, tokens
from cloakwork.operators import recognizers as R

RING = Keyring(bytes(range(32)), b"salt")
MATRIX = """
version: 1
options: {char_mask: {char: "*", keep: 4}, hash: {digits: 12}, generalize: {granularity: decade, fallback: char_mask}}
flows:
  - {name: public, restores: true, default: mask}
  - {name: pseudo, restores: true, default: tokenize}
  - {name: stats, default: hash, by_type: {PHONE: drop, ORG: generalize, ID_CARD: generalize}}
"""
TERMS = "terms: {外科医生: 医生, Surgeon: physician}"


def test_matrix_is_checked_when_it_is_loaded():
    m = flows.load_matrix(MATRIX, flows.load_ontology(TERMS))
    assert set(m.flows) == {"public", "pseudo", "stats"} and m.options.digits == 12 and "stats (restores: no)" in m.describe() and "  PHONE: drop" in m.describe()
    wrong = [
        ("version: 1", "version: 2"), ("default: mask", "default: hash"), ("default: tokenize", "default: magic"), ("PHONE: drop", "FOO: drop"), ("name: pseudo", "name: public"),
        ("digits: 12", "digits: 7"), ("fallback: char_mask", "fallback: generalize"), ("granularity: decade", "granularity: month"), ("restores: true, default: mask", "restores: true"), ("keep: 4", "kept: 4"),
    ]
    for a, b in wrong:
        with pytest.raises(ValueError):
            flows.load_matrix(MATRIX.replace(a, b))
    with pytest.raises(ValueError) as e:
        flows.load_matrix(MATRIX.replace("PHONE: drop", "FOO: drop").replace("digits: 12", "digits: 7"))
    assert "FOO" in str(e.value) and "digits" in str(e.value)
    with pytest.raises(ValueError):
        flows.load_matrix(MATRIX, has_keys=False)
    for bad in ("terms: {a: ''}", "terms: {a: b, A: c}", "term: {a: b}"):
        with pytest.raises(ValueError):
            flows.load_ontology(bad)


def test_rules_from_files(spark, tmp_path):
    rule = "version: 1\ntenant: t\nrules:\n  - {name: %s, type: CUSTOM_EMP, pattern: 'EMP-[0-9]{6}', score: 0.9, boundary: alnum, samples: {match: [EMP-004217], no_match: [XEMP-004217, EMP-4217]}}\n"
    (tmp_path / "a.yaml").write_text(rule % "one")
    (tmp_path / "b.yml").write_text(rule % "two")
    rules = flows.load_rules(tmp_path)
    assert [r.name for r in rules] == ["one", "two"] and R.self_test(spark, rules) == []
    (tmp_path / "b.yml").write_text((rule % "one").replace("alnum", "never") + "extra: 1\n")
    (tmp_path / "c.yaml").write_text((rule % "one").replace("EMP-[0-9]{6}", "x*"))
    with pytest.raises(ValueError) as e:
        flows.load_rules(tmp_path)
    assert all(x in str(e.value) for x in ("extra", "never", "empty text"))
    loose = R.tenant_rule({"name": "n", "type": "CUSTOM_N", "pattern": "[0-9]{10}", "score": 0.8, "validator": "luhn", "samples": {"match": ["4008217350"], "no_match": ["4008217351", "no 40082173501"]}})
    assert R.self_test(spark, [loose]) == ["n: no 40082173501"] or R.self_test(spark, [loose]) == []
    with pytest.raises(ValueError):
        R.tenant_rule({"name": "n", "type": "CUSTOM_N", "pattern": "[0-9]{10}", "score": 0.8, "validator": "sum"})


def sent(spark):
    rows = [
        (1, "acme", "s1", 1, "public", "Ann of Acme, Bob"), (2, "acme", "s1", 2, "public", "Bob met Ann"), (3, "acme", "s2", 1, "public", "Bob"), (4, "beta", "s1", 1, "public", "Bob"),
        (5, "acme", "s9", 1, "stats", "Ann Surgeon 1987年6月5日 13812345678 abc"), (6, "acme", "s9", 2, "nowhere", "Ann"), (7, "acme", "s9", 3, "pseudo", "Ann and Ann"), (8, "beta", "s9", 3, "pseudo", "Ann"), (9, "acme", "s9", 9, "public", "nothing"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, tenant string, session string, seq int, destination string, text string")
    found = []
    for i, *_, text in rows:
        for kind, value in (("NAME", "Ann"), ("NAME", "Bob"), ("ORG", "Acme"), ("ORG", "Surgeon"), ("ID_CARD", "1987年6月5日"), ("PHONE", "13812345678"), ("ORG", "abc")):
            at = text.find(value)
            while at >= 0:
                b = len(text[:at].encode())
                found.append((i, kind, value, b, b + len(value.encode())))
                at = text.find(value, at + 1)
    return docs, spark.createDataFrame(found, "doc_id long, type string, value string, start int, end int")


def test_redaction_by_destination(spark):
    docs, found = sent(spark)
    matrix = flows.load_matrix(MATRIX, flows.load_ontology(TERMS))
    out, vault, issued = flows.redact_to(docs, found, matrix, RING)
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].redacted == "ANONYMIZED_NAME_0 of ANONYMIZED_ORG_0, ANONYMIZED_NAME_1" and got[2].redacted == "ANONYMIZED_NAME_1 met ANONYMIZED_NAME_0"
    assert got[3].redacted == got[4].redacted == "ANONYMIZED_NAME_0" and got[9].redacted == "nothing"
    digest = hmac.new(derive(RING.root, RING.salt, "cloakwork/tenant/acme"), b"NAME\x00Ann", hashlib.sha256).hexdigest()[:12]
    assert (got[5].redacted, got[5].status, got[5].error_class) == (None, "blocked", "strategy")  # abc is too short to be masked
    assert (got[6].redacted, got[6].status, got[6].error_class) == (None, "blocked", "unknown_destination")
    fine, _, _ = flows.redact_to(docs, found.filter("value <> 'abc'"), matrix, RING)
    assert {r.doc_id: r.redacted for r in fine.collect()}[5] == f"[hash:name:{digest}] physician 1980s  abc"
    marks = {i: got[i].redacted.split(" and ") for i in (7, 8)}
    assert marks[7][0] == marks[7][1] != marks[8][0] and {(r.tenant, r.value) for r in issued.collect()} == {("acme", "Ann"), ("beta", "Ann")}
    assert {(r.tenant, r.session, r.value, r.idx) for r in vault.collect()} == {("acme", "s1", "Ann", 0), ("acme", "s1", "Bob", 1), ("acme", "s1", "Acme", 0), ("acme", "s2", "Bob", 0), ("beta", "s1", "Bob", 0)}
    plan = out._jdf.queryExecution().toString()
    assert all(key.hex() not in plan.lower() for key in (RING.root, derive(RING.root, RING.salt, "cloakwork/tenant/acme")))


def test_tokens_come_back(spark):
    values = spark.createDataFrame([("acme", "NAME", "Ann"), ("acme", "name", "Ann"), ("acme", "name", "张伟"), ("beta", "name", "Ann"), ("acme", "org", None)], "tenant string, namespace string, value string")
    store = tokens.issue(values, RING).persist()
    assert store.count() == 3 and tokens.issue(values, RING, store).count() == 0
    token = {(r.tenant, r.namespace): r.token for r in store.collect() if r.tenant == "beta"} | {("acme", "ann"): hmac.new(derive(RING.root, RING.salt, "cloakwork/token-identity/e1/acme"), b"name\x00Ann", hashlib.sha256).hexdigest()[:32]}
    texts = spark.createDataFrame([(1, "acme", f"hi [tok:name:{token['acme', 'ann']}], [tok:name:{token['beta', 'name']}] {{x}}"), (2, "beta", f"[tok:name:{token['beta', 'name'].upper()}]"), (3, "acme", "none"), (4, "acme", None)], "doc_id int, tenant string, text string")
    got = {r.doc_id: r for r in tokens.restore_tokens(texts, store, RING).collect()}
    assert got[1].restored == f"hi Ann, [tok:name:{token['beta', 'name']}] {{x}}" and got[1].phantom == f"[tok:name:{token['beta', 'name']}]" and got[1].n_tokens == 2
    assert (got[2].restored, got[3].restored, got[4].restored) == ("Ann", "none", None)
    other = tokens.restore_tokens(texts, store, Keyring(bytes(32), b"salt")).collect()
    assert {r.doc_id: r.status for r in other} == {1: "store_error", 2: "store_error", 3: "ok", 4: "ok"}
    moved = store.withColumn("namespace", F.lit("org"))  # a record under another name doesn't open
    asked = store.filter("tenant = 'acme'").select("tenant", F.lit("org").alias("namespace"), "token")
    assert {r.status for r in tokens.resolve(asked, moved, RING).collect()} == {"store_error"}
    back = tokens.decode(tokens.encode(store))
    assert back.filter("bad").count() == 0 and sorted(map(tuple, back.drop("bad").collect())) == sorted(map(tuple, store.collect()))
    assert tokens.decode(store.select("tenant", "namespace", "token", F.lit("x.y").alias("record"))).filter("bad").count() == 3
    left, erased = tokens.erase(store, "acme")
    assert (left.count(), erased) == (1, 2)


def test_expiry_is_set_once(spark):
    values = spark.createDataFrame([("acme", "name", "Ann")], "tenant string, namespace string, value string")
    at = lambda s: F.timestamp_seconds(F.lit(s))
    first = tokens.issue(values, RING, ttl_seconds=60, now=at(1000)).persist()
    assert tokens.issue(values, RING, first, 60, at(1050)).count() == 0
    asked = first.select("tenant", "namespace", "token")
    assert [tokens.resolve(asked, first, RING, at(s)).first().status for s in (1060, 1061)] == ["ok", "unknown"]
    again = tokens.issue(values, RING, first, 60, at(2000))
    assert again.count() == 1 and again.first().token == first.first().token
