"""Rosters, surnames, the preset, the cascade and chunks against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import recognizers as R
from cloakwork.operators import rosters as N


def texts(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def spans(df):
    return sorted((r.doc_id, r.type, r.value, r.start, r.end, r.start_cp, r.end_cp) for r in df.collect())


def plain(rows, terms):
    out = []
    for i, t in enumerate(rows):
        low = t.lower() if t and len(t.lower().encode()) == len(t.encode()) else t or ""
        for kind, term in terms:
            at = low.find(term)
            while at >= 0:
                b = len(t[:at].encode())
                out.append((i, kind, t[at : at + len(term)], b, b + len(t[at : at + len(term)].encode()), at, at + len(term)))
                at = low.find(term, at + 1)
    return sorted(out)


def test_every_place_of_every_term(spark, monkeypatch):
    rng = random.Random(1)
    rows = ["".join(rng.choice("abAB é张伟李娜😀") for _ in range(rng.choice([0, 5, 60, 3000]))) for _ in range(60)] + [None, "", "xyz" * 1000]
    terms = [("NAME", "张伟"), ("NAME", "李娜"), ("X", "aba"), ("X", "ab"), ("Y", "é张"), ("Z", "xyzxyz"), ("Z", "b 😀")]
    roster = spark.createDataFrame([*terms, ("X", " AB "), ("W", "x"), ("X", "ab")], "type string, term string")
    want = plain(rows, terms)
    for size, bound in ((N.PIECE, N.BROADCAST_TERMS), (7, 0)):
        monkeypatch.setattr(N, "PIECE", size)
        monkeypatch.setattr(N, "BROADCAST_TERMS", bound)
        assert spans(N.find_terms(texts(spark, rows), roster)) == want
    with pytest.raises(ValueError):
        N.roster(roster.union(spark.createDataFrame([("OTHER", "AB")], "type string, term string")))


def test_roster_files(spark, tmp_path):
    (tmp_path / "r.txt").write_text(" 张伟 \n\n# note\nAcme Ltd\n")
    got = N.read_roster(spark, str(tmp_path / "r.txt"), "NAME").collect()
    assert sorted((r.type, r.term) for r in got) == [("NAME", "Acme Ltd"), ("NAME", "张伟")]


def test_surnames(spark):
    rows = ["经办人 欧阳志远 已签字", "小欧阳修", "欧阳的", "x上官婉", "请联系王芳。", "司马"]
    got = {(r.doc_id, r.value, r.confidence) for r in N.find_names(texts(spark, rows)).collect()}
    assert got == {(0, "欧阳志", 0.7), (0, "欧阳志远", 0.7), (3, "上官婉", 0.7)}
    got = {(r.doc_id, r.value, r.confidence) for r in N.find_names(texts(spark, rows), single=True, given=1).collect()}
    assert (4, "王芳", 0.45) in got and (0, "欧阳志", 0.7) in got and (5, "马", 0.45) not in got
    one = texts(spark, ["欧阳修", "王芳", "某人"]).select(N.surname_of(F.col("text")).alias("s")).collect()
    assert [r.s for r in one] == ["欧阳", "王", ""]
    with pytest.raises(ValueError):
        N.find_names(texts(spark, rows), given=4)
    assert len(set(N.W.COMPOUND_SURNAMES)) == 60 and len(set(N.W.SINGLE_SURNAMES)) == 100


def test_core_preset(spark):
    rows = ["经办人欧阳志远已签字，电话 13812345678", "func 欧阳志(){", "请联系张伟处理", "version 1.2.3.4"]
    roster = spark.createDataFrame([("NAME", "张伟")], "type string, term string")
    got = {(r.doc_id, r.type, r.value) for r in N.core(texts(spark, rows), ("CN",), roster).collect()}
    assert got == {(0, "NAME", "欧阳志远"), (0, "PHONE", "13812345678"), (2, "NAME", "张伟")}
    assert N.coverage_gaps(R.load("CN")) == ["ADDRESS", "NAME", "ORG"] and N.coverage_gaps(R.load("CN"), roster) == ["ADDRESS", "ORG"]


def test_cascade(spark):
    rows = ["mail a@b.cc for Ann Lee é", "Ann Lee and 😀 Ann Lee 4111111111111111", "1 2 3", "boom text here", None]

    def model(batch):
        assert not any("@" in t or "4111" in t for t in batch)
        if any("boom" in t for t in batch):
            raise RuntimeError("down")
        return [[("PERSON", "Ann Lee")] + ([("PERSON", "#")] if "#" in t else []) for t in batch]

    docs = texts(spark, rows).repartition(5, "doc_id")
    settled = R.resolve_overlaps(R.detect(docs, R.load("CN")))
    masked = {r.doc_id: r.text for r in N.mask_settled(docs, settled).collect()}
    assert masked[0] == "mail ###### for Ann Lee é" and all(len((masked[i] or "").encode()) == len((t or "").encode()) for i, t in enumerate(rows))
    out = N.cascade(docs, settled, lambda b: [x for t in b for x in model([t])], {"PERSON": "NAME"})
    got = out.collect()
    for r in got:
        if r.type:
            assert rows[r.doc_id].encode()[r.start : r.end].decode() == r.value == rows[r.doc_id][r.start_cp : r.end_cp]
    failed = {r.doc_id for r in got if r.degraded}
    assert 3 in failed and 2 not in failed
    names = sorted((r.doc_id, r.value) for r in got if r.detector == "model")
    assert set(names) <= {(0, "Ann Lee"), (1, "Ann Lee")} and {(r.doc_id, r.type) for r in got if r.detector != "model" and r.type} == {(0, "EMAIL"), (1, "BANK_CARD")}
    if failed == {3}:
        assert names == [(0, "Ann Lee"), (1, "Ann Lee"), (1, "Ann Lee")]


def test_chunks_find_what_a_whole_text_has(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["a@b.cc", "13812345678", "电话", "text", "é", "4111 1111 1111 1111", "手机", "10.0.0.1", "server"])
    docs = texts(spark, [" ".join(word() for _ in range(n)) for n in (0, 3, 400, 3000)])
    every = lambda d: R.detect(d, R.load("CN"))
    whole = R.resolve_overlaps(every(docs))
    assert spans(N.chunked(docs, every, 1000, 200)) == spans(whole)


def test_script_runs(spark):
    got = N.script_runs(texts(spark, ["Hi 张伟, ok 1", "12 34", "你好"])).orderBy("doc_id", "run").collect()
    assert [(r.doc_id, r.script, r.piece) for r in got] == [(0, "latin", "Hi "), (0, "han", "张伟, "), (0, "latin", "ok 1"), (1, "unknown", "12 34"), (2, "han", "你好")]
