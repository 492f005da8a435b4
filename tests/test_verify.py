"""Evidence chains, extensions, resolution and the two-stage run against expectations written out by hand."""

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import verify as V

SCHEMA = "doc_id long, detector string, type string, value string, start int, end int, start_cp int, end_cp int, confidence double"


def frames(spark, cases):
    """(text, type, value[, confidence]) as documents and entities at the value's first place."""
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    rows = []
    for i, (text, kind, value, *conf) in enumerate(cases):
        at = text.index(value)
        start = len(text[:at].encode())
        rows.append((i, "t", kind, value, start, start + len(value.encode()), at, at + len(value), conf[0] if conf else 0.0))
    return docs, spark.createDataFrame(rows, SCHEMA)


def decided(spark, cases):
    docs, found = frames(spark, cases)
    got = {r.doc_id: r for r in V.decide(docs, found).collect()}
    for i, c in enumerate(cases):
        r, raw = got[i], c[0].encode()
        assert raw[r.start : r.end].decode() == r.value == c[0][r.start_cp : r.end_cp]
        assert r.extended == len(r.value.encode()) - len(c[2].encode())
    return [got[i] for i in range(len(cases))]


EXTENDED = [
    ("寄往北京市海淀区中关村大街1号。", "ADDRESS", "北京市", "北京市海淀区中关村大街1号"),
    ("地址：上海市浦东新区世纪大道100号12层。", "ADDRESS", "上海市", "上海市浦东新区世纪大道100号12层"),
    ("公司在杭州市余杭区文一西路969号3栋502室办公。", "ADDRESS", "杭州市", "杭州市余杭区文一西路969号3栋502室"),
    ("寄往北京市海淀区中关村大街1号的会议室。", "ADDRESS", "北京市", "北京市海淀区中关村大街1号"),
    ("住在广州市，联系电话另附。", "ADDRESS", "广州市", "广州市"),
    ("他从北京市出发去开会。", "ADDRESS", "北京市", "北京市"),
    ("在长安大 街 9 单元", "ADDRESS", "长安大", "长安大 街 9 单元"),
    ("合同方为星辰科技有限公司。", "ORG", "科技有限公司", "星辰科技有限公司"),
    ("供应商是临安远景机械制造有限公司。", "ORG", "机械制造有限公司", "临安远景机械制造有限公司"),
    ("由中国工商银行代扣。", "ORG", "银行", "中国工商银行"),
    ("请到北京市第一中级人民法院。", "ORG", "法院", "北京市第一中级人民法院"),
    ("他在阿里巴巴工作。", "ORG", "阿里巴巴", "阿里巴巴"),
    ("invoice from Acme Global Ltd today", "ORG", "Ltd", "Acme Global Ltd"),
    ("contract with Northwind Trading GmbH", "ORG", "GmbH", "Northwind Trading GmbH"),
    ("ACME GLOBAL LTD INVOICE", "ORG", "LTD", "ACME GLOBAL LTD"),
    ("On Monday Acme Ltd filed a claim", "ORG", "Ltd", "Acme Ltd"),
    ("In January Contoso Inc reported", "ORG", "Inc", "Contoso Inc"),
    ("Our client Northwind GmbH agreed", "ORG", "GmbH", "Northwind GmbH"),
    ("One Two Three Four Five Six Seven Ltd", "ORG", "Ltd", "Two Three Four Five Six Seven Ltd"),
    ("我在星辰科技有限公司工作", "ORG", "科技有限公司", "星辰科技有限公司"),
]
VERDICTS = [
    ("func retry(n int) error { return nil }", "NAME", "retry(n", "DROP", "code shape"),
    ("const MASK = 0xDEAD; return MASK;", "NAME", "MASK", "DROP", "abbreviation"),
    ("def Handlers of request: return None", "NAME", "Handlers", "DROP", "code"),
    ("release 1.2.3 is out", "NAME", "1.2.3", "DROP", "dotted number"),
    ("请联系张伟处理此事。", "NAME", "张伟", "KEEP", "verified"),
    ("经办人李娜已签字确认。", "NAME", "李娜", "KEEP", "verified"),
    ("Mr. Smith will attend.", "NAME", "Smith", "KEEP", "verified"),
    ("张三目前住在杭州。", "NAME", "张三", "UNKNOWN", "undecided"),
    ("func f() { return 11010519491231002X }", "ID_CARD", "11010519491231002X", "KEEP", "no chain"),
]


def test_extensions(spark):
    assert [r.value for r in decided(spark, [c[:3] for c in EXTENDED])] == [c[3] for c in EXTENDED]


def test_verdicts(spark):
    assert [(r.verdict, r.reason) for r in decided(spark, [c[:3] for c in VERDICTS])] == [c[3:] for c in VERDICTS]


def test_guesses_need_evidence(spark):
    cases = [("王者荣耀的新赛季已经开启。", "NAME", "王者", c) for c in (0.45, 0.0, 0.9)] + [("王者先生来了", "NAME", "王者", 0.45)]
    assert [r.verdict for r in decided(spark, cases)] == ["DROP", "UNKNOWN", "UNKNOWN", "KEEP"]
    got = decided(spark, [("客户赵敏的手机是 1", "NAME", "赵敏")])[0]
    assert (got.score, got.evidence) == (0.6, "relation")


def test_windows_end_on_runes(spark):
    """A cue counts while a byte of it lies in the window, rounded outwards to whole runes."""
    cases = [("客" * n + "地址" + "某" * k + "长安路", "ADDRESS", "长安路") for n in (0, 200) for k in range(14)]
    want = ["KEEP" if 3 * (k + 2) <= 32 + 2 else "UNKNOWN" for _ in (0, 200) for k in range(14)]
    assert [r.verdict for r in decided(spark, cases)] == want


def test_one_chain_a_type():
    with pytest.raises(ValueError):
        V.validator(V.NAME, V.NAME)


def test_resolution_by_evidence(spark):
    schema = "doc_id long, detector string, type string, start int, end int, confidence double, verdict string, score double"
    rows = [(1, "a", "NAME", 0, 9, 0.9, "UNKNOWN", 0.4), (1, "b", "NAME", 3, 6, 0.5, "KEEP", 0.5), (1, "c", "ORG", 5, 20, 0.9, "DROP", 0.9), (1, "d", "NAME", 6, 9, 0.7, "UNKNOWN", 0.0), (2, "e", "NAME", 0, 4, 0.5, "KEEP", 0.5), (2, "f", "NAME", 2, 9, 0.5, "KEEP", 0.5), (2, "g", "NAME", 20, 24, 0.5, "UNKNOWN", 0.0)]
    got = V.resolve_by_evidence(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.detector for r in got) == ["b", "d", "f", "g"]


def test_two_stages(spark):
    cases = [
        ("卡 4111111111111111 在", "BANK_CARD", "4111111111111111", 0.8),
        ("const MASK = 1", "NAME", "MASK", 0.6),
        ("请联系张伟处理", "NAME", "张伟", 0.9),
        ("北京路1号 怎么走", "ADDRESS", "北京路1号", 0.9),
        ("客户 家住 北京路1号", "ADDRESS", "北京路1号", 0.9),
        ("王者荣耀", "NAME", "王者", 0.9),
        ("护照 E1", "PASSPORT", "E1", 0.6),
    ]
    docs, found = frames(spark, cases)
    for closed in (True, False):
        got = {r.doc_id: (r.outcome, r.redacted) for r in V.pipeline(docs, found, fail_closed=closed).collect()}
        assert got == {0: ("redact", True), 1: ("dropped", False), 2: ("redact", True), 3: ("preserved", False) if closed else ("undecided", False), 4: ("undecided", closed), 5: ("undecided", closed), 6: ("redact", True)}
    judged = found.select("doc_id", "start", "end", "type", F.lit("DROP").alias("verdict"), F.when(F.col("doc_id") == 2, "请联系").otherwise("made up").alias("evidence"))
    got = {r.doc_id: r.outcome for r in V.pipeline(docs, found, judged).collect()}
    assert got[0] == "redact" and got[2] == "dropped" and got[5] == "undecided"
    assert V.summary(V.pipeline(docs, found)).first().asDict() == {"redacted": 5, "dropped": 1, "preserved": 1, "undecided": 2}
