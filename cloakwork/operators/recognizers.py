"""Pattern recognisers: greedy matches, then boundary, check digits and context, all as SQL expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import checks
from ..functions.dialect import DUCK, SPARK, Dialect

BOUNDARY = {"none": "", "digit": "[0-9]", "digit_sep": "[0-9-]", "alnum": "[0-9A-Za-z]"}
CONTEXT_BYTES = 48


@dataclass(frozen=True)
class Recognizer:
    name: str
    type: str
    score: float
    pattern: str
    need: str | tuple[str, ...]  # regular expressions; any text with a match holds all of them
    boundary: str = "none"
    check: str | None = None
    stripped: bool = False
    words: tuple[str, ...] = ()
    boost: float = 0.15
    required: bool = False
    pack: str = "GEN"
    linear: str | None = None  # the same matches, stated so that runs aren't tried from each of their places
    match: tuple[str, ...] = ()  # samples of a tenant's rule
    no_match: tuple[str, ...] = ()
    digits: str = ""  # what any match holds of DIGIT_RUNS: begins with a digit, has no other spaces than single ones

    def needs(self) -> tuple[str, ...]:
        return (self.need,) if isinstance(self.need, str) and self.need else tuple(self.need)


#: Patterns, scores and context words of the built-in recognisers.
CARD_WORDS = ("卡号", "银行卡", "信用卡", "card", "credit")
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
BUILT_IN = (
    Recognizer("email", "EMAIL", 0.99, r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "@", linear=r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    Recognizer("bank_card_grouped", "BANK_CARD", 0.80, r"[0-9]{4}(?:[ \-][0-9]{4}){2,4}", "[0-9]{4}[ -][0-9]{4}", "digit_sep", "card", True, CARD_WORDS, digits="[0-9]{4}[ -][0-9]{4}"),
    Recognizer("bank_card_plain", "BANK_CARD", 0.80, "[0-9]{12,19}", "[0-9]{12}", "digit_sep", "card", False, CARD_WORDS, digits="[0-9]{12}"),
    Recognizer("iban", "IBAN", 0.95, "[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}[A-Z0-9]{0,4}", "[A-Z]{2}[0-9]{2}", "alnum", "iban", True, ("iban", "账号", "account", "银行"), digits="[0-9]{2}[ ]?[A-Z0-9]{4}"),
    Recognizer("intl_phone", "PHONE", 0.85, r"\+[0-9]{1,3}[\t\n\f\r \-]?[0-9]{6,14}", r"\+", "digit", digits="[0-9]{6}"),
    Recognizer("ipv4", "IP", 0.70, rf"(?:{OCTET}\.){{3}}{OCTET}", "[0-9][.][0-9]", "digit", None, False, ("ip", "地址", "服务器", "主机", "网关", "内网", "外网", "host", "server", "addr", "gateway", "endpoint", "上游"), 0.05, True, digits="[0-9][.][0-9]"),
    Recognizer("openai_key", "CREDENTIAL", 0.99, r"sk-[A-Za-z0-9_\-]{16,}", "sk-"),
    Recognizer("aws_access_key", "CREDENTIAL", 0.99, "AKIA[0-9A-Z]{16}", "AKIA"),
    Recognizer("github_token", "CREDENTIAL", 0.99, "gh[pousr]_[A-Za-z0-9]{20,}", ("gh", "gh[pousr]_")),
    Recognizer("jwt", "CREDENTIAL", 0.99, r"eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}", "eyJ"),
    Recognizer("cn_id_card", "ID_CARD", 0.90, "[0-9]{17}[0-9Xx]", "[0-9]{17}", "digit", "cn_id", False, ("身份证", "证件号", "identity", "id card"), pack="CN", digits="[0-9]{17}"),
    Recognizer("cn_mobile", "PHONE", 0.85, "1[3-9][0-9]{9}", "1[3-9][0-9]{9}", "digit_sep", None, False, ("手机", "电话", "联系", "phone", "mobile"), pack="CN", digits="[0-9]{11}"),
    Recognizer("cn_landline", "PHONE", 0.85, "0[0-9]{2,3}-[0-9]{7,8}", "0[0-9]{2,3}-[0-9]{7}", "digit_sep", pack="CN", digits="0[0-9]{2,3}-[0-9]{7}"),
    Recognizer("cn_uscc", "USCC", 0.90, "[0-9A-HJ-NPQRTUWXY]{2}[0-9]{6}[0-9A-HJ-NPQRTUWXY]{10}", "[A-Z]", "alnum", "uscc", pack="CN", digits="[0-9]{6}"),
    Recognizer("cn_passport", "PASSPORT", 0.60, "[EG][0-9]{8}", "[EG][0-9]{8}", "alnum", None, False, ("护照", "passport"), 0.30, pack="CN", digits="[0-9]{8}"),
    Recognizer("cn_license_plate", "LICENSE_PLATE", 0.90, "[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-HJ-NP-Z][A-HJ-NP-Z0-9]{4,6}[A-HJ-NP-Z0-9挂学警港澳]", "[一-龥]", pack="CN"),
    Recognizer("de_steuer_id", "ID_CARD", 0.90, "[0-9]{11}", "[0-9]{11}", "digit", "steuer_id", False, ("steuer", "steueridentifikationsnummer", "tax id", "税号"), pack="DE", digits="[0-9]{11}"),
    Recognizer("de_ust_idnr", "USCC", 0.85, "DE[0-9]{9}", "DE[0-9]{9}", "alnum", None, False, ("ust", "umsatzsteuer", "vat"), pack="DE", digits="[0-9]{9}"),
    Recognizer("es_dni_nie", "ID_CARD", 0.90, "[XYZxyz]?[0-9]{7,8}[-]?[A-Za-z]", "[0-9]{7}", "alnum", "dni", True, ("dni", "nie", "documento", "身份证"), pack="ES", digits="[0-9]{7}"),
    Recognizer("it_codice_fiscale", "ID_CARD", 0.90, "[A-Za-z]{6}[0-9]{2}[A-Za-z][0-9]{2}[A-Za-z][0-9]{3}[A-Za-z]", "[0-9]{2}[A-Za-z][0-9]{2}", "alnum", "codice_fiscale", False, ("codice fiscale", "cf", "税号", "fiscal code"), pack="IT", digits="[0-9]{2}[A-Za-z][0-9]{2}"),
    Recognizer("it_partita_iva", "USCC", 0.80, "[0-9]{11}", "[0-9]{11}", "digit", "luhn", False, ("partita iva", "p.iva", "vat"), pack="IT", digits="[0-9]{11}"),
    Recognizer("us_ssn", "SSN", 0.75, "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9]{2}-[0-9]", "digit", None, False, ("ssn", "social security", "社会安全号"), 0.20, pack="US", digits="[0-9]{3}-[0-9]{2}-[0-9]{4}"),
)
TENANT_RULE = Recognizer("tenant_token", "CUSTOM_TOKEN", 0.80, "[0-9a-f]{40}", "token", "alnum", None, False, ("token",), 0.15, True, "TENANT")
PACKS = ("GEN", "CN", "DE", "ES", "IT", "US")


def load(*packs: str, disabled: tuple[str, ...] = ()) -> list[Recognizer]:
    """Recognisers of the packs named, the general one included; unknown codes raise, repeats count once."""
    codes = dict.fromkeys(["GEN", *(p.strip().upper() for p in packs)])
    if unknown := [c for c in codes if c not in PACKS]:
        raise ValueError(f"unknown packs: {', '.join(unknown)}")
    return [r for r in BUILT_IN if r.pack in codes and r.type not in disabled]


def tenant_rule(rule: dict) -> Recognizer:
    """A recogniser from a tenant's rule; a pattern that matches nothing at all is refused."""
    known = {"name", "type", "pattern", "score", "boundary", "validator", "context", "prefilter", "samples"}
    if extra := set(rule) - known:
        raise ValueError(f"unknown keys: {', '.join(sorted(extra))}")
    if not re.fullmatch(r"CUSTOM_[A-Z0-9_]+", rule["type"]) and rule["type"] not in {r.type for r in BUILT_IN}:
        raise ValueError(f"not a type: {rule['type']}")
    if re.match(rule["pattern"], ""):
        raise ValueError("the pattern matches the empty text")
    if rule.get("boundary", "none") not in BOUNDARY:
        raise ValueError(f"unknown boundary: {rule['boundary']}")
    if rule.get("validator") is not None and rule["validator"] not in checks.CHECKS:
        raise ValueError(f"unknown validator: {rule['validator']}")
    if not 0 < float(rule["score"]) <= 1:
        raise ValueError("the score lies outside (0, 1]")
    words, samples, fore = rule.get("context") or {}, rule.get("samples") or {}, rule.get("prefilter") or {}
    if extra := set(words) - {"words", "boost", "required"} | set(samples) - {"match", "no_match"} | set(fore) - {"prefix", "byte", "digit", "upper_alpha", "cjk"}:
        raise ValueError(f"unknown keys: {', '.join(sorted(extra))}")
    for text in samples.get("match", ()):
        if not re.fullmatch(rule["pattern"], text):
            raise ValueError(f"a sample isn't matched fully: {text}")
    for text in samples.get("no_match", ()):
        if re.fullmatch(rule["pattern"], text) and not rule.get("validator") and not words.get("required"):
            raise ValueError(f"a sample is matched that should not be: {text}")
    any_of = lambda xs: "(?:" + "|".join(re.escape(x) for x in xs) + ")"
    needs = [any_of(fore[k]) for k in ("prefix", "byte") if fore.get(k)] + [p for k, p in (("digit", "[0-9]"), ("upper_alpha", "[A-Z]"), ("cjk", "[\u4000-\u9fff]")) if fore.get(k)]
    return Recognizer(
        rule["name"], rule["type"], float(rule["score"]), rule["pattern"], tuple(needs), rule.get("boundary", "none"), rule.get("validator"), bool(rule.get("validator")), tuple(words.get("words", ())),
        float(words.get("boost", 0.15)), bool(words.get("required", False)), "TENANT", match=tuple(samples.get("match", ())), no_match=tuple(samples.get("no_match", ())),
    )


def self_test(spark: SparkSession, rules: list[Recognizer]) -> list[str]:
    """Samples that whole rules, with boundaries, check digits and context, judge wrongly: "name: sample" each.

    A sample to match gives one entity, all of it; one not to match gives none."""
    wrong = []
    for rule in rules:
        rows = [(i, t) for i, t in enumerate((*rule.match, *rule.no_match))]
        found: dict[int, list[str]] = {}
        for r in recognize(spark.createDataFrame(rows, "doc_id long, text string"), rule).select("doc_id", "value").collect() if rows else ():
            found.setdefault(r.doc_id, []).append(r.value)
        wrong += [f"{rule.name}: {t}" for i, t in rows if found.get(i, []) != ([t] if i < len(rule.match) else [])]
    return wrong


def without_prefilter(r: Recognizer) -> Recognizer:
    return replace(r, need="", digits="")


def _window(d: Dialect, before: str, v: str, after: str) -> str:
    """The match with the context around it; at most as many characters as bytes are looked at."""
    plain = lambda x, side: f"case when {d.bytes(x)} = length({x}) then {x} else {d.shortest(side, x, CONTEXT_BYTES)} end"
    return f"({plain(before, 'right')} || {v} || {plain(after, 'left')})"


def _test(r: Recognizer, d: Dialect, before: str, after: str) -> str:
    """Boundary and check digits of a match."""
    out = []
    if BOUNDARY[r.boundary]:
        out.append(f"not {d.test(f'({before} || {after})', BOUNDARY[r.boundary])}")
    if r.check:
        out.append(checks.CHECKS[r.check](d, checks.strip("v") if r.stripped else "v"))
    return " and ".join(out) or "true"


def _near(r: Recognizer, d: Dialect) -> str:
    return d.any_word("win", r.words) if r.words else "false"


def _score(r: Recognizer, d: Dialect) -> str:
    return f"cast(case when {_near(r, d)} then least(1.0, {r.score} + {r.boost}) else {r.score} end as double)"


COLUMNS = ["doc_id", "detector", "type", "value", "start", "end", "start_cp", "end_cp", "confidence"]


#: Running sums go over blocks of so many matches.
BLOCK = 128
#: Bytes that hold a context's characters whatever their size, and one more that may be cut.
REACH = 4 * CONTEXT_BYTES + 8


def sealed(rows: DataFrame) -> DataFrame:
    """The same rows, made by a generator: later filters don't push below it and so don't repeat what made the columns."""
    return rows.select(F.inline(F.array(F.struct("*"))))


#: Tokens from their first digit on.  Put together they tell in one pass over a text which digit patterns it can hold.
DIGIT_RUNS = "[0-9][0-9A-Za-z.-]*"


def _holds(text: Column, need: str) -> Column:
    plain = need.replace("\\", "")
    return F.contains(text, F.lit(plain)) if re.fullmatch(r"[\w@+ :-]+", plain) and need in (plain, re.escape(plain)) else text.rlike(need)


def detect(docs: DataFrame, recognizers: list[Recognizer], least: float = 0.0) -> DataFrame:
    """All recognisers' entities at or above a confidence, overlaps left in: byte and code-point offsets, value, confidence.

    One scan serves every recogniser, without a shuffle, on batches and streams: one pass gathers the runs of digits,
    and patterns that need some are tried only on texts whose runs allow it.  Matches and the gaps between them are
    cut from the text in two passes of the regular expression engine, the second only where the first found something.
    Places are running sums of their lengths; contexts are cut from the bytes around a match.  All this is done inside
    the array of a text's matches, so that no later filter repeats it and no match carries its text along.
    """
    d, none = SPARK, F.array().cast("array<string>")
    pick = lambda f, other: "case r " + " ".join(f"when {i} then {f(r)}" for i, r in enumerate(recognizers)) + f" else {other} end"
    found = []
    for i, r in enumerate(recognizers):
        matches = F.regexp_extract_all("text", F.lit(r.linear or r.pattern), F.lit(0))
        for need in reversed(r.needs()):
            matches = F.when(_holds(F.col("text"), need), matches).otherwise(none)
        if r.digits:
            matches = F.when(F.col("runs").rlike(r.digits), matches).otherwise(none)
        found.append(F.struct(F.lit(i).alias("r"), F.coalesce(matches, none).alias("m")))
    runs = F.array_join(F.regexp_extract_all("text", F.lit(DIGIT_RUNS), F.lit(0)), " ") if any(r.digits for r in recognizers) else F.lit("")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", "text", runs.alias("runs"))
    rows = rows.select("doc_id", "text", F.explode(F.filter(F.array(*found), lambda x: F.size(x["m"]) > 0)).alias("x")).select("doc_id", "text", "x.r", "x.m")
    gaps = F.when(F.lit(False), none)
    for i, r in enumerate(recognizers):
        gaps = gaps.when(F.col("r") == i, F.split("text", r.linear or r.pattern, -1))
    rows = rows.select("doc_id", "r", "m", F.col("text").cast("binary").alias("raw"), gaps.alias("g"))
    sizes = lambda f: F.expr(f"case when size(m) > 1 then transform(m, (v, i) -> {f}(get(g, i)) + {f}(v)) end")
    rows = rows.select("*", sizes("length").alias("c"), sizes("octet_length").alias("b"))
    block = lambda c: F.expr(f"case when size(m) > {BLOCK} then transform(sequence(0, (size(m) - 1) div {BLOCK}), k -> aggregate(slice({c}, k * {BLOCK} + 1, {BLOCK}), 0, (a, x) -> a + x)) end")
    rows = rows.select("*", block("c").alias("cs"), block("b").alias("bs"))
    blocks = lambda c: f"case when i < {BLOCK} then 0 else aggregate(slice({c}s, 1, i div {BLOCK}), 0, (a, x) -> a + x) end"
    upto = lambda c, f: f"{f}(get(g, i)) + {blocks(c)} + case when i = 0 then 0 else aggregate(slice({c}, i div {BLOCK} * {BLOCK} + 1, i % {BLOCK}), 0, (a, x) -> a + x) end"
    cut = lambda lo, n: f"cast(substring(raw, {lo}, {n}) as string)"
    hits = f"transform(m, (v, i) -> struct(v, {upto('c', 'length')} as s, {upto('b', 'octet_length')} as f))"
    hits = f"transform({hits}, x -> struct(x.v, x.s, x.f, {cut(f'greatest(x.f - {REACH}, 0) + 1', f'least(x.f, {REACH})')} as before, {cut('x.f + octet_length(x.v) + 1', REACH)} as after))"
    rows = rows.select("doc_id", "r", F.explode(F.expr(hits)).alias("x")).select("doc_id", "r", "x.*")
    rows = rows.select("doc_id", "r", "v", "s", "f", F.expr(f"right(before, {CONTEXT_BYTES})").alias("before"), F.expr(f"left(after, {CONTEXT_BYTES})").alias("after"))
    rows = rows.filter(F.expr(pick(lambda r: _test(r, d, "right(before, 1)", "left(after, 1)"), "false")))
    words = ", ".join(str(i) for i, r in enumerate(recognizers) if r.words)
    if words:  # made by a generator, so that what is asked of it later doesn't repeat it for each word
        window = F.struct(F.expr(f"case when r in ({words}) then {_window(d, 'before', 'v', 'after')} end").alias("win"))
        rows = rows.select("doc_id", "r", "v", "s", "f", F.inline(F.array(window)))
    if any(r.required for r in recognizers):
        rows = rows.filter(F.expr(pick(lambda r: _near(r, d) if r.required else "true", "false")))
    names = [F.expr(pick(lambda r, a=a: f"'{getattr(r, a)}'", "''")).alias(n) for a, n in (("name", "detector"), ("type", "type"))]
    out = rows.select("doc_id", *names, F.col("v").alias("value"), F.col("f").alias("start"), (F.col("f") + F.octet_length("v")).alias("end"), F.col("s").alias("start_cp"), (F.col("s") + F.length("v")).alias("end_cp"), F.expr(pick(lambda r: _score(r, d), "0D")).alias("confidence"))
    return out.filter(F.col("confidence") >= least) if least > 0 else out


def recognize(docs: DataFrame, r: Recognizer) -> DataFrame:
    """Entities of one recogniser."""
    return detect(docs, [r])


def recognize_sql(source: str, r: Recognizer) -> str:
    d, p = DUCK, r.pattern.replace("'", "''")
    need = " AND ".join(d.test("text", n) for n in r.needs()) or "true"
    before, after = f"right(left(text, cast(s as int)), {CONTEXT_BYTES})", f"substr(text, cast(s + length(v) + 1 as int), {CONTEXT_BYTES})"
    near, far = "case when s = 0 then '' else substr(text, cast(s as int), 1) end", "substr(text, cast(s + length(v) + 1 as int), 1)"
    return f"""
        SELECT doc_id, '{r.name}' AS detector, '{r.type}' AS type, v AS value, strlen(left(text, s))::INT AS start, (strlen(left(text, s)) + strlen(v))::INT AS "end",
               s::INT AS start_cp, (s + length(v))::INT AS end_cp, {_score(r, d)} AS confidence
        FROM (SELECT *, {_window(d, before, "v", after) if r.words else "''"} AS win FROM (
            SELECT doc_id, text, m[i + 1] AS v, (list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0))::BIGINT AS s
            FROM (SELECT doc_id, text, m, g, unnest(range(0, len(m))) AS i FROM (
                SELECT doc_id, text, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM ({source}) WHERE {need}) WHERE len(m) > 0)) WHERE {_test(r, d, near, far)})
        {f"WHERE {_near(r, d)}" if r.required else ""}"""


def detect_sql(source: str, recognizers: list[Recognizer], least: float = 0.0) -> str:
    return f"SELECT * FROM ({' UNION ALL '.join(recognize_sql(source, r) for r in recognizers)}) WHERE confidence >= {least}"


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` with island: runs of spans that overlap through others.  Spans of two islands never overlap."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("opens", F.when(F.col("start") < reach, 0).otherwise(1))
    return rows.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def resolve_overlaps(entities: DataFrame) -> DataFrame:
    """Greedy by byte length, confidence, start and detector: what overlaps a kept span goes.

    The choice is made in each island by itself, so its cost grows with the largest island, not with a text's spans.
    """
    order = F.struct((F.col("start") - F.col("end")).alias("a"), (-F.col("confidence")).alias("b"), "start", "detector", "end", "type", "value", "start_cp", "end_cp", "confidence")
    ranked = islands(entities, ["doc_id"]).groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(order)).alias("l"))
    keep = "case when size(l) = 1 then l else aggregate(l, slice(l, 1, 0), (k, v) -> case when exists(k, y -> v.start < y.`end` and y.start < v.`end`) then k else concat(k, array(v)) end) end"
    return ranked.select("doc_id", F.explode(F.expr(keep)).alias("e")).select("doc_id", *(F.col(f"e.{c}").alias(c) for c in COLUMNS[1:]))


def resolve_overlaps_sql(entities: str) -> str:
    """The same greedy choice, one rank a step."""
    return f"""
        WITH RECURSIVE e AS ({entities}),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start - "end", -confidence, start, detector, "end", type, value) AS n FROM e),
        k(doc_id, n, spans) AS (
            SELECT doc_id, 1::BIGINT, [{{'s': start, 'e': "end", 'n': n}}] FROM r WHERE n = 1
            UNION ALL
            SELECT r.doc_id, r.n, CASE WHEN len(list_filter(k.spans, lambda y: r.start < y.e AND y.s < r."end")) > 0 THEN k.spans ELSE list_append(k.spans, {{'s': r.start, 'e': r."end", 'n': r.n}}) END
            FROM k JOIN r ON r.doc_id = k.doc_id AND r.n = k.n + 1),
        done AS (SELECT doc_id, arg_max(spans, n) AS spans FROM k GROUP BY doc_id)
        SELECT r.doc_id, r.detector, r.type, r.value, r.start, r."end", r.start_cp, r.end_cp, r.confidence
        FROM r JOIN done USING (doc_id) WHERE list_contains(list_transform(spans, lambda y: y.n), r.n)"""
