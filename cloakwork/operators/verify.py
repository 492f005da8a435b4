"""Verification: candidates are extended over what belongs to them, judged by shape and by cues around them, and
resolved by their evidence.  All rules are SQL over an entity and the text before and after it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.dialect import SPARK, Dialect
from .recognizers import islands, sealed

#: Bytes of text kept on either side: room for an extension and the widest window behind it.
SIDE = 512
SPAN = ["doc_id", "detector", "type", "value", "start", "end", "start_cp", "end_cp", "confidence"]


@dataclass(frozen=True)
class Cue:
    """``side``: before, after or either.  A ``weight`` of None drops the entity where the cue is found."""

    name: str
    words: tuple[str, ...]
    side: str
    window: int
    weight: float | None = None


@dataclass(frozen=True)
class Chain:
    """Cues in order, the score that keeps an entity, and the confidence below which an unverified one is dropped
    (a confidence of zero means that none was given).  ``reject``: drop whatever stays unverified."""

    type: str
    cues: tuple[Cue, ...]
    threshold: float
    drop_below: float = 0.0
    reject: bool = False


#: Weights, windows and thresholds of the chains.
ADDRESS = Chain("ADDRESS", (Cue("code", W.CODE_ADDRESS, "either", 64), Cue("address verb", W.ADDRESS_VERBS, "before", 32, 0.6), Cue("door mark", W.DOOR_MARKS, "after", 24, 0.4)), 0.4)
NAME = Chain(
    "NAME",
    (Cue("code", W.CODE_NAME, "either", 64), Cue("honorific", W.HONORIFICS, "either", 24, 0.7), Cue("human act", W.HUMAN_ACTS, "either", 32, 0.5), Cue("relation", W.RELATIONS, "either", 32, 0.6)),
    0.5,
    0.5,
)
ORG = Chain("ORG", (Cue("organisation suffix", W.ORG_SUFFIXES, "either", 24, 0.6), Cue("business", W.BUSINESS, "before", 32, 0.5), Cue("code", W.CODE_SHORT, "either", 64)), 0.5)
DEFAULT = (ADDRESS, NAME, ORG)
#: What stretches a span may take in.
FORWARD_RUNES, BACK_RUNES, BACK_WORDS, BACK_MOST, BACK_LEAST_SCORE = 30, 16, 6, 12, 0.5


def validator(*chains: Chain) -> dict[str, Chain]:
    """Chains by type; two for one type are refused."""
    out = {c.type: c for c in chains}
    if len(out) < len(chains):
        raise ValueError("two chains for one type")
    return out


def contexts(docs: DataFrame, entities: DataFrame, side: int = SIDE) -> DataFrame:
    """Entities with ``before`` and ``after``: the text around each, of ``side`` bytes or a little less.

    Entities are brought together by document, so a text is moved once and cut by bytes, whatever their number.
    """
    packed = entities.groupBy("doc_id").agg(F.collect_list(F.struct(*SPAN[1:])).alias("l"))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).join(packed, "doc_id")
    whole = lambda x, edge: f"regexp_replace({x}, '{edge}', '')"  # noqa: E731  a rune cut at the far edge goes
    before = whole(f"cast(substring(raw, greatest(x.start - {side}, 0) + 1, least(x.start, {side})) as string)", "^\\\\ufffd+")
    after = whole(f"cast(substring(raw, x.`end` + 1, {side}) as string)", "\\\\ufffd+$")
    cut = f"transform(l, x -> struct(x.*, {before} as before, {after} as after))".replace("x.*", ", ".join(f"x.`{c}` as `{c}`" for c in SPAN[1:]))
    return rows.select("doc_id", F.inline(F.expr(cut)))


def _any(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def _has(text: str, words) -> str:
    return "(" + " or ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


def _pattern(d: Dialect, text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({text}, {d.raw(pattern)}, {group})"


def forward(d: Dialect, value: str = "value", after: str = "after") -> str:
    """What an address goes on with: runes of Han, digits and spaces up to the last place name suffix among them."""
    run = _pattern(d, _pattern(d, after, rf"^[{d.script('Han')}\p{{Nd}} ]{{0,{FORWARD_RUNES}}}"), f"^[^{W.PLACE_STOPS}]*")
    line = f"(right({value}, 1) || {run})"
    one, two = ([w for w in W.PLACE_SUFFIXES if len(w) == n] for n in (1, 2))
    ends = f"greatest(length({_pattern(d, line, f'^.+(?:{_any(one)})')}), length({_pattern(d, line, f'^.*(?:{_any(two)})')}))"
    return f"substr({line}, 2, cast(greatest({ends} - 1, 0) as int))"


def backward_han(d: Dialect, value: str = "value", before: str = "before") -> str:
    """The head of an organisation's name before its generic end, if place, trade or length speak for it."""
    run = _pattern(d, _pattern(d, before, rf"[\p{{L}}\p{{Nd}}]{{0,{BACK_RUNES}}}$"), f"[^{W.ORG_STOPS}]*$")
    score = f"case when {_has('run', W.ADMINISTRATIVE)} then 0.6 else 0.0 end + case when {_has(f'(run || {value})', W.INDUSTRY)} then 0.5 else 0.0 end + case when length(run) between 1 and 8 then 0.3 else 0.0 end"
    body = f"case when length(run) between 1 and {BACK_MOST} and {score} >= {BACK_LEAST_SCORE} then run else '' end"
    return re.sub(r"\brun\b", lambda m: run, body)


def backward_latin(d: Dialect, before: str = "before") -> str:
    """Up to six capitalised words before an organisation's generic end."""
    chain = _pattern(d, before, r"(?:[\p{L}\p{Nd}.&-]+ )+$")
    stops = ", ".join(f"'{w}'" for w in W.LATIN_STOPS)
    if d.spark:
        words = f"slice(reverse(split(rtrim({chain}), ' ')), 1, {BACK_WORDS})"
        good = f"transform({words}, (w, k) -> w rlike r'^\\p{{Lu}}' and lower(w) not in ({stops}) and octet_length(array_join(slice({words}, 1, k), ' ')) + 1 <= 3 * {BACK_RUNES} + 2)"
        n = f"(case when array_position({good}, false) = 0 then size({words}) else array_position({good}, false) - 1 end)"
        taken = f"array_join(reverse(slice({words}, 1, cast({n} as int))), ' ')"
    else:
        words = f"list_reverse(string_split(rtrim({chain}), ' '))[1:{BACK_WORDS}]"
        good = f"list_transform({words}, lambda w, k: regexp_matches(w, '^\\p{{Lu}}') and lower(w) not in ({stops}) and strlen(array_to_string({words}[1:k - 1], ' ')) + 1 <= 3 * {BACK_RUNES} + 2)"
        n = f"coalesce(nullif(list_position({good}, false), 0) - 1, len({words}))"
        taken = f"array_to_string(list_reverse({words}[1:{n}]), ' ')"
    return f"case when {chain} = '' or {taken} = '' then '' else {taken} || ' ' end"


def backward(d: Dialect) -> str:
    ends = d.test("value", f"(?:{_any([*W.ANCHORS_HAN, *W.ANCHORS_LATIN])})$")
    latin = d.test("before", rf"{d.script('Latin')} $")
    return f"case when not {ends} or before = '' then '' when {latin} then {backward_latin(d)} else {backward_han(d)} end"


def shape(d: Dialect) -> str:
    """Why a value can't be a name, an address or an organisation, else null."""
    short = "length(trim(value)) <= 8"
    plain = r"\p{Nd}._-"
    return (
        f"case when {d.test('value', r'^[A-Za-z_][A-Za-z0-9_]*[\t\n\f\r ]*[(\[.]')} or {d.test('value', r'[(){}\[\];=<>|&]')} then 'code shape' "
        f"when {short} and ({d.test('trim(value)', f'^[A-Z{plain}]*[A-Z][A-Z{plain}]*$')} or {d.test('trim(value)', f'^[a-z{plain}]*[a-z][a-z{plain}]*$')}) then 'abbreviation' "
        f"when {d.test('value', r'[0-9]+\.[0-9]+\.[0-9]+')} then 'dotted number' end"
    )


def _found(cue: Cue) -> str:
    sides = {"before": ("b",), "after": ("a",), "either": ("b", "a")}[cue.side]
    return "(" + " or ".join(_has(f"{x}{cue.window}", cue.words) for x in sides) + ")"


def decide_sql(d: Dialect, source: str, chains: tuple[Chain, ...] = DEFAULT) -> str:
    """``source`` (entities with before and after) to decisions: the entity as extended, verdict, score, evidence, reason."""
    for c in chains:
        for cue in c.cues:
            assert cue.window in (24, 32, 64), "windows of other sizes need a column of their own"
    by_type = lambda f, other: "case type " + " ".join(f"when '{c.type}' then {f(c)}" for c in chains) + f" else {other} end"
    n = d.bytes
    ends = [("doc_id", "doc_id"), ("detector", "detector"), ("type", "type"), ("back || value || fwd", "value"), (f"cast(start - {n('back')} as int)", "start"), (f'cast({d.name("end")} + {n("fwd")} as int)', d.name("end"))]
    ends += [("cast(start_cp - length(back) as int)", "start_cp"), ("cast(end_cp + length(fwd) as int)", "end_cp"), ("confidence", "confidence"), ("start", "from_start"), (d.name("end"), "from_end"), (f"cast({n('back')} + {n('fwd')} as int)", "extended")]
    ends += [("left(before, cast(length(before) - length(back) as int))", "before"), ("substr(after, cast(length(fwd) + 1 as int))", "after")]
    windows = ", ".join(f"{d.shortest(side, text, w)} as {x}{w}" for x, side, text in (("b", "right", "before"), ("a", "left", "after")) for w in (24, 32, 64))

    def score(c: Chain, upto: int | None = None) -> str:
        parts = [f"case when {_found(cue)} then {cue.weight} else 0.0 end" for cue in c.cues[:upto] if cue.weight is not None]
        return f"cast({' + '.join(parts) or '0.0'} as double)"

    def vetoed(c: Chain) -> tuple[str, str]:
        i, cue = next(((i, cue) for i, cue in enumerate(c.cues) if cue.weight is None), (None, None))
        return ("false", "0.0") if cue is None else (_found(cue), score(c, i))

    evidence = lambda c: "concat_ws(', ', " + ", ".join(f"case when {_found(cue)} then '{cue.name}' end" for cue in c.cues if cue.weight is not None) + ")"
    first = f"SELECT *, {by_type(lambda c: 'true', 'false')} AS chained, case when type = 'ADDRESS' then {forward(d)} else '' end AS fwd, case when type = 'ORG' then {backward(d)} else '' end AS back FROM ({source})"
    grown = f"SELECT {', '.join(f'{e} AS {a}' for e, a in ends)}, chained FROM ({first})"
    seen = f"SELECT *, {windows}, case when chained then {shape(d)} end AS bad FROM ({grown})"
    told = f"SELECT *, {by_type(lambda c: vetoed(c)[0], 'false')} AS vetoed, {by_type(lambda c: vetoed(c)[1], '0.0')} AS before_veto, {by_type(score, '0.0')} AS total, {by_type(evidence, repr(''))} AS cues FROM ({seen})"
    low = by_type(lambda c: f"(confidence > 0 and confidence < {c.drop_below})", "false")
    reject = by_type(lambda c: str(c.reject).lower(), "false")
    reason = f"case when not chained then 'no chain' when bad is not null then bad when vetoed then 'code' when total >= {by_type(lambda c: str(c.threshold), '0.0')} then 'verified' when {reject} then 'unverified' when {low} then 'low confidence' else 'undecided' end"
    judged = f"SELECT *, {reason} AS reason FROM ({told})"
    verdict = "case when reason in ('no chain', 'verified') then 'KEEP' when reason = 'undecided' then 'UNKNOWN' else 'DROP' end"
    spans = ", ".join(d.name(c) for c in SPAN)
    return f"""SELECT {spans}, from_start, from_end, extended, {verdict} AS verdict, round(cast(case when not chained or bad is not null then 0.0 when vetoed then before_veto else total end as double), 4) AS score,
        case when bad is not null then bad when vetoed then 'code' else cues end AS evidence, reason FROM ({judged})"""


def decide(docs: DataFrame, entities: DataFrame, chains: tuple[Chain, ...] = DEFAULT) -> DataFrame:
    """A decision for every entity: KEEP, DROP or UNKNOWN, with the span as extended.  Types without a chain are kept."""
    validator(*chains)
    return sealed(docs.sparkSession.sql(_braced(decide_sql(SPARK, "SELECT * FROM :found:", chains)), found=contexts(docs, entities)))


def _braced(sql: str) -> str:
    """SQL for a formatter: its own braces doubled, the frame's name in single ones."""
    return sql.replace("{", "{{").replace("}", "}}").replace(":found:", "{found}")


def resolve_by_evidence(decisions: DataFrame) -> DataFrame:
    """Greedy by verdict, score, confidence, length and start: what overlaps a kept span goes; dropped ones don't compete."""
    rank = F.when(F.col("verdict") == "KEEP", 0).otherwise(1)
    order = F.struct(rank.alias("a"), (-F.col("score")).alias("b"), (-F.col("confidence")).alias("c"), (F.col("start") - F.col("end")).alias("d"), "start", *(c for c in decisions.columns if c not in ("doc_id", "start")))
    live = islands(decisions.filter("verdict <> 'DROP'"), ["doc_id"])
    ranked = live.groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(order)).alias("l"))
    keep = "case when size(l) = 1 then l else aggregate(l, slice(l, 1, 0), (k, v) -> case when exists(k, y -> v.start < y.`end` and y.start < v.`end`) then k else concat(k, array(v)) end) end"
    return ranked.select("doc_id", F.explode(F.expr(keep)).alias("e")).select("doc_id", *(F.col(f"e.{c}").alias(c) for c in decisions.columns if c != "doc_id"))


def validate_all(docs: DataFrame, entities: DataFrame, chains: tuple[Chain, ...] = DEFAULT) -> DataFrame:
    return resolve_by_evidence(decide(docs, entities, chains))


#: Types settled by themselves, types that always need a second look, and the confidence below which others do.
NEVER, ALWAYS, DOUBT = ("BANK_CARD", "IBAN", "ID_CARD", "USCC", "EMAIL", "CREDENTIAL"), ("ADDRESS", "ORG", "NAME", "ACCOUNT"), 0.75


def ambiguous() -> str:
    names = lambda x: ", ".join(f"'{t}'" for t in x)
    return f"case when type in ({names(NEVER)}) then false when type in ({names(ALWAYS)}) then true else confidence < {DOUBT} end"


def relevant_sql(d: Dialect) -> str:
    """Whether an address or organisation is what the text asks about and nobody's own (over before, value, after)."""
    window = f"({d.shortest('right', 'before', 64)} || value || {d.shortest('left', 'after', 64)})"
    return f"(type in ('ADDRESS', 'ORG') and not {d.any_word(window, W.OWN)} and {d.any_word(window, W.TOPIC)})"


def snippet(d: Dialect) -> str:
    """A verdict stands only if its evidence is in the text word for word (over text, verdict, evidence)."""
    return "case when verdict = 'UNKNOWN' or (trim(coalesce(evidence, '')) <> '' and instr(text, evidence) > 0) then verdict else 'UNKNOWN' end"


def pipeline(docs: DataFrame, entities: DataFrame, judged: DataFrame | None = None, fail_closed: bool = True, relevance: bool = True) -> DataFrame:
    """The two stages: settled entities are redacted, doubtful ones verified.

    ``judged``: the verifier's answers (doc_id, start, end, type, verdict, evidence); without it the evidence chains
    answer.  ``outcome``: redact, dropped, preserved (what the question is about) or undecided; with ``fail_closed`` an
    undecided or unanswered entity is redacted as well, which ``redacted`` tells.
    """
    rows = contexts(docs, entities).withColumn("doubt", F.expr(ambiguous()))
    if judged is None:
        told = decide(docs, entities.filter(F.expr(ambiguous()))).select("doc_id", "type", "detector", F.col("from_start").alias("start"), F.col("from_end").alias("end"), "verdict")
        rows = rows.join(told.dropDuplicates(["doc_id", "type", "detector", "start", "end"]), ["doc_id", "type", "detector", "start", "end"], "left")
    else:
        texts = docs.select("doc_id", "text")
        told = judged.join(texts, "doc_id").withColumn("verdict", F.expr(snippet(SPARK))).select("doc_id", "start", "end", "type", "verdict")
        rows = rows.join(told, ["doc_id", "start", "end", "type"], "left")
    verdict = F.when(~F.col("doubt"), "KEEP").otherwise(F.coalesce("verdict", F.lit("UNKNOWN")))
    kept = F.expr(relevant_sql(SPARK)) if relevance else F.lit(False)
    goes = (verdict == "KEEP") | (F.lit(fail_closed) & (verdict == "UNKNOWN"))
    outcome = F.when(verdict == "DROP", "dropped").when(goes & kept, "preserved").when(verdict == "UNKNOWN", "undecided").otherwise("redact")
    return rows.select(*SPAN, outcome.alias("outcome"), (goes & ~kept).alias("redacted"))


def summary(outcomes: DataFrame) -> DataFrame:
    """Counts of a run: redacted, dropped, preserved, undecided."""
    n = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    return outcomes.agg(n(F.col("redacted")).alias("redacted"), *(n(F.col("outcome") == x).alias(x) for x in ("dropped", "preserved", "undecided")))
