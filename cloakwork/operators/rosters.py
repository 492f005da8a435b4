"""Names from lists: rosters and surnames, found by joining a text's places with the terms' first runes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.dialect import LOWER, UPPER
from . import recognizers as R
from . import verify as V

#: Runes of a piece that places are taken from; a piece goes on into the next one as far as a term may reach.
PIECE = 1024
#: So many terms are broadcast at most; more are joined by a shuffle.
BROADCAST_TERMS = 500_000
#: Confidences.
ROSTER_SCORE, COMPOUND_SCORE, SINGLE_SCORE = 0.98, 0.70, 0.45


def read_roster(spark: SparkSession, path: str, type: str) -> DataFrame:
    """(type, term) from files of one term a line; blank lines and those that begin with # are left out."""
    line = F.trim("value")
    return spark.read.text(path).filter((line != "") & ~line.startswith("#")).select(F.lit(type).alias("type"), line.alias("term"))


def _low(x: Column) -> Column:
    """Lower case unless that changes the number of bytes, which would move places."""
    plain = F.translate(x, UPPER, LOWER)
    return F.when(F.octet_length(x) == F.length(x), plain).when(F.octet_length(F.lower(x)) == F.octet_length(x), F.lower(x)).otherwise(x)


def roster(terms: DataFrame, least: int = 2) -> DataFrame:
    """Distinct terms (type, term) of ``least`` runes or more, trimmed and in lower case.  One term of two types is refused."""
    own = terms.select("type", _low(F.trim("term")).alias("term")).filter(F.length("term") >= least).distinct()
    twice = own.groupBy("term").count().filter("count > 1").select("term").limit(5).collect()
    if twice:
        raise ValueError(f"terms of two types: {', '.join(sorted(r.term for r in twice))}")
    return own


def places(docs: DataFrame, terms: DataFrame, fold: bool = True, around: int = 0) -> DataFrame:
    """Every occurrence, overlapping ones too, of ``terms`` (type, term): doc_id, type, term, value, byte and code-point
    places, and the ``around`` runes before and after.

    Texts are cut into pieces; each place of a piece gives its first runes, as many as the shortest term has, and
    those meet the terms that begin so in an equi-join.  Texts themselves are never joined or copied along.
    """
    sizes = terms.agg(F.min(F.length("term")), F.max(F.length("term")), F.count("*")).first()
    short, long, n = sizes[0] or 1, sizes[1] or 1, sizes[2]
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("p"))
    rows = rows.select("doc_id", "p", F.transform("p", lambda x: F.octet_length(x)).alias("b"))
    piece = f"""transform(p, (x, i) -> struct(i * {PIECE} as cp, aggregate(slice(b, 1, i), 0, (a, y) -> a + y) as at,
        coalesce(right(get(p, i - 1), {around}), '') as before, x as own, x || coalesce(left(get(p, i + 1), {long + around}), '') as line))"""
    rows = rows.select("doc_id", F.inline(F.expr(piece)))
    rows = rows.select("*", (_low(F.col("line")) if fold else F.col("line")).alias("low"))
    rows = rows.select("doc_id", "cp", "at", "before", "line", "low", F.explode(F.expr("sequence(1, length(own))")).alias("i"))
    rows = rows.withColumn("gram", F.expr(f"substr(low, i, {short})")).filter(F.length("gram") == short)
    known = terms.select("type", "term", F.expr(f"left(term, {short})").alias("gram"))
    hit = rows.join(F.broadcast(known) if n <= BROADCAST_TERMS else known, "gram").filter("substr(low, i, length(term)) = term")
    start = F.expr("cast(at + octet_length(left(line, i - 1)) as int)")
    out = hit.select("doc_id", "type", "term", F.expr("substr(line, i, length(term))").alias("value"), start.alias("start"), F.expr("cast(cp + i - 1 as int)").alias("start_cp"),
                     F.expr(f"right(before || left(line, i - 1), {around})").alias("before"), F.expr(f"substr(line, i + length(term), {around})").alias("after"))
    return out.select("doc_id", "type", "term", "value", "start", (F.col("start") + F.octet_length("value")).alias("end"), "start_cp", (F.col("start_cp") + F.length("value")).alias("end_cp"), "before", "after")


def find_terms(docs: DataFrame, terms: DataFrame, name: str = "roster") -> DataFrame:
    """Entities of a roster: every place where a term stands, without regard to word boundaries or case."""
    found = places(docs, roster(terms))
    return found.select("doc_id", F.lit(name).alias("detector"), "type", "value", "start", "end", "start_cp", "end_cp", F.lit(ROSTER_SCORE).alias("confidence"))


def surnames(spark: SparkSession, single: bool = False) -> DataFrame:
    rows = [(COMPOUND_SCORE, s) for s in W.COMPOUND_SURNAMES] + ([(SINGLE_SCORE, s) for s in W.SINGLE_SURNAMES] if single else [])
    return spark.createDataFrame([(str(c), s) for c, s in rows], "type string, term string")


def find_names(docs: DataFrame, single: bool = False, given: int = 2) -> DataFrame:
    """A surname and the one to ``given`` runes after it, each length an entity, up to the first rune that ends a name."""
    if not 1 <= given <= 3:
        raise ValueError("a given name has one to three runes")
    found = places(docs, surnames(docs.sparkSession, single), fold=False, around=given)
    run = F.regexp_extract("after", f"^[\\p{{IsHan}}&&[^{W.GIVEN_STOPS}]]{{1,{given}}}", 0)
    found = found.filter(~F.expr(f"right(before, 1) <> '' and instr('{W.SURNAME_BLOCKS}', right(before, 1)) > 0")).withColumn("run", run).filter("run <> ''")
    found = found.withColumn("more", F.explode(F.expr("transform(sequence(1, length(run)), n -> left(run, n))")))
    return found.select("doc_id", F.lit("cn_surname").alias("detector"), F.lit("NAME").alias("type"), F.concat("value", "more").alias("value"), "start", (F.col("end") + F.octet_length("more")).alias("end"), "start_cp", (F.col("end_cp") + F.length("more")).alias("end_cp"), F.col("type").cast("double").alias("confidence"))


def surname_of(value: Column, single: bool = True) -> Column:
    """The surname that a value begins with, the shorter one first; empty if none."""
    known = [*(W.SINGLE_SURNAMES if single else []), *W.COMPOUND_SURNAMES]
    return F.regexp_extract(value, f"^(?:{'|'.join(known)})", 0)


def declared_types(recognizers: list[R.Recognizer], terms: DataFrame | None = None, names: bool = False) -> set[str]:
    """What the detectors say they cover, whatever a text holds."""
    return {r.type for r in recognizers} | ({r.type for r in terms.select("type").distinct().collect()} if terms is not None else set()) | ({"NAME"} if names else set())


def coverage_gaps(recognizers: list[R.Recognizer], terms: DataFrame | None = None, names: bool = False) -> list[str]:
    """Types that patterns can't find and no other detector covers either."""
    return sorted({"NAME", "ADDRESS", "ORG"} - declared_types(recognizers, terms, names))


def core(docs: DataFrame, packs: tuple[str, ...] = (), terms: DataFrame | None = None, names: bool = True, single: bool = False, least: float = 0.0, disabled: tuple[str, ...] = ()) -> DataFrame:
    """The preset without a model: patterns, rosters and surnames together, then the evidence chains, resolved by evidence."""
    found = R.detect(docs, R.load(*packs, disabled=disabled))
    for more in ([find_terms(docs, terms)] if terms is not None else []) + ([find_names(docs, single)] if names else []):
        found = found.unionByName(more)
    return V.validate_all(docs, found.filter(F.col("confidence") >= least))


def mask_settled(docs: DataFrame, settled: DataFrame) -> DataFrame:
    """Texts with settled spans filled by signs of as many bytes a rune: places before and after stay the same."""
    spans = settled.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(spans, "doc_id", "left").withColumn("raw", F.col("text").cast("binary"))
    rune = "cast(substring(raw, x.start + 1, x.`end` - x.start) as string)"
    for runes, sign in ((r"[\\x{10000}-\\x{10FFFF}]", "🟥"), (r"[\\x{800}-\\x{FFFF}]", "▮"), (r"[\\x{80}-\\x{7FF}]", "§"), (r"[\\x{0}-\\x{7F}]", "#")):
        rune = f"regexp_replace({rune}, '{runes}', '{sign}')"
    gap = "cast(substring(raw, coalesce(get(s, i - 1).`end`, 0) + 1, x.start - coalesce(get(s, i - 1).`end`, 0)) as string)"
    masked = F.expr(f"concat_ws('', transform(s, (x, i) -> {gap} || {rune}), cast(substring(raw, element_at(s, -1).`end` + 1) as string))")
    return rows.select("doc_id", F.when(F.col("s").isNull(), F.col("text")).otherwise(masked).alias("text"))


def not_overlapping(spans: DataFrame, settled: DataFrame) -> DataFrame:
    """Spans that share no byte with a settled one of their document."""
    taken = settled.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("taken"))
    rows = spans.join(taken, "doc_id", "left")
    return rows.filter(F.expr("taken is null or not exists(taken, x -> x.start < `end` and start < x.`end`)")).drop("taken")


def model_runs(text: Column) -> Column:
    """Whether a text is worth a model's time: two runes and two letters at least."""
    return (F.length(text) >= 2) & (F.regexp_count(text, F.lit(r"\p{L}")) >= 2)


def script_ratio(text: Column) -> Column:
    """Han letters among all letters."""
    return F.regexp_count(text, F.lit(r"\p{IsHan}")) / F.greatest(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(1))


def ask_model(docs: DataFrame, model, types: dict[str, str], confidence: float = 0.85, batch: int = 64) -> DataFrame:
    """Entities of a model: ``model`` takes a list of texts and gives for each a list of (type, value) or raises.

    Equal texts are asked once.  Values are looked up wherever they stand in the text.  ``types`` maps the model's
    names; an unknown one is an error of its text.  A failed batch marks its texts ``degraded`` and nothing else.
    """
    asked = docs.select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])

    def run(frames):
        import pandas as pd

        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    answers = [[(types[k], v) for k, v in found if v] for found in model(part.text.tolist())]
                    rows = [(key, k, v, False) for key, found in zip(part.key, answers, strict=True) for k, v in found]
                except Exception:  # the model is foreign code: a failure degrades its texts, never the job
                    rows = [(key, None, None, True) for key in part.key]
                yield pd.DataFrame(rows, columns=["key", "type", "value", "degraded"])

    told = asked.mapInPandas(run, "key string, type string, value string, degraded boolean").distinct()
    rows = docs.select("doc_id", "text", F.sha2("text", 256).alias("key")).join(told, "key").withColumn("raw", F.col("text").cast("binary"))
    gaps = F.expr("split(text, concat('\\\\Q', replace(value, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E'), -1)")
    rows = rows.withColumn("g", F.when(F.col("degraded"), F.array(F.lit(""))).otherwise(gaps))
    upto = lambda f: f"aggregate(slice(g, 1, i + 1), 0, (a, y) -> a + {f}(y)) + i * {f}(value)"
    spans = f"slice(transform(g, (x, i) -> struct({upto('octet_length')} as start, {upto('length')} as start_cp)), 1, case when degraded then 1 else size(g) - 1 end)"
    rows = rows.select("doc_id", "type", "value", "degraded", F.explode(F.expr(spans)).alias("x"))
    return rows.select("doc_id", F.lit("model").alias("detector"), "type", "value", F.col("x.start").cast("int").alias("start"), (F.col("x.start") + F.octet_length("value")).cast("int").alias("end"), F.col("x.start_cp").cast("int").alias("start_cp"), (F.col("x.start_cp") + F.length("value")).cast("int").alias("end_cp"), F.lit(confidence).alias("confidence"), "degraded")


def cascade(docs: DataFrame, settled: DataFrame, model, types: dict[str, str], least_han: float = 0.0, fail_open: bool = True) -> DataFrame:
    """Settled spans first; the model sees the texts with those masked, and what it finds beside them is added.

    Columns as of entities and ``degraded``: a row with a null type tells that the model failed on a document.
    Without ``fail_open`` such a document gives no entity but that row, so that it can be blocked.
    """
    masked = mask_settled(docs, settled)
    left = masked.filter(model_runs(F.col("text")) & (script_ratio(F.col("text")) >= least_han))
    found = ask_model(left, model, types)
    failed = found.filter("degraded").dropDuplicates(["doc_id"]).select(*(F.col(c) if c == "doc_id" else F.lit(None).cast(found.schema[c].dataType).alias(c) for c in R.COLUMNS), F.lit(True).alias("degraded"))
    more = not_overlapping(found.filter("not degraded").drop("degraded"), settled)
    out = R.resolve_overlaps(settled.select(*R.COLUMNS).unionByName(more.select(*R.COLUMNS))).withColumn("degraded", F.lit(False))
    if not fail_open:
        out = out.join(failed.select("doc_id"), "doc_id", "left_anti")
    return out.unionByName(failed)


def cascade_stats(docs: DataFrame, settled: DataFrame, out: DataFrame) -> DataFrame:
    """Documents, settled spans, spans the model added, runes masked, and documents on which the model failed."""
    n = F.count("*").cast("long")
    parts = [docs.agg(n.alias("documents")), settled.agg(n.alias("settled"), F.coalesce(F.sum(F.col("end_cp") - F.col("start_cp")), F.lit(0)).cast("long").alias("masked_runes"))]
    parts.append(out.agg(F.sum(F.when(F.col("detector") == "model", 1).otherwise(0)).cast("long").alias("added"), F.sum(F.col("degraded").cast("int")).cast("long").alias("degraded")))
    return parts[0].join(parts[1]).join(parts[2])


def chunked(docs: DataFrame, detect, runes: int = 16_384, margin: int = 512) -> DataFrame:
    """``detect`` applied to overlapping pieces of long texts, so that one text is spread over many tasks.

    A piece answers for the entities that begin between the middles of its two margins: there both sides of an entity
    are seen, and no entity is given twice.  Places are moved to the text's, overlaps resolved.
    """
    step, half = runes - margin, margin // 2
    cut = F.expr(f"transform(sequence(0, greatest(0, (length(text) - {margin} - 1) div {step})), i -> struct(i, substr(text, i * {step} + 1, {runes}) as piece, octet_length(left(text, i * {step})) as b, i = greatest(0, (length(text) - {margin} - 1) div {step}) as last))")
    rows = docs.select("doc_id", F.explode(cut).alias("x")).select(F.struct("doc_id", F.col("x.i").alias("i"), F.col("x.b").alias("b"), F.col("x.last").alias("last")).alias("doc_id"), F.col("x.piece").alias("text"))
    found = detect(rows.repartition(docs.sparkSession.sparkContext.defaultParallelism))
    found = found.filter(((F.col("doc_id.i") == 0) | (F.col("start_cp") >= half)) & (F.col("doc_id.last") | (F.col("start_cp") < step + half)))
    moved = found.select(F.col("doc_id.doc_id").alias("id"), "detector", "type", "value", *((F.col(c) + F.col("doc_id.b")).cast("int").alias(c) for c in ("start", "end")), *((F.col(c) + F.col("doc_id.i") * step).cast("int").alias(c) for c in ("start_cp", "end_cp")), "confidence")
    return R.resolve_overlaps(moved.withColumnRenamed("id", "doc_id"))


def script_runs(docs: DataFrame) -> DataFrame:
    """Runs of one script (han or latin) in each text: doc_id, run, script, start_cp, end_cp, piece.  Other runes stay with the run they follow."""
    pieces = F.regexp_extract_all("text", F.lit(r"(?s)[^\p{IsHan}\p{IsLatin}]*(?:\p{IsHan}[^\p{IsLatin}]*|\p{IsLatin}[^\p{IsHan}]*|$)"), F.lit(0))
    rows = docs.select("doc_id", F.filter(pieces, lambda x: x != "").alias("p"))
    rows = rows.select("doc_id", F.expr("transform(p, (x, i) -> struct(i as run, x as piece, aggregate(slice(p, 1, i), 0, (a, y) -> a + length(y)) as start_cp))").alias("x")).select("doc_id", F.inline("x"))
    script = F.when(F.regexp_count("piece", F.lit(r"\p{IsHan}")) > 0, "han").when(F.regexp_count("piece", F.lit(r"\p{IsLatin}")) > 0, "latin").otherwise("unknown")
    return rows.select("doc_id", "run", script.alias("script"), "start_cp", (F.col("start_cp") + F.length("piece")).alias("end_cp"), "piece")
