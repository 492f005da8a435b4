"""Rewriting of entities: placeholders, keyed hashes, tokens, masks, generalisation, removal; and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dialect import DUCK, SPARK, Dialect
from ..functions.keys import hmac_hex

#: Fixed form: a placeholder with an opener and a closer of any kind, spaces inside, or a bare one.
BARE = "(?i)ANONYMIZED_[A-Z_]+?_[0-9]+"
PLACEHOLDER = f"[`\\[{{<【（(][\\t\\n\\f\\r ]*{BARE}[\\t\\n\\f\\r ]*[`\\]}}>】）)]|{BARE}"
STRATEGIES = ("mask", "tokenize", "hash", "char_mask", "drop", "generalize")
REVERSIBLE = ("mask", "tokenize")


def hashed(d: Dialect, key: bytes, digits: int = 8) -> str:
    zero = "char(0)" if d.spark else "chr(0)"
    return f"('[hash:' || lower(type) || ':' || left({hmac_hex(d, key, f'(type || {zero} || value)')}, {digits}) || ']')"


def token(d: Dialect, key: bytes) -> str:
    zero = "char(0)" if d.spark else "chr(0)"
    return f"('[tok:' || lower(type) || ':' || left({hmac_hex(d, key, f'(lower(type) || {zero} || value)')}, 32) || ']')"


def char_mask(char: str = "*", keep: int = 4) -> str:
    """Null, a blocked row, where the value isn't longer than what is kept."""
    return f"case when length(value) > {keep} then repeat('{char}', cast(length(value) - {keep} as int)) || right(value, {keep}) end"


def generalized(d: Dialect, year: bool = False) -> str:
    """A date to its year or decade; null for other values."""
    date = "^(1[89][0-9]{2}|20[0-9]{2})(?:[-/年][0-9]{1,2}[-/月][0-9]{1,2}日?|年?)$"
    found = f"regexp_extract(trim(value), {d.raw(date)}, 1)"
    return f"nullif({found}, '')" if year else f"case when {found} <> '' then left({found}, 3) || '0s' end"


def vault(entities: DataFrame, session: list[str], order: list[str]) -> DataFrame:
    """One row for each value of a session: its number by first appearance within the type, and its placeholder."""
    first = entities.groupBy(*session, "type", "value").agg(F.min(F.struct(*order)).alias("first"))
    n = F.row_number().over(Window.partitionBy(*session, "type").orderBy("first")) - 1
    return first.withColumn("idx", n.cast("int")).select(*session, "type", "value", "idx", F.concat_ws("_", F.lit("ANONYMIZED"), "type", F.col("idx").cast("string")).alias("placeholder"))


def splice(docs: DataFrame, replacements: DataFrame) -> DataFrame:
    """Texts with their spans (start, end in bytes) replaced, in time that grows with the text.

    Overlapping spans or a null replacement block the row: text null, status blocked."""
    spans = replacements.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,end:int,replacement:string>>")
    rows = docs.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"), F.col("text").cast("binary").alias("raw"))
    bad = F.expr("exists(spans, x -> x.replacement is null) or exists(transform(spans, (x, i) -> i > 0 and get(spans, i - 1).`end` > x.start), y -> y)")
    before = "coalesce(get(spans, i - 1).`end`, 0)"
    pieces = f"transform(spans, (x, i) -> cast(substring(raw, {before} + 1, x.start - {before}) as string) || x.replacement)"
    out = F.expr(f"concat_ws('', {pieces}, cast(substring(raw, element_at(spans, -1).`end` + 1) as string))")
    whole = F.when(F.size("spans") == 0, F.col("text")).when(~bad, out)
    return rows.select("doc_id", whole.alias("redacted"), F.size("spans").alias("n_entities"), F.when(bad, "blocked").otherwise("ok").alias("status"))


def splice_sql(docs: str, replacements: str) -> str:
    return f"""
        WITH d AS (SELECT doc_id, text FROM ({docs})), r AS (SELECT doc_id, start_cp, end_cp, replacement FROM ({replacements})),
        p AS (SELECT r.*, text, coalesce(lag(end_cp) OVER (PARTITION BY doc_id ORDER BY start_cp, end_cp), 0) AS done_cp, row_number() OVER (PARTITION BY doc_id ORDER BY start_cp DESC, end_cp DESC) AS back FROM r JOIN d USING (doc_id)),
        s AS (SELECT doc_id, string_agg(text[done_cp + 1:start_cp] || coalesce(replacement, '') || CASE WHEN back = 1 THEN text[end_cp + 1:] ELSE '' END, '' ORDER BY start_cp, end_cp) AS t, count(*) AS n, bool_or(replacement IS NULL OR done_cp > start_cp) AS bad FROM p GROUP BY doc_id)
        SELECT doc_id, CASE WHEN bad THEN NULL ELSE coalesce(t, text) END AS redacted, coalesce(n, 0)::INT AS n_entities, CASE WHEN bad THEN 'blocked' ELSE 'ok' END AS status FROM d LEFT JOIN s USING (doc_id)"""


def restore(texts: DataFrame, session: list[str], vaults: DataFrame) -> DataFrame:
    """Placeholders back to values, case-insensitively; a bracket on each side goes with them; unknown ones are listed."""
    known = vaults.groupBy(*session).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("known"))
    rows = texts.join(known, session, "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,string>")))
    rows = rows.withColumn("whole", F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(0))).withColumn("inner", F.transform("whole", lambda x: F.upper(F.regexp_extract(x, BARE, 0)))).withColumn("gaps", F.split("text", PLACEHOLDER, -1))
    out = F.expr("concat_ws('', transform(gaps, (g, i) -> g || case when i < size(whole) then coalesce(try_element_at(known, get(inner, i)), get(whole, i)) else '' end))")
    lost = F.expr("filter(inner, x -> try_element_at(known, x) is null)")
    return rows.select(*texts.columns, out.alias("restored"), F.expr(f"size(inner)").cast("int").alias("n_found"), F.array_join(lost, ",").alias("phantom"))


def leaks(texts: DataFrame, session: list[str], vaults: DataFrame) -> DataFrame:
    """Types of vault values that stand literally in a session's outgoing text."""
    return texts.join(vaults.select(*session, "type", "value"), session).filter(F.contains("text", "value")).select(*texts.columns, "type").distinct()
