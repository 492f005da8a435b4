"""Where a text goes decides how its entities are rewritten: flows, their checks, ontologies, and redaction by them."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from ..functions.keys import Keyring, hmac_under
from . import recognizers as R
from . import rewrite as W
from . import tokens as T

#: Types beside the recognisers' own that flows may name.
TYPES = frozenset(r.type for r in R.BUILT_IN) | {"NAME", "ADDRESS", "ORG", "ACCOUNT"}


@dataclass(frozen=True)
class Options:
    """``char`` and ``keep`` of char_mask, ``digits`` of hash, ``granularity`` (year or decade) and ``fallback`` of generalize."""

    char: str = "*"
    keep: int = 4
    digits: int = 8
    granularity: str = "decade"
    fallback: str = "drop"


@dataclass(frozen=True)
class Flow:
    name: str
    default: str
    by_type: dict[str, str] = field(default_factory=dict)
    restores: bool = False


class Matrix:
    """Flows by destination.  What can't work is refused when it is added, not when a text comes."""

    def __init__(self, options: Options = Options(), ontology: dict[str, str] | None = None):
        self.options, self.ontology, self.flows = options, dict(ontology or {}), {}

    def problems(self, flow: Flow) -> list[str]:
        out, named = [], {"default": flow.default, **flow.by_type}
        if not flow.name.strip():
            out.append("a flow without a name")
        if flow.name in self.flows:
            out.append(f"{flow.name}: registered twice")
        if not flow.default:
            out.append(f"{flow.name}: no default, so types that nobody thought of would pass")
        for where, op in named.items():
            if op and op not in W.STRATEGIES:
                out.append(f"{flow.name}: {where} names an unknown operator {op!r}")
            if flow.restores and op in W.STRATEGIES and op not in W.REVERSIBLE:
                out.append(f"{flow.name}: restores responses, but {where} uses {op}, which can't be undone")
        out += [f"{flow.name}: unknown type {t}" for t in flow.by_type if t not in TYPES and not t.startswith("CUSTOM_")]
        return out

    def add(self, flow: Flow) -> Matrix:
        if found := self.problems(flow):
            raise ValueError("; ".join(found))
        self.flows[flow.name] = flow
        return self

    def describe(self) -> str:
        lines = []
        for name, flow in sorted(self.flows.items()):
            lines += [f"{name} (restores: {'yes' if flow.restores else 'no'})", f"  default: {flow.default}"]
            lines += [f"  {t}: {op}" for t, op in sorted(flow.by_type.items())]
        return "\n".join(lines)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(destination, type, strategy, restores), the default under a null type: as many rows as the file has lines."""
        rows = [(f.name, t, op, f.restores) for f in self.flows.values() for t, op in [(None, f.default), *f.by_type.items()]]
        return spark.createDataFrame(rows, "destination string, type string, strategy string, restores boolean")


def _yaml(source: str | Path) -> dict:
    import yaml

    text = Path(source).read_text(encoding="utf-8") if isinstance(source, Path) else source
    docs = list(yaml.safe_load_all(text))
    if len(docs) != 1 or not isinstance(docs[0], dict):
        raise ValueError("one YAML mapping is wanted")
    return docs[0]


def _extra(where: str, given: dict, known: set[str]) -> list[str]:
    return [f"{where}: unknown key {k!r}" for k in sorted(map(str, set(given) - known))]


def load_ontology(source: str | Path) -> dict[str, str]:
    """Terms and the wider ones they stand for; strict about keys, empty sides and terms that differ in case only."""
    doc = _yaml(source)
    terms = doc.get("terms") or {}
    wrong = _extra("ontology", doc, {"version", "terms"}) + [f"an empty side: {k!r}" for k, v in terms.items() if not str(k).strip() or not str(v or "").strip()]
    low = [str(k).strip().lower() for k in terms]
    wrong += [f"a term twice: {k}" for k in sorted({k for k in low if low.count(k) > 1})]
    if wrong:
        raise ValueError("; ".join(wrong))
    return {str(k): str(v) for k, v in terms.items()}


def load_matrix(source: str | Path, ontology: dict[str, str] | None = None, has_keys: bool = True) -> Matrix:
    """A matrix from YAML (version, options, flows).  All problems are reported together, policy before dependencies."""
    doc = _yaml(source)
    wrong = _extra("matrix", doc, {"version", "options", "flows"})
    if doc.get("version") != 1:
        wrong.append(f"version {doc.get('version')!r} is not 1")
    given = doc.get("options") or {}
    wrong += _extra("options", given, {"char_mask", "hash", "generalize"})
    mask, digest, general = ({**(given.get(k) or {})} for k in ("char_mask", "hash", "generalize"))
    wrong += _extra("char_mask", mask, {"char", "keep"}) + _extra("hash", digest, {"digits"}) + _extra("generalize", general, {"granularity", "fallback"})
    o = Options(str(mask.get("char", "*")), int(mask.get("keep", 4)), int(digest.get("digits", 8)), str(general.get("granularity", "decade")), str(general.get("fallback", "drop")))
    for bad, why in ((len(o.char) != 1, "char is one rune"), (o.keep < 0, "keep is negative"), (not 8 <= o.digits <= 64, "digits are 8 to 64"), (o.granularity not in ("year", "decade"), "granularity is year or decade"), (o.fallback not in W.STRATEGIES or o.fallback == "generalize", f"fallback {o.fallback!r} is no operator to fall back to")):
        wrong += [why] if bad else []
    out, used = Matrix(o, ontology), set()
    if not doc.get("flows"):
        wrong.append("no flows")
    for f in doc.get("flows") or []:
        wrong += _extra(f"flow {f.get('name')}", f, {"name", "restores", "default", "by_type"})
        flow = Flow(str(f.get("name") or ""), str(f.get("default") or ""), {str(k): str(v) for k, v in (f.get("by_type") or {}).items()}, bool(f.get("restores", False)))
        found = out.problems(flow)
        wrong += found
        used |= {flow.default, *flow.by_type.values()}
        if not found:
            out.add(flow)
    if not has_keys and used & {"hash", "tokenize"}:
        wrong.append("hash and tokenize need keys")
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def load_rules(path: str | Path) -> list[R.Recognizer]:
    """Tenant rules from a YAML file or, in order of their names, those of a folder; all problems are reported together."""
    path, out, wrong = Path(path), [], []
    files = sorted(p for p in path.rglob("*") if p.suffix in (".yaml", ".yml")) if path.is_dir() else [path]
    for file in files:
        try:
            doc = _yaml(file)
        except ValueError as e:
            wrong.append(f"{file.name}: {e}")
            continue
        wrong += [f"{file.name}: {x}" for x in _extra("file", doc, {"version", "tenant", "rules"})] + ([f"{file.name}: version is not 1"] if doc.get("version") != 1 else [])
        for rule in doc.get("rules") or []:
            try:
                out.append(R.tenant_rule(rule))
            except (ValueError, KeyError, TypeError) as e:
                wrong.append(f"{file.name}: {rule.get('name')}: {e}")
    names = [r.name for r in out]
    wrong += [f"a name twice: {n}" for n in sorted({n for n in names if names.count(n) > 1})]
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def redact_to(texts: DataFrame, entities: DataFrame, matrix: Matrix, ring: Keyring, order: str = "seq", types: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts redacted as their destination asks, the vault of placeholders, and the values behind tokens.

    ``texts``: doc_id, tenant, session, ``order``, destination, text.  ``entities``: resolved spans.  A destination that
    no flow names, or a value that its operator can't rewrite, blocks the row: text null, ``error_class`` says why.
    The vault (tenant, session, type, value, idx, placeholder) numbers masked values by first appearance; the tokens
    (tenant, namespace, value) are to be issued with ``tokens.issue`` before the texts leave.
    """
    spark, o = texts.sparkSession, matrix.options
    rules = F.broadcast(matrix.frame(spark))
    spans = entities.filter(F.col("type").isin(*types)) if types else entities
    own = spans.join(texts.select("doc_id", "tenant", "session", order, "destination"), "doc_id")
    exact = rules.filter("type is not null").select("destination", "type", F.col("strategy").alias("own_op"))
    default = rules.filter("type is null").select("destination", F.col("strategy").alias("default_op"))
    own = own.join(exact, ["destination", "type"], "left").join(default, "destination").withColumn("op", F.coalesce("own_op", "default_op"))
    words = [(k.strip(), k.strip().lower(), v) for k, v in matrix.ontology.items()]
    onto = F.broadcast(spark.createDataFrame(words, "term string, low string, wide string"))
    own = own.join(onto.select(F.lower(F.trim("low")).alias("low"), "wide"), F.lower(F.trim(F.col("value"))) == F.col("low"), "left")
    general = F.coalesce(F.expr(f"nullif({W.generalized(SPARK, o.granularity == 'year')}, '')"), F.col("wide"))
    op = F.when((F.col("op") == "generalize") & general.isNull(), o.fallback).otherwise(F.col("op"))
    own = own.withColumn("wide", general).withColumn("op", op)
    vault = W.vault(own.filter("op = 'mask'"), ["tenant", "session"], [order, "start"])
    keys = F.broadcast(ring.frame(spark, T.tenants_of(texts)))
    own = own.join(vault.drop("idx"), ["tenant", "session", "type", "value"], "left").join(keys, "tenant").withColumn("namespace", F.lower("type"))
    new = F.expr(f"""case op when 'mask' then placeholder when 'drop' then '' when 'generalize' then wide when 'char_mask' then {W.char_mask(o.char, o.keep)}
        when 'hash' then '[hash:' || namespace || ':' || left({hmac_under("(type || char(0) || value)", "own_in", "own_out")}, {o.digits}) || ']'
        when 'tokenize' then '[tok:' || namespace || ':' || {T.token_id()} || ']' end""")
    done = W.splice(texts.select("doc_id", "text"), own.select("doc_id", "start", "end", new.alias("replacement")))
    known = default.withColumn("known", F.lit(True)).select("destination", "known")
    out = texts.drop("text").join(done, "doc_id").join(known, "destination", "left")
    fine = F.col("known") & (F.col("status") == "ok")
    why = F.when(F.col("known").isNull(), "unknown_destination").when(F.col("status") != "ok", "strategy")
    out = out.select(*(F.col(c) for c in texts.columns if c != "text"), F.when(fine, F.col("redacted")).alias("redacted"), "n_entities", F.when(fine, "ok").otherwise("blocked").alias("status"), why.alias("error_class"))
    return out, vault, own.filter("op = 'tokenize'").select("tenant", "namespace", "value").distinct()
