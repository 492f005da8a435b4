"""Personal data: patterns propose spans, check digits confirm them, nearby words move the score."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import IBAN_LENGTHS
from .common import map_batches, texts

#: Fixed by the query's contract.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "tel", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The method's own kinds.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
IBAN_REST = {x[:2]: re.compile(rf"(?:\x20?[A-Z0-9]){{{int(x[2:]) - 4}}}(?![A-Za-z0-9])") for x in IBAN_LENGTHS.split()}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
TOLL = re.compile(r"\+[0-9]{1,3}(?:[\x20.-]?\([0-9]{1,4}\)|[\x20.-]?[0-9]{2,4}){2,4}(?![0-9])")
NATIONAL = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])")
#: Secrets, each pattern with what any text that holds one must hold; group 1 is the secret.
SECRETS = (
    (("=", ":"), re.compile(r"(?<![A-Za-z0-9])(?i:token|secret|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key)[\"']?\x20?[=:]\x20?[\"']?([A-Za-z0-9_./+-]{16,})")),
    (("=", ":"), re.compile(r"(?<![A-Za-z0-9])(?i:password|passwd|passphrase|pwd)[\"']?\x20?[=:]\x20?[\"']?((?=[^\s\"']{0,32}[0-9!@#$%^&*])[^\s\"']{6,})")),
    (("AKIA", "ASIA"), re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])")),
    (("gh",), re.compile(r"(?<![A-Za-z0-9_])(gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{22,})")),
    (("sk-", "xox", "AIza"), re.compile(r"(?<![A-Za-z0-9_-])(sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})")),
    (("eyJ",), re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")),
    (("earer", "EARER"), re.compile(r"(?<![A-Za-z0-9])(?i:bearer)\x20+([A-Za-z0-9._~+/-]{16,})")),
    (("://",), re.compile(r"://[^\s/@:]{0,128}:([^\s/@]{1,256})@")),
)
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----")
PEM_END = re.compile(r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----")
DIGIT = re.compile("[0-9]")
#: Words that speak for a kind when they stand near, and that speak against.
FOR = {
    "email": ("mail", "contact", "address"), "ip": ("ip", "host", "server", "address", "client"), "card": ("card", "credit", "visa", "payment", "debit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"), "ssn": ("ssn", "social", "security"), "tel": ("phone", "tel", "call", "mobile", "fax", "telephone", "contact"), "secret": (),
}
AGAINST = ("version", "release", "order", "invoice", "isbn", "serial", "example")
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.35, "tel": 0.4, "secret": 0.8}


@dataclass(frozen=True)
class Settings:
    """``near``: characters on either side searched for context words, each worth ``step``.
    ``foreign``: what a telephone number gains by its country code.
    Spans of the method's own kinds need ``least``; base spans stay whatever their score."""

    near: int = 48
    step: float = 0.15
    foreign: float = 0.2
    least: float = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def mod97(value: str) -> bool:
    flat = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Numbers of their country's length that pass mod 97; what follows them is left out."""
    free = 0
    for m in IBAN.finditer(text):
        rest = IBAN_REST.get(m[0][:2]) if m.start() >= free else None
        end = rest.match(text, m.end()) if rest else None
        if end and mod97(text[m.start() : end.end()]):
            free = end.end()
            yield m.start(), free


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Credentials by the words or prefixes that mark them; spans that overlap come as one."""
    found = [m.span(1) for needs, pattern in SECRETS if any(x in text for x in needs) for m in pattern.finditer(text)]
    if "PRIVATE KEY" in text:
        ends = [m.end() for m in PEM_END.finditer(text)]
        for m in PEM.finditer(text):
            i = bisect.bisect(ends, m.end())
            found.append((m.start(), ends[i] if i < len(ends) else m.end()))
    start = end = -1
    for a, b in sorted(found):
        if a >= end:
            if end > 0:
                yield start, end
            start, end = a, b
        end = max(end, b)
    if end > 0:
        yield start, end


def telephones(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """National forms, and international ones that the base pattern lost in what follows them."""
    spans = sorted((a, b) for k, a, b in taken if k in ("phone", "card"))
    busy = {a for k, a, _ in taken if k == "phone"}
    if "+" in text:
        for m in TOLL.finditer(text):
            if m.start() not in busy and 8 <= len(DIGIT.findall(m[0])) <= 15:
                yield m.span()
    for m in NATIONAL.finditer(text):
        i = bisect.bisect(spans, (m.start(), len(text))) - 1
        if i < 0 or spans[i][1] <= m.start():
            yield m.span()


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: a run without @ is passed only once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))


def _score(kind: str, start: int, end: int, text: str, s: Settings) -> float:
    around = (text[max(0, start - s.near) : start] + " " + text[end : end + s.near]).lower()
    near = re.findall(r"[^\W\d_]+", around)
    plus, minus = sum(w in FOR[kind] for w in near), sum(w in AGAINST for w in near)
    base = BASE_SCORE[kind] + (s.foreign if kind == "tel" and text[start] == "+" else 0.0)
    return min(1.0, max(0.0, base + s.step * (plus - minus)))


def find(text: str, s: Settings = Settings()) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; places are code points."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m[0].split("."))] if "." in text else []
        for m in CARD.finditer(text):
            if m.end() - m.start() > 15 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
        out += [("iban", a, b) for a, b in ibans(text)]
        if "-" in text:
            out += [("ssn", *m.span()) for m in SSN.finditer(text)]
        out += [("tel", a, b) for a, b in sorted(telephones(text, out))]
    out += [("secret", a, b) for a, b in secrets(text)]
    scored = [(k, a, b, _score(k, a, b, text, s)) for k, a, b in out]
    return [x for x in scored if x[0] in BASE or x[3] >= s.least]


def _find(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for batch in batches:
        got = [[dict(zip(("kind", "start", "end", "score"), x)) for x in find(t, s)] for t in texts(batch, "text")]
        joined = [",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in row) for row in got]
        base = [",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in row if x["kind"] in BASE) for row in got]
        marks = [",".join(f"{x['score']:.2f}" for x in row) for row in got]
        counts = [pa.array([sum(x["kind"] == k for x in row) for row in got], pa.int64()) for k in BASE]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array(joined, pa.string()), pa.array(marks, pa.string()), pa.array(got, kind)], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores", "found"])


def detect(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, their digest, all spans, their scores in the same order, and ``found`` with both.

    Null texts are empty; a null id stays null; rows that repeat an id get a row each; whole texts are read however
    long; other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, scores string, found array<struct<kind: string, start: int, end: int, score: double>>"
    return map_batches(rows, _find, schema, settings)
