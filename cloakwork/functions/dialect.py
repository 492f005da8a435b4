"""Scalar SQL in two dialects: the engine's own, and the one its results are checked against."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Letters of either case; cheaper than the engine's own mapping, which asks for the language's rules.
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def name(self, column: str) -> str:
        return f"`{column}`" if self.spark else f'"{column}"'

    def lam(self, names: str, body: str) -> str:
        return f"({names}) -> {body}" if self.spark else f"lambda {names}: {body}"

    def total(self, count: str, term: str) -> str:
        """Sum of ``term`` for i from 1 to ``count``, a positive number."""
        if self.spark:
            return f"aggregate(sequence(1, {count}), 0L, (acc, i) -> acc + cast({term} as bigint))"
        return f"cast(list_sum(list_transform(range(1, {count} + 1), lambda i: cast({term} as bigint))) as bigint)"

    def fold(self, count: str, value: str, start: int, step: str) -> str:
        """Left fold over ``value`` for i from 1 to ``count``: ``step`` of acc and x."""
        if self.spark:
            return f"aggregate(transform(sequence(1, {count}), i -> cast({value} as bigint)), {start}L, (acc, x) -> cast({step} as bigint))"
        return f"list_reduce(list_prepend({start}::bigint, list_transform(range(1, {count} + 1), lambda i: cast({value} as bigint))), lambda acc, x: cast({step} as bigint))"

    def bytes(self, x: str) -> str:
        return f"octet_length({x})" if self.spark else f"strlen({x})"

    def shortest(self, side: str, text: str, size: int) -> str:
        """The shortest suffix (right) or prefix (left) of ``text`` with ``size`` bytes at least, else all of it."""
        test = f"{self.bytes(f'{side}({text}, k)')} >= {size}"
        k = f"array_min(filter(sequence(1, {size}), k -> {test}))" if self.spark else f"list_min(list_filter(range(1, {size + 1}), lambda k: {test}))"
        return f"{side}({text}, cast(coalesce({k}, {size}) as int))"

    def matches(self, text: str, pattern: str) -> str:
        p = pattern.replace("'", "''") if not self.spark else pattern.replace("'", "\\'")
        return f"regexp_extract_all({text}, {self.raw(p)}, 0)" if self.spark else f"regexp_extract_all({text}, '{p}', 0)"

    def raw(self, p: str) -> str:
        return f"r'{p}'" if self.spark else f"'{p}'"

    def test(self, text: str, pattern: str) -> str:
        return f"({text} rlike {self.raw(pattern)})" if self.spark else f"regexp_matches({text}, {self.raw(pattern)})"

    def any_word(self, text: str, words) -> str:
        """Whether one of the words stands in ``text``, in letters of either case."""
        plain = "|".join(re.sub(r"([.+*?()\[\]{}|^$\\])", r"\\\1", w.lower()) for w in words)
        return self.test(text, f"(?i)(?:{plain})")

    def count(self, text: str, pattern: str) -> str:
        return f"regexp_count({text}, {self.raw(pattern)})" if self.spark else f"len(regexp_extract_all({text}, {self.raw(pattern)}))"

    def script(self, name: str) -> str:
        return rf"\p{{Is{name}}}" if self.spark else rf"\p{{{name}}}"


SPARK, DUCK = Dialect(True), Dialect(False)
