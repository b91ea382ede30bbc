"""Formulas from text: ``G[0,10](x > 5) -> F[0,3](y < $limit)``.

Precedence from loose to tight: implies (groups to the right), or, and, until, prefix operators.
Intervals are seconds, closed at both ends.  The text is turned into the objects of ``formula``.
"""

from __future__ import annotations

import re

from tempora.plans import formula as f

_TOKEN = re.compile(r"\s*(?:(?P<num>-?(?:\d+\.?\d*|\.\d+))|(?P<name>[A-Za-z_]\w*)|(?P<sym>->|>=|<=|==|&&|\|\||[()\[\],<>!$]))")
_WORDS = {"&&": "and", "||": "or", "->": "implies", "!": "not", "U": "until", "G": "globally", "F": "eventually"}


class FormulaError(ValueError):
    """Text that is not a formula; ``position`` counts characters from 0."""

    def __init__(self, message: str, position: int):
        super().__init__(f"Parse error at position {position}: {message}")
        self.message, self.position = message, position


class _Reader:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                at += len(text[at:]) - len(text[at:].lstrip())
                raise FormulaError(f"unexpected {text[at]!r}", at)
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            at = m.end()
        self.tokens.append(("end", "end of input", len(text)))
        self.i = 0

    def peek(self, ahead: int = 0) -> str:
        kind, text, _ = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return _WORDS.get(text, text) if kind != "num" else "number"

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted:
            self.i += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise FormulaError(f"expected {wanted!r}, found {self.tokens[self.i][1]!r}", self.tokens[self.i][2])

    def number(self) -> float:
        kind, text, at = self.tokens[self.i]
        if kind != "num":
            raise FormulaError(f"expected a number, found {text!r}", at)
        self.i += 1
        return float(text)

    def interval(self) -> tuple[float, float]:
        at = self.tokens[self.i][2]
        self.need("[")
        start = self.number()
        self.need(",")
        end = self.number()
        self.need("]")
        if start < 0 or end < start:
            raise FormulaError("an interval has 0 <= start <= end", at)
        return start, end

    def implication(self) -> f.Formula:
        left = self.chain(0)
        return f.Implies(left, self.implication()) if self.take("implies") else left

    def chain(self, level: int) -> f.Formula:
        if level == 3:
            return self.prefixed()
        word, make = (("or", f.Or), ("and", f.And), ("until", None))[level]
        out = self.chain(level + 1)
        while self.peek() == word and (make or self.peek(1) == "["):
            self.i += 1
            if make:
                out = make(out, self.chain(level + 1))
            else:
                bounds = self.interval()
                out = f.until(*bounds, out, self.chain(level + 1))
        return out

    def prefixed(self) -> f.Formula:
        if self.take("not"):
            return f.Not(self.prefixed())
        if self.peek() in ("globally", "eventually") and self.peek(1) == "[":
            make = f.always if self.peek() == "globally" else f.eventually
            self.i += 1
            bounds = self.interval()
            return make(*bounds, self.prefixed())
        if self.take("("):
            inner = self.implication()
            self.need(")")
            return inner
        kind, name, at = self.tokens[self.i]
        if kind != "name":
            raise FormulaError(f"unexpected {name!r}", at)
        self.i += 1
        if name in ("true", "false"):
            return f.Constant(name == "true")
        return self.comparison(name)

    def comparison(self, signal: str) -> f.Formula:
        _, op, at = self.tokens[self.i]
        if not self.take(">", "<", ">=", "<=", "=="):
            raise FormulaError(f"expected a comparison after {signal!r}, found {op!r}", at)
        dollar = self.take("$")
        kind, text, at = self.tokens[self.i]
        if kind == "name":
            limit: float | str = text
            self.i += 1
        elif dollar:
            raise FormulaError(f"expected a variable name, found {text!r}", at)
        else:
            limit = self.number()
        make = {">": lambda s, c: f.Compare(s, ">", c), "<": lambda s, c: f.Compare(s, "<", c), ">=": f.ge, "<=": f.le, "==": f.eq}
        return make[op](signal, limit)


def formula(text: str) -> f.Formula:
    """The formula that a text stands for; FormulaError if it is none."""
    reader = _Reader(text)
    out = reader.implication()
    if reader.peek() != "end of input":
        _, found, at = reader.tokens[reader.i]
        raise FormulaError(f"unexpected {found!r} after the formula", at)
    return out
