"""Formulas of bounded signal temporal logic, as immutable values.

Bounds are seconds, kept as whole microseconds.  Equal subformulas are equal (and hash equally),
which is how the compiler shares their columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass


def microseconds(seconds: float) -> int:
    us = round(seconds * 1_000_000)
    if abs(us - seconds * 1_000_000) > 1e-3:
        raise ValueError(f"{seconds} s is finer than a microsecond")
    return us


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


@dataclass(frozen=True)
class Formula:
    """Base of all formulas; ``&``, ``|``, ``~`` and ``>>`` build and, or, not and implies."""

    def __and__(self, other: Formula) -> Formula:
        return And(self, other)

    def __or__(self, other: Formula) -> Formula:
        return Or(self, other)

    def __invert__(self) -> Formula:
        return Not(self)

    def __rshift__(self, other: Formula) -> Formula:
        return Implies(self, other)

    @property
    def parts(self) -> tuple[Formula, ...]:
        return ()

    def walk(self) -> Iterator[Formula]:
        """Each distinct subformula once, parts before what holds them."""
        seen: dict[Formula, None] = {}

        def visit(f: Formula) -> None:
            if f not in seen:
                for p in f.parts:
                    visit(p)
                seen[f] = None

        visit(self)
        return iter(seen)

    def signals(self) -> list[str]:
        return sorted({f.signal for f in self.walk() if isinstance(f, Compare)})

    def variables(self) -> list[str]:
        return sorted({f.limit for f in self.walk() if isinstance(f, Compare) and isinstance(f.limit, str)})

    def depth(self) -> int:
        """Microseconds after t that the value at t may depend on."""
        return max((p.depth() for p in self.parts), default=0)

    def label(self) -> str:
        raise NotImplementedError

    def tree(self, indent: int = 0) -> str:
        lines = [" " * indent + self.label()]

        def branch(f: Formula, lead: str) -> None:
            for k, p in enumerate(f.parts):
                last = k == len(f.parts) - 1
                lines.append(lead + ("└── " if last else "├── ") + p.label())
                branch(p, lead + ("    " if last else "│   "))

        branch(self, " " * (indent + 4))
        return "\n".join(lines)


@dataclass(frozen=True)
class Constant(Formula):
    value: bool

    def label(self) -> str:
        return str(self.value)

    __str__ = label


TRUE, FALSE = Constant(True), Constant(False)


@dataclass(frozen=True)
class Compare(Formula):
    """signal > limit or signal < limit; a limit that is a string names a variable."""

    signal: str
    op: str
    limit: float | str

    def label(self) -> str:
        return f"{self.signal} {self.op} " + (f"${self.limit}" if isinstance(self.limit, str) else _number(self.limit))

    __str__ = label


@dataclass(frozen=True)
class Not(Formula):
    part: Formula

    @property
    def parts(self):
        return (self.part,)

    def label(self) -> str:
        return "Not"

    def __str__(self) -> str:
        return f"¬({self.part})"


@dataclass(frozen=True)
class Pair(Formula):
    left: Formula
    right: Formula

    @property
    def parts(self):
        return (self.left, self.right)

    def label(self) -> str:
        return type(self).__name__

    def __str__(self) -> str:
        return f"({self.left}) {self.sign} ({self.right})"


class And(Pair):
    sign = "∧"


class Or(Pair):
    sign = "v"


class Implies(Pair):
    sign = "→"


@dataclass(frozen=True)
class Timed(Formula):
    start: int  # microseconds
    end: int

    def __post_init__(self):
        if self.start < 0 or self.end < self.start:
            raise ValueError(f"not an interval: [{self.start / 1e6:g}, {self.end / 1e6:g}]")

    def bounds(self) -> tuple[str, str]:
        return _number(self.start / 1e6), _number(self.end / 1e6)

    def depth(self) -> int:
        return self.end + super().depth()

    def label(self) -> str:
        return "{}[{},{}]".format(type(self).__name__, *self.bounds())


@dataclass(frozen=True)
class Sweep(Timed):
    part: Formula

    @property
    def parts(self):
        return (self.part,)

    def __str__(self) -> str:
        return "{}[{}, {}]({})".format(self.letter, *self.bounds(), self.part)


class Globally(Sweep):
    letter = "G"


class Eventually(Sweep):
    letter = "F"


@dataclass(frozen=True)
class Until(Timed):
    left: Formula
    right: Formula

    @property
    def parts(self):
        return (self.left, self.right)

    def __str__(self) -> str:
        return "({}) U[{}, {}] ({})".format(self.left, *self.bounds(), self.right)


# -- builders -------------------------------------------------------------------------


def gt(signal: str, limit: float) -> Formula:
    return Compare(signal, ">", float(limit))


def lt(signal: str, limit: float) -> Formula:
    return Compare(signal, "<", float(limit))


def gt_var(signal: str, name: str) -> Formula:
    return Compare(signal, ">", name)


def lt_var(signal: str, name: str) -> Formula:
    return Compare(signal, "<", name)


def ge(signal: str, limit: float | str) -> Formula:
    return Not(Compare(signal, "<", limit if isinstance(limit, str) else float(limit)))


def le(signal: str, limit: float | str) -> Formula:
    return Not(Compare(signal, ">", limit if isinstance(limit, str) else float(limit)))


def eq(signal: str, limit: float | str) -> Formula:
    return And(ge(signal, limit), le(signal, limit))


def true_() -> Formula:
    return TRUE


def false_() -> Formula:
    return FALSE


def not_(f: Formula) -> Formula:
    return Not(f)


def and_(a: Formula, b: Formula) -> Formula:
    return And(a, b)


def or_(a: Formula, b: Formula) -> Formula:
    return Or(a, b)


def implies(a: Formula, b: Formula) -> Formula:
    return Implies(a, b)


def always(start: float, end: float, f: Formula) -> Formula:
    return Globally(microseconds(start), microseconds(end), f)


def eventually(start: float, end: float, f: Formula) -> Formula:
    return Eventually(microseconds(start), microseconds(end), f)


def until(start: float, end: float, left: Formula, right: Formula) -> Formula:
    return Until(microseconds(start), microseconds(end), left, right)


# -- rewriting ------------------------------------------------------------------------


def lowered(f: Formula) -> Formula:
    """Implications as ``or not``, and constants folded through ``not``; others stay, as they close with their windows."""
    memo: dict[Formula, Formula] = {}
    for g in f.walk():
        p = [memo[x] for x in g.parts]
        if isinstance(g, Not):
            out = Constant(not p[0].value) if isinstance(p[0], Constant) else Not(p[0])
        elif isinstance(g, Implies):
            out = Or(Not(p[0]), p[1])
        elif isinstance(g, (And, Or)):
            out = type(g)(*p)
        elif isinstance(g, Sweep):
            out = type(g)(g.start, g.end, p[0])
        elif isinstance(g, Until):
            out = Until(g.start, g.end, *p)
        else:
            out = g
        memo[g] = out
    return memo[f]
