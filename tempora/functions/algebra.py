"""What the connectives and windows mean in each output domain, as Column builders.

``bool``: truth; ``rob``: robustness (a double, positive if true); ``witness``: robustness with the time of
the sample that decides it.  Intervals of robustness (``rosi``) are pairs of ``rob`` columns.  Null means no
value; NaN becomes null where traces are read.

A further domain is a class like these, given in place of a name.  Its values may be of any type that
Spark orders: windows take the least and the greatest, connectives the lesser and the greater.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


class Truth:
    name, sql_type = "bool", "boolean"

    @staticmethod
    def compare(x: Column, op: str, c: Column) -> Column:
        return x > c if op == ">" else x < c

    @staticmethod
    def constant(value: bool) -> Column:
        return F.lit(value)

    @staticmethod
    def negate(a: Column) -> Column:
        return ~a

    @staticmethod
    def both(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), a & b)

    @staticmethod
    def either(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), a | b)

    least, greatest = staticmethod(F.min), staticmethod(F.max)  # false < true


class Robustness:
    name, sql_type = "rob", "double"

    @staticmethod
    def compare(x: Column, op: str, c: Column) -> Column:
        return x - c if op == ">" else c - x

    @staticmethod
    def constant(value: bool) -> Column:
        return F.lit(INF if value else -INF)

    @staticmethod
    def negate(a: Column) -> Column:
        return -a

    @staticmethod
    def both(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))

    @staticmethod
    def either(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))

    least, greatest = staticmethod(F.min), staticmethod(F.max)


class Witness(Robustness):
    """(v, at): robustness, and the time of the sample that it comes from; null if it comes from none.

    Of equal values the least is that of the earliest sample, and the greatest that of the latest.
    """

    name, sql_type = "witness", "struct<v:double,at:bigint>"

    @staticmethod
    def _of(v: Column, at: Column) -> Column:
        return F.struct(v.alias("v"), at.alias("at"))

    @staticmethod
    def compare(x: Column, op: str, c: Column) -> Column:
        return Witness._of(Robustness.compare(x, op, c), F.col("t_us"))

    @staticmethod
    def constant(value: bool) -> Column:
        return Witness._of(Robustness.constant(value), F.lit(None).cast("long"))

    @staticmethod
    def negate(a: Column) -> Column:
        return F.when(a.isNotNull(), Witness._of(-a["v"], a["at"]))


DOMAINS = {d.name: d for d in (Truth, Robustness, Witness)}
