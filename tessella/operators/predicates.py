"""Predicates, casts and conditionals that need more than a Spark operator."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def eq(a, b) -> Column:
    return _col(a) == _col(b)


def ne(a, b) -> Column:
    return _col(a) != _col(b)


def between(e: Column, low, high) -> Column:
    return e.between(_col(low), _col(high))


def not_between(e: Column, low, high) -> Column:
    return ~between(e, low, high)


def between_symmetric(e: Column, a, b) -> Column:
    """BETWEEN with bounds in either order; unknown if a bound is NULL."""
    a, b = _col(a), _col(b)
    return F.when(a.isNotNull() & b.isNotNull(), e.between(F.least(a, b), F.greatest(a, b)))


def in_(e: Column, options) -> Column:
    """IN over a non-empty list of values."""
    options = list(options)
    if not options:
        raise ValueError("IN needs at least one value")
    return e.isin(*options)


def is_distinct_from(a, b) -> Column:
    return ~_col(a).eqNullSafe(_col(b))


def is_not_distinct_from(a, b) -> Column:
    return _col(a).eqNullSafe(_col(b))


def like(e: Column, pattern: str) -> Column:
    return e.like(pattern)


def ilike(e: Column, pattern: str) -> Column:
    return e.ilike(pattern)


def similar_regex(pattern: str) -> str:
    """The Java regular expression of a SIMILAR TO pattern, unanchored."""
    out, in_class, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        elif in_class:
            in_class = c != "]"
            out.append("\\[" if c == "[" else c)
        elif c == "[":
            in_class = True
            out.append(c)
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        else:
            out.append("\\" + c if c in ".^$" else c)
        at += 1
    return "".join(out)


def similar_to(e: Column, pattern: str) -> Column:
    """SQL regular expression over the whole text."""
    return e.rlike(rf"(?s)\A(?:{similar_regex(pattern)})\z")


def not_similar_to(e: Column, pattern: str) -> Column:
    return ~similar_to(e, pattern)


class Case:
    """CASE WHEN ... THEN ...; ``otherwise`` or ``end`` (NULL) closes it."""

    def __init__(self, condition: Column, value):
        self._column = F.when(condition, _col(value))

    def when(self, condition: Column, value) -> Case:
        out = Case.__new__(Case)
        out._column = self._column.when(condition, _col(value))
        return out

    def otherwise(self, value) -> Column:
        return self._column.otherwise(_col(value))

    def end(self) -> Column:
        return self._column


def case_when(condition: Column, value) -> Case:
    return Case(condition, value)


def cast(e: Column, target: str, of: str | None = None) -> Column:
    """A cast that rounds fractions to integers: half to even from doubles (``of='double'``), away from zero from decimals."""
    if target in ("short", "int", "bigint", "long", "smallint", "integer") and of in ("double", "float"):
        return F.rint(e).cast(target)
    if target in ("short", "int", "bigint", "long", "smallint", "integer") and of and of.startswith("decimal"):
        return F.round(e).cast(target)
    return e.cast(target)


_LOW_IS_ENOUGH = {"<": False, "<=": False, ">": True, ">=": True}
_COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def quantified(df: DataFrame, e: Column, op: str, sub: DataFrame, every: bool, name: str) -> DataFrame:
    """``df`` with ``e op ANY (sub)``, or ALL if ``every``, as column ``name``; ``sub`` has one column.

    The comparison depends on the subquery's count, least or greatest value and on whether it has a NULL, so
    one aggregated row joins every row, whatever the subquery's size.
    """
    (own,) = sub.columns
    y = F.col(own)
    use_min = _LOW_IS_ENOUGH[op] != every
    row = sub.agg(F.count(F.lit(1)).alias("_n"), (F.min(y) if use_min else F.max(y)).alias("_m"), F.coalesce(F.bool_or(y.isNull()), F.lit(False)).alias("_hn"))
    holds = _COMPARE[op](e, F.col("_m"))
    unknown = e.isNull() | F.col("_hn")
    if every:
        value = F.when(F.col("_n") == 0, True).when(~holds, False).when(unknown, F.lit(None).cast("boolean")).otherwise(True)
    else:
        value = F.when(F.col("_n") == 0, False).when(holds, True).when(unknown, F.lit(None).cast("boolean")).otherwise(False)
    return df.join(F.broadcast(row)).withColumn(name, value).drop("_n", "_m", "_hn")  # the row is one
