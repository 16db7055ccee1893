"""Range values as structs (lower, upper, lower_inc, upper_inc, is_empty); a NULL bound is unbounded.

All constructors canonicalise: discrete ranges become ``[lower, upper)``, ranges without a point become empty,
a lower bound above the upper raises, an unbounded side is exclusive.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kind of range: Spark type of its bounds and whether it is discrete.
KINDS = {"int4range": ("int", True), "int8range": ("bigint", True), "numrange": ("decimal(38,10)", False), "daterange": ("date", True), "tsrange": ("timestamp_ntz", False), "tstzrange": ("timestamp", False)}


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _next(e: Column, kind: str) -> Column:
    return F.date_add(e, 1) if kind == "daterange" else e + F.lit(1).cast(KINDS[kind][0])


def _struct(kind: str, lower, upper, lower_inc, upper_inc, empty) -> Column:
    t = KINDS[kind][0]
    blank = lambda e: F.when(~empty, e)
    return F.struct(
        blank(lower).cast(t).alias("lower"), blank(upper).cast(t).alias("upper"),
        (~empty & lower_inc & lower.isNotNull()).alias("lower_inc"), (~empty & upper_inc & upper.isNotNull()).alias("upper_inc"), empty.alias("is_empty"),
    )


def make(kind: str, lower, upper, lower_inc: Column, upper_inc: Column) -> Column:
    """A canonical range from bounds and whether they belong to it."""
    t, discrete = KINDS[kind]
    lower, upper = _col(lower).cast(t), _col(upper).cast(t)
    wrong = lower > upper
    lower = F.when(wrong, F.raise_error("range lower bound must be less than or equal to range upper bound").cast(t)).otherwise(lower)
    if discrete:
        lower = F.when(lower_inc, lower).otherwise(_next(lower, kind))
        upper = F.when(upper_inc, _next(upper, kind)).otherwise(upper)
        return _struct(kind, lower, upper, F.lit(True), F.lit(False), F.coalesce(lower >= upper, F.lit(False)))
    empty = F.coalesce((lower == upper) & ~(lower_inc & upper_inc), F.lit(False))
    return _struct(kind, lower, upper, lower_inc, upper_inc, empty)


def _constructor(kind: str):
    def build(lower, upper, bounds: str = "[)") -> Column:
        if bounds not in ("[]", "[)", "(]", "()"):
            raise ValueError(f"invalid range bound flags {bounds!r}")
        return make(kind, lower, upper, F.lit(bounds[0] == "["), F.lit(bounds[1] == "]"))

    build.__doc__ = f"A {kind}; ``bounds`` is one of [], [), (] and ()."
    return build


int4range, int8range, numrange = _constructor("int4range"), _constructor("int8range"), _constructor("numrange")
daterange, tsrange, tstzrange = _constructor("daterange"), _constructor("tsrange"), _constructor("tstzrange")


def empty(kind: str) -> Column:
    none = F.lit(None).cast(KINDS[kind][0])
    return _struct(kind, none, none, F.lit(False), F.lit(False), F.lit(True))


def lower_le(a: Column, b: Column) -> Column:
    """Whether the lower bound of ``a`` is at or before that of ``b``."""
    x, y = a["lower"], b["lower"]
    return F.when(x.isNull(), True).when(y.isNull(), False).otherwise((x < y) | ((x == y) & (a["lower_inc"] | ~b["lower_inc"])))


def upper_le(a: Column, b: Column) -> Column:
    """Whether the upper bound of ``a`` is at or before that of ``b``."""
    x, y = a["upper"], b["upper"]
    return F.when(y.isNull(), True).when(x.isNull(), False).otherwise((x < y) | ((x == y) & (b["upper_inc"] | ~a["upper_inc"])))


def _before(a: Column, b: Column) -> Column:
    """Whether the upper bound of ``a`` lies before the lower bound of ``b``."""
    x, y = a["upper"], b["lower"]
    return F.when(x.isNull() | y.isNull(), False).otherwise((x < y) | ((x == y) & ~(a["upper_inc"] & b["lower_inc"])))


def _known(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def contains(a: Column, b: Column) -> Column:
    return _known(a, b, b["is_empty"] | (~a["is_empty"] & lower_le(a, b) & upper_le(b, a)))


def contained_by(a: Column, b: Column) -> Column:
    return contains(b, a)


def _both(a: Column, b: Column, value: Column) -> Column:
    """``value`` where neither is empty, else false."""
    return _known(a, b, ~a["is_empty"] & ~b["is_empty"] & value)


def overlaps(a: Column, b: Column) -> Column:
    return _both(a, b, ~_before(a, b) & ~_before(b, a))


def strictly_left(a: Column, b: Column) -> Column:
    return _both(a, b, _before(a, b))


def strictly_right(a: Column, b: Column) -> Column:
    return _both(a, b, _before(b, a))


def does_not_extend_right(a: Column, b: Column) -> Column:
    return _both(a, b, upper_le(a, b))


def does_not_extend_left(a: Column, b: Column) -> Column:
    return _both(a, b, lower_le(b, a))


def _touch(a: Column, b: Column) -> Column:
    """Whether ``b`` begins where ``a`` ends, the point between belonging to one of them."""
    return F.coalesce((a["upper"] == b["lower"]) & (a["upper_inc"] != b["lower_inc"]), F.lit(False))


def adjacent(a: Column, b: Column) -> Column:
    return _both(a, b, _touch(a, b) | _touch(b, a))


def _pick(which: Column, a: Column, b: Column, side: str) -> tuple[Column, Column]:
    return F.when(which, a[side]).otherwise(b[side]), F.when(which, a[f"{side}_inc"]).otherwise(b[f"{side}_inc"])


def _from(kind: str, lower: tuple, upper: tuple) -> Column:
    t = KINDS[kind][0]
    return make(kind, lower[0].cast(t), upper[0].cast(t), lower[1], upper[1])


def union(kind: str, a: Column, b: Column) -> Column:
    """``a + b``; raises if a gap lies between them."""
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda x: _union(kind, x["a"], x["b"]))


def _union(kind: str, a: Column, b: Column) -> Column:
    joined = _from(kind, _pick(lower_le(a, b), a, b, "lower"), _pick(upper_le(b, a), a, b, "upper"))
    gap = ~(overlaps(a, b) | adjacent(a, b))
    checked = F.when(gap, F.raise_error("result of range union would not be contiguous").cast("boolean")).otherwise(True)
    return _known(a, b, F.when(a["is_empty"], b).when(b["is_empty"], a).when(checked, joined))


def intersect(kind: str, a: Column, b: Column) -> Column:
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda x: _intersect(kind, x["a"], x["b"]))


def _intersect(kind: str, a: Column, b: Column) -> Column:
    shared = _from(kind, _pick(lower_le(b, a), a, b, "lower"), _pick(upper_le(a, b), a, b, "upper"))
    return _known(a, b, F.when(overlaps(a, b), shared).otherwise(empty(kind)))


def difference(kind: str, a: Column, b: Column) -> Column:
    """``a - b``; raises if ``b`` would split ``a``."""
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda x: _difference(kind, x["a"], x["b"]))


def _difference(kind: str, a: Column, b: Column) -> Column:
    left = lower_le(a, b) & ~lower_le(b, a)  # a starts before b
    right = upper_le(b, a) & ~upper_le(a, b)  # a ends after b
    head = _from(kind, (a["lower"], a["lower_inc"]), (b["lower"], ~b["lower_inc"]))
    tail = _from(kind, (b["upper"], ~b["upper_inc"]), (a["upper"], a["upper_inc"]))
    split = F.raise_error("result of range difference would not be contiguous").cast("boolean")
    return _known(
        a, b,
        F.when(~overlaps(a, b), a)
        .when(F.when(left & right, split).otherwise(F.lit(False)), a)
        .when(left, head).when(right, tail).otherwise(empty(kind)),
    )


def contains_elem(r: Column, e) -> Column:
    e = _col(e)
    low = r["lower"].isNull() | (r["lower"] < e) | ((r["lower"] == e) & r["lower_inc"])
    high = r["upper"].isNull() | (e < r["upper"]) | ((r["upper"] == e) & r["upper_inc"])
    return F.when(r.isNotNull() & e.isNotNull(), ~r["is_empty"] & low & high)


def elem_contained_by(e, r: Column) -> Column:
    return contains_elem(r, e)


def lower(r: Column) -> Column:
    return r["lower"]


def upper(r: Column) -> Column:
    return r["upper"]


def is_empty(r: Column) -> Column:
    return r["is_empty"]


def lower_inc(r: Column) -> Column:
    return r["lower_inc"]


def upper_inc(r: Column) -> Column:
    return r["upper_inc"]


def lower_inf(r: Column) -> Column:
    return ~r["is_empty"] & r["lower"].isNull()


def upper_inf(r: Column) -> Column:
    return ~r["is_empty"] & r["upper"].isNull()


def _let(e: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(e), body), F.lit(0))


def to_text(r: Column) -> Column:
    """The literal form, such as ``[1,5)`` or ``empty``; values with spaces or signs of the form are quoted."""
    return _let(r, _to_text)


def _to_text(r: Column) -> Column:

    def bound(e: Column) -> Column:
        text = e.cast("string")
        escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""'))
        return F.coalesce(F.when(text.rlike(r'[\s,()\[\]"\\]|^$'), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(text), F.lit(""))

    body = F.concat(F.when(r["lower_inc"], "[").otherwise("("), bound(r["lower"]), F.lit(","), bound(r["upper"]), F.when(r["upper_inc"], "]").otherwise(")"))
    return F.when(r["is_empty"], F.lit("empty")).when(r.isNotNull(), body)


def parse(kind: str, s: Column) -> Column:
    """A range from its literal form."""
    return _let(s, lambda x: _parse(kind, x))


def _parse(kind: str, s: Column) -> Column:
    t = KINDS[kind][0]
    bound = r'("(?:[^"\\]|\\.|"")*"|[^,"]*)'
    pattern = rf"^\s*([\[(]){bound},{bound}([\])])\s*$"
    side = lambda k: F.nullif(F.btrim(F.regexp_extract(s, pattern, k), F.lit('"')), F.lit("")).cast(t)
    made = make(kind, side(2), side(3), F.regexp_extract(s, pattern, 1) == "[", F.regexp_extract(s, pattern, 4) == "]")
    return F.when(F.lower(F.trim(s)) == "empty", empty(kind)).when(s.rlike(pattern), made)


def literal(kind: str, text: str) -> Column:
    return parse(kind, F.lit(text))


def encode(lower_bound, upper_bound, bounds: str = "[)") -> str:
    """The literal form of a range of plain Python values; None is unbounded."""

    def show(v) -> str:
        text = "" if v is None else v.isoformat(sep=" ") if isinstance(v, dt.datetime) else str(v) if not isinstance(v, Decimal) else format(v, "f")
        return '"' + text.replace("\\", "\\\\").replace('"', '""') + '"' if re.search(r'[\s,()\[\]"\\]', text) else text

    left = "(" if lower_bound is None else bounds[0]
    right = ")" if upper_bound is None else bounds[1]
    return f"{left}{show(lower_bound)},{show(upper_bound)}{right}"
