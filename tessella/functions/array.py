"""Array operators and functions with PostgreSQL's NULL rules as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

cardinality = F.size
array_append = F.array_append
unnest = F.explode


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def contains(a: Column, b: Column) -> Column:
    """Every element of ``b`` equals one of ``a``; NULL elements match nothing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.forall(b, lambda x: F.coalesce(F.array_contains(a, x), F.lit(False))))


def contained_by(a: Column, b: Column) -> Column:
    return contains(b, a)


def overlaps(a: Column, b: Column) -> Column:
    """Whether they share an element, never unknown for two arrays."""
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.arrays_overlap(a, b), F.lit(False)))


def concat(a: Column, b: Column) -> Column:
    """Concatenation; a NULL side gives the other."""
    return F.coalesce(F.concat(a, b), a, b)


array_cat = concat


def elem_of(e, a: Column) -> Column:
    """``e = ANY(a)``."""
    return F.array_contains(a, _col(e))


def array_length(a: Column, dim: int = 1) -> Column:
    """Length of the dimension; NULL for an empty array or another dimension."""
    return F.nullif(F.size(a), F.lit(0)) if dim == 1 else F.lit(None).cast("int")


def array_prepend(e, a: Column) -> Column:
    return F.array_prepend(a, _col(e))


def array_position(a: Column, e) -> Column:
    """1-based place of the first equal element, NULL if none; a NULL needle finds a NULL."""
    e = _col(e)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda i: (i <= F.size(a)) & F.get(a, i - 1).eqNullSafe(e))
    return F.get(places, F.lit(0)).cast("int")


def array_positions(a: Column, e) -> Column:
    """All 1-based places of equal elements."""
    e = _col(e)
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda i: (i <= F.size(a)) & F.get(a, i - 1).eqNullSafe(e))


def array_remove(a: Column, e) -> Column:
    """Without the elements that equal ``e``, NULLs too if it is NULL."""
    return F.filter(a, lambda x: ~x.eqNullSafe(_col(e)))


def array_replace(a: Column, old, new) -> Column:
    return F.transform(a, lambda x: F.when(x.eqNullSafe(_col(old)), _col(new)).otherwise(x))


def array_to_string(a: Column, separator: str, null: str | None = None) -> Column:
    texts = F.transform(a, lambda x: x.cast("string"))
    return F.array_join(texts, separator) if null is None else F.array_join(texts, separator, null)


def string_to_array(s: Column, separator: str) -> Column:
    """Split at a literal separator; an empty text has no elements, an empty separator splits nothing."""
    if separator == "":
        return F.when(s == "", F.array().cast("array<string>")).otherwise(F.array(s))
    parts = F.split(s, "\\Q" + re.sub(r"\\E", r"\\E\\\\E\\Q", separator) + "\\E", -1)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(parts)


def array(*values) -> Column:
    return F.array(*[_col(v) for v in values])
