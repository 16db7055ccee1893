"""JSON operators and functions over VARIANT columns, with PostgreSQL's jsonb semantics.

Reading, key tests and types stay in the JVM. Editing and containment have no Spark counterpart and run as
Arrow-batched pandas functions over JSON text.
"""

from __future__ import annotations

import json as _json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse(s: Column) -> Column:
    return F.parse_json(s)


def text(v: Column) -> Column:
    """JSON text of a VARIANT."""
    return F.to_json(v)


def _step(part) -> str:
    return f"[{part}]" if isinstance(part, int) else "['" + part.replace("'", "\\'") + "']"


def get(v: Column, key: str) -> Column:
    """``->`` by key; NULL if absent or no object."""
    return F.try_variant_get(v, "$" + _step(key), "variant")


def get_text(v: Column, key: str) -> Column:
    """``->>`` by key."""
    return _as_text(get(v, key))


def _as_text(v: Column) -> Column:
    """Text of a value: strings bare, JSON null as NULL, others as JSON."""
    kind = typeof(v)
    return F.when(kind == "string", F.try_variant_get(v, "$", "string")).when(kind != "null", F.to_json(v))


def at(v: Column, i: int) -> Column:
    """``->`` by index; a negative one counts from the end."""
    if i >= 0:
        return F.try_variant_get(v, f"$[{i}]", "variant")
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.get(items, F.size(items) + i)


def at_text(v: Column, i: int) -> Column:
    return _as_text(at(v, i))


def path(v: Column, *parts) -> Column:
    """``#>``: a part that is a number is an index of an array or a key of an object."""
    for part in parts:
        if isinstance(part, int) or (isinstance(part, str) and part.lstrip("-").isdigit()):
            v = F.coalesce(at(v, int(part)), get(v, str(part)))
        else:
            v = get(v, part)
    return v


def path_text(v: Column, *parts) -> Column:
    return _as_text(path(v, *parts))


def _keys(v: Column) -> Column:
    """Top-level keys, or the strings of an array."""
    items = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: typeof(x) == "string")
    strings = F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))
    return F.coalesce(F.json_object_keys(F.to_json(v)), strings, F.array().cast("array<string>"))


def has_key(v: Column, key: str) -> Column:
    return F.when(v.isNotNull(), F.array_contains(_keys(v), key))


def has_any_key(v: Column, *keys: str) -> Column:
    return F.when(v.isNotNull(), F.arrays_overlap(_keys(v), F.array(*[F.lit(k) for k in keys])))


def has_all_keys(v: Column, *keys: str) -> Column:
    own = _keys(v)
    return F.when(v.isNotNull(), F.forall(F.array(*[F.lit(k) for k in keys]), lambda k: F.array_contains(own, k)))


def to_jsonb(e: Column, of: T.DataType | None = None) -> Column:
    """Any value as a VARIANT; NULL fields of structs stay as JSON nulls."""
    if isinstance(of, (T.StructType, T.ArrayType, T.MapType)):
        return F.parse_json(F.to_json(e, {"ignoreNullFields": "false"}))
    return e.cast("variant")


def typeof(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    kind = F.schema_of_variant(v)
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )


def array_length(v: Column) -> Column:
    return F.json_array_length(F.to_json(v)).cast("int")


def typed(s: Column, schema: T.StructType) -> Column:
    """JSON text as a struct."""
    return F.from_json(s, schema)


def untyped(e: Column) -> Column:
    """A struct as JSON text, NULL fields kept."""
    return F.to_json(e, {"ignoreNullFields": "false"})


class _Exact(float):
    """A number with a point: compares as its exact decimal, prints as it was written."""

    def __new__(cls, text: str):
        out = super().__new__(cls, text)
        out.text, out.decimal = text, Decimal(text)
        return out

    def __repr__(self) -> str:
        return self.text

    def __eq__(self, other) -> bool:
        return self.decimal == (other.decimal if isinstance(other, _Exact) else other)

    __hash__ = float.__hash__


def _dumped(v, depth: int | None = None, ascii_only: bool = True) -> str:
    """JSON text, numbers as they were written; ``depth`` is the level of an indented text."""
    if isinstance(v, _Exact):
        return v.text
    if not isinstance(v, (dict, list)) or not v:
        return _json.dumps(v, ensure_ascii=ascii_only)
    inner = None if depth is None else depth + 1
    items = [_dumped(x, inner, ascii_only) for x in (v.values() if isinstance(v, dict) else v)]
    if isinstance(v, dict):
        items = [f"{_json.dumps(k, ensure_ascii=ascii_only)}: {x}" for k, x in zip(v, items, strict=True)]
    opened, closed = "{}" if isinstance(v, dict) else "[]"
    if depth is None:
        return opened + ", ".join(items) + closed
    pad = "\n" + " " * 4 * inner
    return opened + pad + f",{pad}".join(items) + "\n" + " " * 4 * depth + closed


def _apply(fn, *args: Column, kind: T.DataType = T.StringType()) -> Column:
    """A function of parsed JSON values over JSON text, batch by batch; NULL arguments give NULL."""

    def one(*texts):
        return None if any(t is None for t in texts) else fn(*[_json.loads(t, parse_float=_Exact) for t in texts])

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(*columns, strict=True)], dtype=object)

    return run(*args)


def _edit(fn, *args: Column) -> Column:
    return F.parse_json(_apply(lambda *v: _dumped(fn(*v)), *[F.to_json(a) for a in args]))


def _within(a, b) -> bool:
    """Whether ``a @> b``."""
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and _within(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(_within(x, y) for x in a) for y in b)
    return a == b and type(a) is type(b) or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)


def _contains(a, b) -> bool:
    """``@>`` at the top, where an array may contain a bare value."""
    if isinstance(a, list) and not isinstance(b, (list, dict)):
        return any(_within(x, b) for x in a)
    return _within(a, b)


def contains(a: Column, b: Column) -> Column:
    return _apply(_contains, F.to_json(a), F.to_json(b), kind=T.BooleanType())


def contained_by(a: Column, b: Column) -> Column:
    return contains(b, a)


def _stripped(v):
    if isinstance(v, dict):
        return {k: _stripped(x) for k, x in v.items() if x is not None}
    return [_stripped(x) for x in v] if isinstance(v, list) else v


def strip_nulls(v: Column) -> Column:
    """Without fields that are null, at any depth; nulls in arrays stay."""
    return _edit(_stripped, v)


def _ordered(v):
    if isinstance(v, dict):
        return {k: _ordered(v[k]) for k in sorted(v, key=lambda k: (len(k.encode()), k.encode()))}
    return [_ordered(x) for x in v] if isinstance(v, list) else v


def pretty(v: Column) -> Column:
    """Indented text, keys by length and then bytes."""
    return _apply(lambda x: _dumped(_ordered(x), 0, False), F.to_json(v))


def _place(items: list, step) -> int:
    i = int(step)
    return i + len(items) if i < 0 else i


def _set(v, steps: list, new, create: bool):
    if not steps:
        return v
    step, rest = steps[0], steps[1:]
    if isinstance(v, dict):
        if rest:
            return {**v, step: _set(v[step], rest, new, create)} if step in v else v
        return {**v, step: new} if step in v or create else v
    if isinstance(v, list):
        i = _place(v, step)
        if 0 <= i < len(v):
            return [*v[:i], _set(v[i], rest, new, create) if rest else new, *v[i + 1 :]]
        return v if rest or not create else [new, *v] if i < 0 else [*v, new]
    return v


def set_(v: Column, steps: list, new: Column, create: bool = True) -> Column:
    """Replace the value at a path; the last step is added if it is missing and ``create`` holds."""
    return _edit(lambda a, b: _set(a, [str(s) for s in steps], b, create), v, new)


def _insert(v, steps: list, new, after: bool):
    step, rest = steps[0], steps[1:]
    if isinstance(v, dict):
        if rest:
            return {**v, step: _insert(v[step], rest, new, after)} if step in v else v
        if step in v:
            raise ValueError("cannot replace existing key")
        return {**v, step: new}
    if isinstance(v, list):
        i = _place(v, step)
        if rest:
            return [*v[:i], _insert(v[i], rest, new, after), *v[i + 1 :]] if 0 <= i < len(v) else v
        if i < 0:
            return [new, *v]
        i = min(i + after, len(v))
        return [*v[:i], new, *v[i:]]
    return v


def insert(v: Column, steps: list, new: Column, after: bool = False) -> Column:
    """Insert at a path, before or after an array's element; an object's existing key raises."""
    return _edit(lambda a, b: _insert(a, [str(s) for s in steps], b, after), v, new)


def _joined(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **b}
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def concat(a: Column, b: Column) -> Column:
    """Objects merge at the top, else both append as arrays."""
    return _edit(_joined, a, b)


def delete_key(v: Column, key: str) -> Column:
    """Without a top-level key, or without an array's strings that equal it."""
    return _edit(lambda x: {k: y for k, y in x.items() if k != key} if isinstance(x, dict) else [y for y in x if y != key] if isinstance(x, list) else x, v)
