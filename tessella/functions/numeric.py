"""Numeric functions with PostgreSQL's types, rounding and domain errors as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

abs_, power, exp, pi, random, degrees, radians = F.abs, F.pow, F.exp, F.pi, F.rand, F.degrees, F.radians
sin, cos, tan, atan, atan2, sinh, cosh, tanh = F.sin, F.cos, F.tan, F.atan, F.atan2, F.sinh, F.cosh, F.tanh


def _checked(bad: Column, message: str, value: Column) -> Column:
    """``value``, or an error where ``bad`` holds."""
    return F.when(bad, F.raise_error(message).cast("double")).otherwise(value)


def _typed(e: Column, of: str | None) -> Column:
    return e if of is None else e.cast(of)


def ceil(e: Column, of: str | None = None) -> Column:
    """Ceiling in the argument's type (``of``, as Spark alone knows it)."""
    return _typed(F.ceil(e), of)


def floor(e: Column, of: str | None = None) -> Column:
    return _typed(F.floor(e), of)


def trunc(e: Column, of: str | None = None) -> Column:
    """Toward zero."""
    return _typed(F.when(e < 0, F.ceil(e)).otherwise(F.floor(e)), of)


def round_(e: Column, places: int | None = None, of: str = "decimal") -> Column:
    """Decimals round half away from zero, doubles (``of='double'``) half to even."""
    if of == "double":
        return F.rint(e)
    return F.round(e, places or 0)


def mod(a: Column, b) -> Column:
    return a % b


def greatest(*args: Column) -> Column:
    return args[0] if len(args) == 1 else F.greatest(*args)


def least(*args: Column) -> Column:
    return args[0] if len(args) == 1 else F.least(*args)


def sqrt(e: Column) -> Column:
    return _checked(e < 0, "cannot take square root of a negative number", F.sqrt(e))


def ln(e: Column) -> Column:
    return _checked(e <= 0, "cannot take logarithm of zero or a negative number", F.ln(e))


def log(e: Column) -> Column:
    """Base 10."""
    return _checked(e <= 0, "cannot take logarithm of zero or a negative number", F.log10(e))


def sign(e: Column, of: str | None = None) -> Column:
    return _typed(F.signum(e), of)


def asin(e: Column) -> Column:
    return _checked(F.abs(e) > 1, "input is out of range", F.asin(e))


def acos(e: Column) -> Column:
    return _checked(F.abs(e) > 1, "input is out of range", F.acos(e))
