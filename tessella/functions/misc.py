"""NULL helpers, session functions, and hooks for functions and operators the catalogue lacks."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

current_user, session_user, user = F.current_user, F.session_user, F.user
current_schema, current_catalog, coalesce = F.current_schema, F.current_catalog, F.coalesce


def current_database() -> Column:
    """The database; PostgreSQL's word for what Spark calls the catalog."""
    return F.current_catalog()


def null_of(kind: str) -> Column:
    """A typed NULL."""
    return F.lit(None).cast(kind)


def nullif(a: Column, value) -> Column:
    return F.nullif(a, value if isinstance(value, Column) else F.lit(value))


class Function:
    """Calls any function the session knows by name, registered ones included."""

    @staticmethod
    def nullary(name: str) -> Callable[[], Column]:
        return lambda: F.call_function(name)

    @staticmethod
    def unary(name: str) -> Callable[[Column], Column]:
        return lambda a: F.call_function(name, a)

    @staticmethod
    def binary(name: str) -> Callable[[Column, Column], Column]:
        return lambda a, b: F.call_function(name, a, b)

    @staticmethod
    def nary(name: str) -> Callable[..., Column]:
        return lambda *args: F.call_function(name, *args)


_INFIX: dict[str, Callable] = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "%": operator.mod, "=": operator.eq, "<>": operator.ne,
    "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "and": operator.and_, "or": operator.or_,
    "||": lambda a, b: F.concat(a.cast("string"), b.cast("string")), "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b), "#": lambda a, b: a.bitwiseXOR(b),
    "~": lambda a, b: F.rlike(a, b), "^": F.pow,
}
_PREFIX: dict[str, Callable] = {"-": operator.neg, "not": operator.invert, "~": F.bitwise_not, "@": F.abs, "|/": F.sqrt}


class Operator:
    """Operators by symbol; ``register`` adds one."""

    @staticmethod
    def infix(symbol: str) -> Callable[[Column, Column], Column]:
        return _INFIX[symbol.lower()]

    @staticmethod
    def prefix(symbol: str) -> Callable[[Column], Column]:
        return _PREFIX[symbol.lower()]

    @staticmethod
    def postfix(symbol: str) -> Callable[[Column], Column]:
        return {"is null": Column.isNull, "is not null": Column.isNotNull, "!": F.factorial}[symbol.lower()]

    @staticmethod
    def register(symbol: str, fn: Callable, prefix: bool = False) -> None:
        (_PREFIX if prefix else _INFIX)[symbol.lower()] = fn
