"""Declared tables and views: columns with types, nullability, keys and defaults, fixed at declaration."""

from __future__ import annotations

import dataclasses
import datetime as dt
import types
import typing
import uuid
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any, ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: PostgreSQL type names and the Spark types that hold them. Parameters go in brackets: varchar(64), numeric(10,2).
TYPE_NAMES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "int2": T.ShortType(), "int4": T.IntegerType(), "int8": T.LongType(), "float4": T.FloatType(), "float8": T.DoubleType(),
    "text": T.StringType(), "name": T.StringType(), "uuid": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(),
    "bytea": T.BinaryType(), "json": T.StringType(), "jsonb": T.VariantType(), "xml": T.StringType(), "inet": T.StringType(), "cidr": T.StringType(),
    "macaddr": T.StringType(), "macaddr8": T.StringType(), "bit": T.StringType(), "varbit": T.StringType(), "money": T.DecimalType(19, 2), "tsvector": T.StringType(), "tsquery": T.StringType(),
    "numeric": T.DecimalType(38, 10), "varchar": T.StringType(), "bpchar": T.StringType(), "time": T.LongType(),
    "interval": T.StructType().add("months", T.IntegerType()).add("days", T.IntegerType()).add("micros", T.LongType()),
    "timetz": T.StructType().add("micros", T.LongType()).add("offset_seconds", T.IntegerType()),
}

#: Types of Python values, as dataclass fields declare them.
PYTHON_NAMES: dict[type, str] = {bool: "bool", int: "int8", float: "float8", str: "text", bytes: "bytea", Decimal: "numeric", dt.date: "date", dt.datetime: "timestamptz", dt.timedelta: "interval", uuid.UUID: "uuid", dt.time: "time"}

#: Own types: name and Spark type, added by :func:`register_type`.
_OWN: dict[str, T.DataType] = {}


def register_type(name: str, spark_type: T.DataType, python: type | None = None) -> None:
    """Make a type name (and a Python class for dataclass fields) usable in declarations."""
    _OWN[name] = spark_type
    if python is not None:
        PYTHON_NAMES[python] = name


def range_struct(bound: T.DataType) -> T.StructType:
    return T.StructType().add("lower", bound).add("upper", bound).add("lower_inc", T.BooleanType()).add("upper_inc", T.BooleanType()).add("is_empty", T.BooleanType())


_RANGES = {"int4range": T.IntegerType(), "int8range": T.LongType(), "numrange": T.DecimalType(38, 10), "daterange": T.DateType(), "tsrange": T.TimestampNTZType(), "tstzrange": T.TimestampType()}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a type name; ``int4[]`` is an array."""
    if name.endswith("[]"):
        return T.ArrayType(spark_type(name[:-2]))
    base, _, rest = name.partition("(")
    if base in ("numeric", "decimal") and rest:
        p, _, s = rest.rstrip(")").partition(",")
        return T.DecimalType(int(p), int(s or 0))
    if base in _RANGES:
        return range_struct(_RANGES[base])
    found = _OWN.get(base) or TYPE_NAMES.get(base)
    if found is None:
        raise ValueError(f"unknown type {name!r}")
    return found


UNSET: Any = type("Unset", (), {"__repr__": lambda self: "UNSET", "__bool__": lambda self: False})()


@dataclass(frozen=True)
class ColumnDef:
    """One column. ``default`` is a value or a function of nothing; UNSET means none."""

    name: str
    type_name: str
    nullable: bool = False
    default: Any = UNSET
    check: Any = None  # a constraint on Python values, tested on insert

    @property
    def spark_type(self) -> T.DataType:
        return spark_type(self.type_name)


@dataclass(frozen=True)
class Relation:
    """What tables and views share."""

    name: str
    columns: tuple[ColumnDef, ...]
    schema_name: str | None = None
    kind: ClassVar[str] = "relation"

    @property
    def full_name(self) -> str:
        return f"{self.schema_name}.{self.name}" if self.schema_name else self.name

    def in_schema(self, schema_name: str):
        return replace(self, schema_name=schema_name)

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(f"{self.full_name} has no column {name!r}")

    def struct(self) -> T.StructType:
        """The Spark schema; metadata carries default, key and unique marks."""
        out = T.StructType()
        for c in self.columns:
            out.add(c.name, c.spark_type, True if self.kind == "view" else c.nullable, self._marks(c))
        return out

    def _marks(self, c: ColumnDef) -> dict:
        return {"type": c.type_name}

    def with_column(self, name: str, type_name: str):
        """Override one column's type."""
        self.column(name)
        return replace(self, columns=tuple(replace(c, type_name=type_name) if c.name == name else c for c in self.columns))

    def read(self, spark: SparkSession, path: str | None = None) -> DataFrame:
        """The declared columns, in order and in their types, of a Parquet path or a catalog table."""
        df = spark.read.parquet(path) if path else spark.table(self.full_name)
        return df.select(*[df[f"`{c.name}`"].cast(c.spark_type).alias(c.name) for c in self.columns])


@dataclass(frozen=True)
class TableDef(Relation):
    """A base table: may be changed, has keys and defaults."""

    primary: tuple[str, ...] = ()
    uniques: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())
    kind: ClassVar[str] = "table"

    def _marks(self, c: ColumnDef) -> dict:
        marks = {"type": c.type_name}
        if c.default is not UNSET:
            marks["default"] = "expression" if callable(c.default) else str(c.default)
        if c.name in self.primary:
            marks["pk"] = True
        if any(c.name in names for _, names in self.uniques):
            marks["uq"] = True
        return marks

    def with_primary(self, *names: str) -> TableDef:
        return replace(self, primary=self._known(names))

    def with_unique(self, *names: str, name: str | None = None) -> TableDef:
        names = self._known(names)
        return replace(self, uniques=(*self.uniques, (name or f"{self.name}_{'_'.join(names)}_key", names)))

    def with_unique_index(self, name: str, *names: str) -> TableDef:
        return self.with_unique(*names, name=name)

    def with_default(self, name: str, default: Any) -> TableDef:
        self.column(name)
        return replace(self, columns=tuple(replace(c, default=default) if c.name == name else c for c in self.columns))

    def keys(self) -> list[tuple[str, ...]]:
        """The primary key and all unique sets."""
        return [k for k in (self.primary, *(names for _, names in self.uniques)) if k]

    def _known(self, names) -> tuple[str, ...]:
        for n in names:
            self.column(n)
        return tuple(names)


@dataclass(frozen=True)
class ViewDef(Relation):
    """A read-only relation: no keys, no defaults, no nullability promises."""

    kind: ClassVar[str] = "view"


def _column_of(name: str, hint: Any, meta: dict) -> ColumnDef:
    nullable = False
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        rest = [a for a in typing.get_args(hint) if a is not type(None)]
        nullable, hint = len(rest) < len(typing.get_args(hint)), rest[0]
    if typing.get_origin(hint) in (list, tuple, set, frozenset):
        type_name = PYTHON_NAMES[typing.get_args(hint)[0]] + "[]"
    else:
        type_name = meta.get("type") or PYTHON_NAMES[hint]
    return ColumnDef(name, meta.get("type", type_name), nullable, meta.get("default", UNSET), meta.get("check"))


def _columns_of(cls: type) -> tuple[ColumnDef, ...]:
    hints = typing.get_type_hints(cls)
    return tuple(_column_of(f.name, hints[f.name], dict(f.metadata)) for f in dataclasses.fields(cls))


def table_of(cls: type, name: str) -> TableDef:
    """A table from a dataclass; ``field(metadata={"type": "varchar(64)"})`` overrides a type, ``X | None`` is nullable."""
    return TableDef(name, _columns_of(cls))


def view_of(cls: type, name: str) -> ViewDef:
    return ViewDef(name, _columns_of(cls))


class Builder:
    """Declares a relation column by column."""

    def __init__(self, name: str, view: bool = False):
        self._name, self._view, self._columns = name, view, []

    def column(self, name: str, type_name: str) -> Builder:
        return self._add(ColumnDef(name, type_name))

    def column_opt(self, name: str, type_name: str) -> Builder:
        return self._add(ColumnDef(name, type_name, nullable=True))

    def column_defaulted(self, name: str, type_name: str, default: Any) -> Builder:
        return self._add(ColumnDef(name, type_name, default=default))

    def column_opt_defaulted(self, name: str, type_name: str, default: Any) -> Builder:
        return self._add(ColumnDef(name, type_name, True, default))

    def _add(self, c: ColumnDef) -> Builder:
        if self._view and c.default is not UNSET:
            raise ValueError("a view's column has no default")
        if any(x.name == c.name for x in self._columns):
            raise ValueError(f"column {c.name!r} is declared twice")
        self._columns.append(c)
        return self

    def build(self) -> TableDef | ViewDef:
        return (ViewDef if self._view else TableDef)(self._name, tuple(self._columns))
