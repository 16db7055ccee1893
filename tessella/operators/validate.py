"""Checks declared relations against what the session holds, and reports every difference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources.schema import Relation, TableDef, spark_type


@dataclass(frozen=True)
class Mismatch:
    """One difference: its kind, where, and the two sides."""

    kind: str
    relation: str
    column: str | None = None
    expected: str | None = None
    actual: str | None = None


@dataclass(frozen=True)
class Report:
    mismatches: tuple[Mismatch, ...]

    @property
    def ok(self) -> bool:
        return not self.mismatches

    def kinds(self) -> list[str]:
        return [m.kind for m in self.mismatches]

    def __str__(self) -> str:
        return "\n".join(f"{m.kind} {m.relation}{'.' + m.column if m.column else ''}: expected {m.expected}, found {m.actual}" for m in self.mismatches) or "no mismatch"


class ValidationError(Exception):
    def __init__(self, report: Report):
        super().__init__(str(report))
        self.report = report


@dataclass(frozen=True)
class Live:
    """What a relation is really like. Parquet holds no keys, so they come from here or from the data."""

    df: DataFrame
    kind: str = "table"
    primary: tuple[str, ...] | None = None
    uniques: tuple[tuple[str, ...], ...] | None = None
    declares_nulls: bool = False  # whether the source states nullability


def _catalog(spark: SparkSession, relation: Relation) -> Live | None:
    if not spark.catalog.tableExists(relation.full_name):
        return None
    found = spark.catalog.getTable(relation.full_name)
    kind = "view" if found.isTemporary or found.tableType in ("VIEW", "TEMPORARY") else "table"
    return Live(spark.table(relation.full_name), kind)


def _is_key(df: DataFrame, names: tuple[str, ...]) -> bool:
    """Whether the data holds each combination once."""
    return df.groupBy(*names).count().filter("count > 1").limit(1).count() == 0


def _same(expected: T.DataType, actual: T.DataType) -> bool:
    strings = (T.StringType, T.VarcharType, T.CharType)
    if type(expected) is T.StringType and isinstance(actual, strings):
        return True
    return expected.simpleString() == actual.simpleString()


def check(spark: SparkSession, relation: Relation, live: Live | None = None) -> list[Mismatch]:
    """Differences of one relation; ``live`` stands in for the catalog."""
    live = live or _catalog(spark, relation)
    name, out = relation.full_name, []
    if live is None:
        return [Mismatch("RelationMissing", name, None, relation.kind, "nothing")]
    if relation.kind != live.kind:
        return [Mismatch("RelationKindMismatch", name, None, relation.kind, live.kind)]
    fields = {f.name: f for f in live.df.schema.fields}
    for c in relation.columns:
        f = fields.get(c.name)
        if f is None:
            out.append(Mismatch("ColumnMissing", name, c.name, c.type_name, None))
            continue
        stated = f.metadata.get("type") or f.metadata.get("__CHAR_VARCHAR_TYPE_STRING")
        if not _same(spark_type(c.type_name), f.dataType) or (stated and stated != c.type_name and "(" in c.type_name + stated):
            out.append(Mismatch("TypeMismatch", name, c.name, c.type_name, stated or f.dataType.simpleString()))
        if relation.kind == "table" and live.declares_nulls and c.nullable != f.nullable:
            out.append(Mismatch("NullabilityMismatch", name, c.name, str(c.nullable), str(f.nullable)))
    declared = {c.name for c in relation.columns}
    out += [Mismatch("ExtraColumn", name, n, None, fields[n].dataType.simpleString()) for n in fields if n not in declared]
    if isinstance(relation, TableDef):
        out += _keys(relation, live, set(fields))
    return out


def _keys(table: TableDef, live: Live, present: set[str]) -> list[Mismatch]:
    name, out = table.full_name, []
    show = lambda key: ", ".join(sorted(key)) if key else None
    if live.primary is not None:
        if table.primary and not live.primary:
            out.append(Mismatch("PrimaryKeyMissing", name, None, show(table.primary)))
        elif live.primary and not table.primary:
            out.append(Mismatch("ExtraPrimaryKey", name, None, None, show(live.primary)))
        elif set(live.primary) != set(table.primary):
            out.append(Mismatch("PrimaryKeyColumnsDiffer", name, None, show(table.primary), show(live.primary)))
    elif table.primary and set(table.primary) <= present and not _is_key(live.df, table.primary):
        out.append(Mismatch("PrimaryKeyMissing", name, None, show(table.primary), "repeated values"))
    wanted = [frozenset(names) for _, names in table.uniques]
    if live.uniques is not None:
        has = [frozenset(u) for u in live.uniques]
        out += [Mismatch("UniqueConstraintMissing", name, None, show(k)) for k in wanted if k not in has]
        out += [Mismatch("ExtraUniqueConstraint", name, None, None, show(k)) for k in has if k not in wanted]
    else:
        for key in wanted:
            whole = live.df.dropna(subset=list(key)) if key <= present else None
            if whole is not None and not _is_key(whole, tuple(key)):
                out.append(Mismatch("UniqueConstraintMissing", name, None, show(key), "repeated values"))
    return out


def validate(spark: SparkSession, *relations) -> Report:
    """A report over relations, or (relation, live) pairs; plain DataFrames are derived and skipped."""
    out: list[Mismatch] = []
    for r in relations:
        relation, live = r if isinstance(r, tuple) else (r, None)
        if isinstance(relation, Relation):
            out += check(spark, relation, live)
    return Report(tuple(out))


def validate_or_raise(spark: SparkSession, *relations) -> None:
    report = validate(spark, *relations)
    if not report.ok:
        raise ValidationError(report)


def report_frame(spark: SparkSession, report: Report) -> DataFrame:
    """A report as rows."""
    rows = [(m.kind, m.relation, m.column, m.expected, m.actual) for m in report.mismatches]
    return spark.createDataFrame(rows, "kind string, relation string, column string, expected string, actual string").select(F.col("kind"), "relation", "column", "expected", "actual")
