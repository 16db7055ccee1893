"""INSERT, UPDATE and DELETE as pure DataFrame transformations.

A mutation gives :class:`Result`: the new table and the affected rows (new values for INSERT and UPDATE, old ones for
DELETE). Nothing is overwritten; ``write`` puts the new table at another path.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.query import Columns, Query, Sources, _many
from tessella.operators.setops import SetOp
from tessella.sources.rows import literal
from tessella.sources.schema import UNSET, TableDef, ViewDef


@dataclass(frozen=True)
class Result:
    """The table after a mutation and the rows it affected."""

    table: DataFrame
    affected: DataFrame

    def count(self) -> int:
        """Rows affected, as a completion tag states."""
        return self.affected.count()

    def returning(self, *build: Callable) -> DataFrame:
        """Expressions over the affected rows; without any, whole rows."""
        if not build:
            return self.affected
        names = Columns("r", self.affected.columns)
        return self.affected.alias("r").select(*[c for b in build for c in _many(b(names))])

    def write(self, path: str) -> DataFrame:
        """Persist the new table at a fresh path and read it back."""
        self.table.write.mode("errorifexists").parquet(path)
        return self.table.sparkSession.read.parquet(path)


def _guard(table: TableDef) -> None:
    if isinstance(table, ViewDef):
        raise TypeError(f"{table.full_name} is a view; views are read only")


def _as_dict(row) -> dict:
    return dataclasses.asdict(row) if dataclasses.is_dataclass(row) else dict(row)


def _default(c) -> object:
    return c.default() if callable(c.default) and not isinstance(c.default, Column) else c.default


@dataclass(frozen=True)
class Insert:
    """An INSERT whose rows are known; conflict clauses refine it, ``run`` applies it."""

    table: TableDef
    current: DataFrame
    rows: DataFrame
    conflict: tuple[str, ...] | None = None  # () is any key
    update: Callable | None = None

    @staticmethod
    def _check(table: TableDef, names: list[str]) -> None:
        known = [c.name for c in table.columns]
        if unknown := [n for n in names if n not in known]:
            raise ValueError(f"{table.full_name} has no columns {unknown}")
        required = [c.name for c in table.columns if not c.nullable and c.default is UNSET and c.name not in names]
        if required:
            raise ValueError(f"required columns are missing: {required}")

    @staticmethod
    def _complete(table: TableDef, rows: DataFrame) -> DataFrame:
        out = []
        for c in table.columns:
            if c.name in rows.columns:
                out.append(F.col(f"`{c.name}`").cast(c.spark_type).alias(c.name))
            else:
                value = None if c.default is UNSET else _default(c)
                out.append((value if isinstance(value, Column) else F.lit(value)).cast(c.spark_type).alias(c.name))
        return rows.select(*out)

    @classmethod
    def values(cls, spark: SparkSession, table: TableDef, current: DataFrame, *rows) -> Insert:
        """One or more rows, as dictionaries or dataclass values with the same columns."""
        _guard(table)
        dicts = [_as_dict(r) for r in rows]
        if not dicts:
            raise ValueError("INSERT needs at least one row")
        names = list(dicts[0])
        if any(set(d) != set(names) for d in dicts):
            raise ValueError("all rows of an INSERT need the same columns")
        cls._check(table, names)
        for d in dicts:
            for n in names:
                c = table.column(n)
                if d[n] is None and not c.nullable:
                    raise ValueError(f"column {n!r} is not nullable")
                if c.check is not None and d[n] is not None and not c.check(d[n]):
                    raise ValueError(f"value {d[n]!r} breaks the constraint of {n!r}")
        schema = T.StructType([T.StructField(n, table.column(n).spark_type) for n in names])
        return cls(table, current, cls._complete(table, literal(spark, [tuple(d[n] for n in names) for d in dicts], schema)))

    @classmethod
    def from_query(cls, table: TableDef, current: DataFrame, query) -> Insert:
        """INSERT ... SELECT, columns by name."""
        _guard(table)
        rows = query.df() if isinstance(query, (Query, SetOp)) else query
        cls._check(table, rows.columns)
        return cls(table, current, cls._complete(table, rows))

    def on_conflict_do_nothing(self) -> Insert:
        """Skip rows that break any key of the table."""
        return replace(self, conflict=())

    def on_conflict(self, *columns: str) -> Insert:
        """Aim at a declared key; follow with ``do_nothing`` or ``do_update``."""
        if set(columns) not in [set(k) for k in self.table.keys()]:
            raise ValueError(f"{columns} is no declared key of {self.table.full_name}")
        return replace(self, conflict=tuple(columns))

    def do_nothing(self) -> Insert:
        return replace(self, update=None)

    def do_update(self, assign: Callable) -> Insert:
        """``assign(target, excluded)`` gives a dictionary of new values for rows that exist."""
        if not self.conflict:
            raise ValueError("DO UPDATE needs a conflict target")
        return replace(self, update=assign)

    def run(self) -> Result:
        names = [c.name for c in self.table.columns]
        current = self.current.select(*[F.col(f"`{n}`") for n in names])
        if self.conflict is None:
            return Result(current.unionByName(self.rows), self.rows)
        if self.update is None:
            fresh = self.rows
            for key in [self.conflict] if self.conflict else self.table.keys():
                # NULLs never conflict
                whole = [F.col(f"`{k}`").isNotNull() for k in key]
                known = whole[0]
                for c in whole[1:]:
                    known = known & c
                first = F.row_number().over(Window.partitionBy(*key).orderBy(F.monotonically_increasing_id()))
                fresh = fresh.withColumn("_n", first).filter(~known | (F.col("_n") == 1)).drop("_n")
                fresh = fresh.join(current.select(*key).distinct(), list(key), "left_anti").select(*names)
            return Result(current.unionByName(fresh), fresh)
        return self._upsert(current, names)

    def _upsert(self, current: DataFrame, names: list[str]) -> Result:
        key = self.conflict
        seen = F.count(F.lit(1)).over(Window.partitionBy(*key))
        once = F.when(F.col("_n") > 1, F.raise_error("ON CONFLICT DO UPDATE command cannot affect row a second time").cast("boolean")).otherwise(True)
        rows = self.rows.withColumn("_n", seen).withColumn("_in", once).drop("_n")
        old = current.withColumn("_old", F.lit(True)).alias("t")
        on = [F.col(f"t.`{k}`") == F.col(f"e.`{k}`") for k in key]
        both = old.join(rows.alias("e"), on, "full")
        assigned = self.update(Columns("t", names), Columns("e", names))
        for n in assigned:
            self.table.column(n)
        met = F.col("_old") & F.col("_in")
        new = []
        for c in self.table.columns:
            value = assigned.get(c.name, F.col(f"t.`{c.name}`"))
            value = value if isinstance(value, Column) else F.lit(value)
            new.append(F.when(met, value).when(F.col("_in"), F.col(f"e.`{c.name}`")).otherwise(F.col(f"t.`{c.name}`")).cast(c.spark_type).alias(c.name))
        out = both.select(*new, F.coalesce("_in", F.lit(False)).alias("_hit"))
        return Result(out.drop("_hit"), out.filter("_hit").drop("_hit"))


def insert(spark: SparkSession, table: TableDef, current: DataFrame, *rows) -> Insert:
    return Insert.values(spark, table, current, *rows)


def insert_from(table: TableDef, current: DataFrame, query) -> Insert:
    return Insert.from_query(table, current, query)


@dataclass(frozen=True)
class _Staged:
    table: TableDef
    current: DataFrame
    alias: str
    sources: tuple[tuple[str, DataFrame], ...] = ()
    conditions: tuple[Callable, ...] = ()
    everything: bool = False

    def _namespace(self):
        own = Columns(self.alias, self.current.columns)
        if not self.sources:
            return own
        return Sources({self.alias: own, **{a: Columns(a, d.columns) for a, d in self.sources}})

    def _add(self, df: DataFrame, alias: str):
        if alias == self.alias or alias in [a for a, _ in self.sources]:
            raise ValueError(f"alias {alias!r} is used twice")
        return replace(self, sources=(*self.sources, (alias, df)))

    def where(self, condition: Callable):
        return replace(self, conditions=(*self.conditions, condition))

    def _condition(self) -> Column:
        """What WHERE says. Joins and filters drop NULL by themselves; wrapped in a function its equalities would be no join keys."""
        if not self.conditions and not self.everything:
            raise ValueError("say where, or that all rows are meant")
        return reduce(and_, [c(self._namespace()) for c in self.conditions], F.lit(True))

    def _holds(self) -> Column:
        return F.coalesce(self._condition(), F.lit(False))

    def _key(self) -> list[str]:
        """Columns that tell the rows apart as far as it matters: the primary key, else all (equal rows fare alike)."""
        names = list(self.table.primary)
        return names if names and set(names) <= set(self.current.columns) else list(self.current.columns)

    def _met(self) -> DataFrame:
        """Target rows next to each combination of source rows that meets the condition.

        Inner joins with one filter above: the optimizer moves each conjunct to the join it belongs to and orders the joins by them.
        """
        out = self.current.alias(self.alias)
        for alias, df in self.sources:
            out = out.join(df.alias(alias))
        return out.filter(self._condition())


@dataclass(frozen=True)
class Update(_Staged):
    """UPDATE: ``set`` or ``patch``, perhaps ``from_``, then ``where`` or ``update_all``, then ``run``."""

    assign: Callable | None = None

    def from_(self, df: DataFrame, alias: str) -> Update:
        return self._add(df, alias)

    def set(self, assign: Callable) -> Update:
        """``assign(namespace)`` gives a dictionary of new values; all see the old row."""
        return replace(self, assign=assign)

    def patch(self, changes) -> Update:
        """Only the fields that are not UNSET; None writes NULL."""
        given = {k: v for k, v in _as_dict(changes).items() if v is not UNSET}
        if not given:
            raise ValueError("a patch needs at least one field")
        return self.set(lambda _: given)

    def update_all(self) -> Update:
        return replace(self, everything=True)

    def run(self) -> Result:
        if self.assign is None:
            raise ValueError("UPDATE needs SET")
        names = self.current.columns
        assigned = {k: v if isinstance(v, Column) else F.lit(v) for k, v in self.assign(self._namespace()).items()}
        for n in assigned:
            self.table.column(n)
        kinds = dict(zip(names, (f.dataType for f in self.current.schema.fields), strict=True))
        old = self.current.alias(self.alias)
        if not self.sources:
            condition = self._holds()
            new = [F.when(condition, assigned[n]).otherwise(F.col(f"{self.alias}.`{n}`")).cast(kinds[n]).alias(n) if n in assigned else F.col(f"{self.alias}.`{n}`") for n in names]
            out = old.select(*new, condition.alias("_hit"))
            return Result(out.drop("_hit"), out.filter("_hit").drop("_hit"))
        # several matches: one of them counts, here the first by the values it assigns
        key = self._key()
        values = [v.cast(kinds[n]).alias(f"_v_{n}") for n, v in assigned.items()]
        found = self._met().select(*[F.col(f"{self.alias}.`{k}`").alias(f"_k_{k}") for k in key], F.struct(*values).alias("_v"))
        found = found.groupBy(*[f"_k_{k}" for k in key]).agg(F.min("_v").alias("_v"), F.lit(True).alias("_at"))
        out = self.current.join(found, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_k_{k}`")) for k in key], "left")
        hit = F.col("_at").isNotNull()
        new = [F.when(hit, F.col(f"_v._v_{n}")).otherwise(F.col(f"`{n}`")).alias(n) if n in assigned else F.col(f"`{n}`") for n in names]
        out = out.select(*new, hit.alias("_hit"))
        return Result(out.drop("_hit"), out.filter("_hit").drop("_hit"))


@dataclass(frozen=True)
class Delete(_Staged):
    """DELETE: perhaps ``using``, then ``where`` or ``delete_all``, then ``run``."""

    def using(self, df: DataFrame, alias: str) -> Delete:
        return self._add(df, alias)

    def delete_all(self) -> Delete:
        return replace(self, everything=True)

    def run(self) -> Result:
        old = self.current.alias(self.alias)
        if not self.sources:
            return Result(old.filter(~self._holds()), old.filter(self._holds()))
        if len(self.sources) == 1:
            alias, df = self.sources[0]
            return Result(*[old.join(df.alias(alias), self._condition(), how) for how in ("left_anti", "left_semi")])
        key = self._key()
        found = self._met().select(*[F.col(f"{self.alias}.`{k}`").alias(f"_k_{k}") for k in key]).distinct()
        on = [F.col(f"{self.alias}.`{k}`").eqNullSafe(F.col(f"`_k_{k}`")) for k in key]
        return Result(old.join(found, on, "left_anti"), old.join(found, on, "left_semi"))


def update(table: TableDef, current: DataFrame, alias: str = "t") -> Update:
    _guard(table)
    return Update(table, current, alias)


def delete(table: TableDef, current: DataFrame, alias: str = "t") -> Delete:
    _guard(table)
    return Delete(table, current, alias)
