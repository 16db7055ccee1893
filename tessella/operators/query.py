"""A composable SELECT over DataFrames, lowered in SQL's logical order whatever the order of calls.

``From(df, "u")`` opens a query. Lambdas receive a namespace: columns of the only source (``t.name``), or of each
source by alias (``t.u.name``). WHERE, GROUP BY, HAVING and ORDER BY accumulate; LIMIT, OFFSET and DISTINCT ON
are replaced. Joins keep the clauses that stand before them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Columns:
    """Columns of one source by attribute or item."""

    def __init__(self, alias: str, names: list[str], outer: bool = False):
        self._alias, self._names, self._outer = alias, names, outer

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Column:
        if name not in self._names:
            raise AttributeError(f"{self._alias} has no column {name!r}; it has {', '.join(self._names)}")
        column = F.col(f"`{self._alias}`.`{name}`")
        return column.outer() if self._outer else column

    def all(self) -> list[Column]:
        return [self[n] for n in self._names]


class Sources:
    """The sources of a join by alias."""

    def __init__(self, parts: dict[str, Columns]):
        self._parts = parts

    def __getattr__(self, alias: str) -> Columns:
        try:
            return self._parts[alias]
        except KeyError:
            raise AttributeError(f"no source {alias!r}; there are {', '.join(self._parts)}") from None

    __getitem__ = __getattr__


@dataclass(frozen=True)
class GroupSpec:
    """Explicit grouping sets."""

    sets: tuple[tuple[Column, ...], ...]


def rollup(*columns: Column) -> GroupSpec:
    return GroupSpec(tuple(tuple(columns[:k]) for k in range(len(columns), -1, -1)))


def cube(*columns: Column) -> GroupSpec:
    keep = product((True, False), repeat=len(columns))
    return GroupSpec(tuple(tuple(c for c, k in zip(columns, ks, strict=True) if k) for ks in keep))


def grouping_sets(*sets: tuple) -> GroupSpec:
    return GroupSpec(tuple(tuple(s) if isinstance(s, (tuple, list)) else (s,) for s in sets))


EMPTY_GROUP: tuple = ()

_LOCKS = ("update", "no key update", "share", "key share")


@dataclass(frozen=True)
class Join:
    alias: str
    how: str
    df: DataFrame | None
    on: Callable | None = None
    lateral: Callable | None = None


@dataclass(frozen=True)
class Query:
    """An immutable SELECT; ``df()`` lowers it."""

    base: DataFrame
    base_alias: str
    joins: tuple[Join, ...] = ()
    projection: Callable | None = None
    wheres: tuple[Callable, ...] = ()
    groups: tuple[Callable, ...] = ()
    havings: tuple[Callable, ...] = ()
    orders: tuple[Callable, ...] = ()
    limit_n: int | None = None
    offset_n: int | None = None
    distinct: bool = False
    distinct_keys: Callable | None = None
    lock: tuple[str, str | None] | None = None
    writable: bool = field(default=True)

    # clauses

    def select(self, projection: Callable) -> Query:
        return replace(self, projection=projection)

    def where(self, condition: Callable) -> Query:
        return replace(self, wheres=(*self.wheres, condition))

    def group_by(self, keys: Callable) -> Query:
        return replace(self, groups=(*self.groups, keys))

    def having(self, condition: Callable) -> Query:
        return replace(self, havings=(*self.havings, condition))

    def order_by(self, keys: Callable) -> Query:
        return replace(self, orders=(*self.orders, keys))

    def limit(self, n: int) -> Query:
        return replace(self, limit_n=n)

    def offset(self, n: int) -> Query:
        return replace(self, offset_n=n)

    def distinct_rows(self) -> Query:
        return replace(self, distinct=True)

    def distinct_on(self, keys: Callable) -> Query:
        """The first row of each key by the query's order; stronger than ``distinct_rows``."""
        return replace(self, distinct_keys=keys)

    def for_(self, strength: str, wait: str | None = None) -> Query:
        """A row lock: noted only, since DataFrames are snapshots; single tables alone can be locked."""
        if strength not in _LOCKS or wait not in (None, "skip locked", "nowait"):
            raise ValueError(f"no such lock: {strength} {wait or ''}")
        if self.joins or not self.writable:
            raise ValueError("only a single table's rows can be locked")
        if self.groups or self.distinct or self.distinct_keys is not None:
            raise ValueError("groups and distinct rows are no table rows to lock")
        return replace(self, lock=(strength, wait))

    # joins

    def _join(self, how: str, df: DataFrame, alias: str, on: Callable | None) -> Query:
        self._new_alias(alias)
        return replace(self, joins=(*self.joins, Join(alias, how, df, on)))

    def _new_alias(self, alias: str) -> None:
        if alias == self.base_alias or any(j.alias == alias for j in self.joins):
            raise ValueError(f"alias {alias!r} is used twice")

    def inner_join(self, df: DataFrame, alias: str, on: Callable) -> Query:
        return self._join("inner", df, alias, on)

    def left_join(self, df: DataFrame, alias: str, on: Callable) -> Query:
        return self._join("left", df, alias, on)

    def right_join(self, df: DataFrame, alias: str, on: Callable) -> Query:
        return self._join("right", df, alias, on)

    def full_join(self, df: DataFrame, alias: str, on: Callable) -> Query:
        return self._join("full", df, alias, on)

    def cross_join(self, df: DataFrame, alias: str) -> Query:
        return self._join("cross", df, alias, None)

    def _lateral(self, how: str, alias: str, build: Callable, on: Callable | None) -> Query:
        self._new_alias(alias)
        return replace(self, joins=(*self.joins, Join(alias, how, None, on, build)))

    def inner_join_lateral(self, alias: str, build: Callable, on: Callable | None = None) -> Query:
        """``build`` gets the outer namespace and returns a query or DataFrame that may use its columns."""
        return self._lateral("inner", alias, build, on)

    def left_join_lateral(self, alias: str, build: Callable, on: Callable | None = None) -> Query:
        return self._lateral("left", alias, build, on)

    def cross_join_lateral(self, alias: str, build: Callable) -> Query:
        return self._lateral("cross", alias, build, None)

    # lowering

    def _sources(self, parts: dict[str, Columns]):
        return next(iter(parts.values())) if not self.joins else Sources(parts)

    def df(self) -> DataFrame:
        parts = {self.base_alias: Columns(self.base_alias, self.base.columns)}
        current = self.base.alias(self.base_alias)
        for j in self.joins:
            if j.lateral is not None:
                outer = {a: Columns(a, c._names, outer=True) for a, c in parts.items()}
                built = j.lateral(next(iter(outer.values())) if len(outer) == 1 else Sources(outer))
                # a frame that names outer columns can't be asked for its own; the query knows them
                right = built.df() if isinstance(built, Query) else built
                parts[j.alias] = Columns(j.alias, built.output_names() if isinstance(built, Query) else right.columns)
                on = j.on(Sources(parts)) if j.on else None
                current = current.lateralJoin(right.alias(j.alias), on=on, how=j.how)
                continue
            parts[j.alias] = Columns(j.alias, j.df.columns)
            right = j.df.alias(j.alias)
            current = current.crossJoin(right) if j.how == "cross" else _joined(current, right, j.on(Sources(parts)), j.how)
        names = self._sources(parts)
        for condition in self.wheres:
            current = current.filter(condition(names))
        columns = self._projected(names, parts)
        orders = [o for make in self.orders for o in _many(make(names))]
        keys = [k for make in self.groups for k in _many(make(names))]
        if keys or self.havings:
            return self._finish(*self._grouped(current, names, columns, orders, keys))
        out_names = [_name(c) for c in columns]
        if not self.distinct or self.distinct_keys is not None:
            on = list(_many(self.distinct_keys(names))) if self.distinct_keys else []
            sorting = [_sorted(o) for o in orders]
            if on:
                rank = F.row_number().over(Window.partitionBy(*on).orderBy(*(sorting or on)))
                current = current.withColumn("_first", rank).filter("_first = 1")
            if sorting:
                current = current.orderBy(*sorting)
            if self.offset_n:
                current = current.offset(self.offset_n)
            if self.limit_n is not None:
                current = current.limit(self.limit_n)
            return current.select(*[c.alias(n) for c, n in zip(columns, out_names, strict=True)])
        shown = current.select(*[c.alias(n) for c, n in zip(columns, out_names, strict=True)]).distinct()
        by_name = [make(Columns("d", out_names)) for make in self.orders]
        return self._finish(shown.alias("d"), [F.col(f"d.`{n}`") for n in out_names], out_names, [_sorted(o) for x in by_name for o in _many(x)])

    def _projected(self, names, parts: dict[str, Columns]) -> list[Column]:
        if self.projection is not None:
            return list(_many(self.projection(names)))
        return [c for p in parts.values() for c in p.all()]

    def _grouped(self, current: DataFrame, names, columns: list[Column], orders: list[Column], keys: list):
        """Aggregate into hidden columns, filter by HAVING, and give back (df, columns, names, orders)."""
        havings = [make(names) for make in self.havings]
        listed = [c.alias(f"_c{k}") for k, c in enumerate(columns)] + [h.alias(f"_g{k}") for k, h in enumerate(havings)]
        sort_of, plain = [], []
        for k, o in enumerate(orders):
            child, direction = _split_order(o)
            plain.append(child.alias(f"_o{k}"))
            sort_of.append(direction)
        listed += plain
        specs = [k for k in keys if isinstance(k, GroupSpec)]
        if specs:
            choices = [k.sets if isinstance(k, GroupSpec) else ((k,),) for k in keys]
            sets = [[c for part in combo for c in part] for combo in product(*choices)]
            every: list[Column] = []
            for k in keys:
                for c in [c for s in k.sets for c in s] if isinstance(k, GroupSpec) else [k]:
                    if str(c) not in map(str, every):
                        every.append(c)
            grouped = current.groupingSets(sets, *every).agg(*listed)
        else:
            grouped = current.groupBy(*keys).agg(*listed)
        if havings and _windowed(grouped):
            raise ValueError("put the aggregation with HAVING into a derived relation and the window functions above it")
        for k in range(len(havings)):
            grouped = grouped.filter(F.col(f"_g{k}"))
        out_names = [_name(c) for c in columns]
        return grouped, [F.col(f"_c{k}") for k in range(len(columns))], out_names, [d(F.col(f"_o{k}")) for k, d in enumerate(sort_of)]

    def _finish(self, current: DataFrame, columns: list[Column], out_names: list[str], orders: list[Column]) -> DataFrame:
        if self.distinct and not orders:
            current = current.select(*columns).distinct()
        if orders:
            current = current.orderBy(*orders)
        if self.offset_n:
            current = current.offset(self.offset_n)
        if self.limit_n is not None:
            current = current.limit(self.limit_n)
        return current.select(*[c.alias(n) for c, n in zip(columns, out_names, strict=True)])

    def output_names(self) -> list[str]:
        """The names of the result's columns."""
        parts = {self.base_alias: Columns(self.base_alias, self.base.columns)}
        parts |= {j.alias: Columns(j.alias, j.df.columns) for j in self.joins if j.df is not None}
        return [_name(c) for c in self._projected(self._sources(parts), parts)]

    # use as a part of other queries

    def as_relation(self, alias: str) -> Query:
        """This query as the source of another one; every output needs a name."""
        df = self.df()
        if any("(" in n for n in df.columns):
            raise ValueError("every column of a derived relation needs a name")
        return Query(df, alias, writable=False)

    def exists(self) -> Column:
        return self.df().exists()

    def scalar(self) -> Column:
        """The one value of a one-column query; more than one row raises when it runs."""
        if len(self.output_names()) != 1:
            raise ValueError("a scalar subquery has one column")
        return self.df().scalar()


def _many(x) -> tuple:
    return tuple(x) if isinstance(x, (tuple, list)) else (x,)


def _name(column: Column) -> str:
    """The output name of an expression: its alias, its column's name, or its text."""
    text = str(column)[len("Column<'") : -len("'>")]
    if " AS " in text:
        return text.rpartition(" AS ")[2].strip("`")
    return text.rpartition(".")[2].strip("`") if "(" not in text and " " not in text else text


def _joined(left: DataFrame, right: DataFrame, on: Column, how: str) -> DataFrame:
    """A join; a full one by equalities is a left join and the right rows that met no left one.

    Spark's full join holds every pair of a key in memory before it hands the first one on, and can neither broadcast a
    side nor split a key over tasks. Both parts read the left side, so it has to be the same at each reading.
    """
    whole = left.join(right, on, how)
    if how != "full" or not _by_equality(whole) or not _steady(left) or not _steady(right):
        return whole
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema]
    alone = right.join(left, on, "left_anti").select(*none, "*")
    return _spread(left, right).join(right, on, "left").union(alone)


def _spread(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows dealt out evenly where the right side is broadcast: a small file's few tasks would make all pairs else."""
    conf = left.sparkSession._jsparkSession.sessionState().conf()
    left_bytes, right_bytes = (df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() for df in (left, right))
    if right_bytes > conf.autoBroadcastJoinThreshold():
        return left
    tasks = max(3 * left.sparkSession.sparkContext.defaultParallelism, left_bytes >> 26)
    return left.repartition(min(tasks, conf.numShufflePartitions()))


def _by_equality(joined: DataFrame) -> bool:
    """Whether the analyzed plan's topmost join has equalities for keys."""
    keys = joined.sparkSession._jvm.org.apache.spark.sql.catalyst.planning.ExtractEquiJoinKeys
    return keys.unapply(joined._jdf.queryExecution().analyzed()).isDefined()


#: As each full join of a chain reads what stands before it twice, a frame over more relations than these is read once.
_RELATIONS = 16
#: Nodes of a plan whose rows don't depend on the order in which rows arrive.
_STEADY = {
    "Distinct", "Filter", "Join", "LocalRelation", "LogicalRDD", "LogicalRelation", "OneRowRelation", "Project", "Range", "Repartition", "ResolvedHint", "Sort", "SubqueryAlias", "Union", "View",
}


def _steady(df: DataFrame) -> bool:
    """Whether a frame gives the same rows each time it is read: nothing random, and no rows picked by an order with ties."""
    nodes = [df._jdf.queryExecution().analyzed()]
    if not nodes[0].deterministic() or nodes[0].collectLeaves().size() > _RELATIONS:
        return False
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in _STEADY:
            return False
        for below in (node.children(), node.subqueries()):
            nodes += [below.apply(k) for k in range(below.size())]
    return True


_DIRECTIONS = {
    "ASC NULLS LAST": lambda c: c.asc_nulls_last(), "DESC NULLS FIRST": lambda c: c.desc_nulls_first(),
    "ASC NULLS FIRST": lambda c: c.asc_nulls_first(), "DESC NULLS LAST": lambda c: c.desc_nulls_last(),
}


@dataclass(frozen=True)
class Order:
    """A sort key; NULLs last ascending and first descending, unless said otherwise."""

    column: Column
    direction: str

    def nulls_first(self) -> Order:
        return replace(self, direction=self.direction.split(" ")[0] + " NULLS FIRST")

    def nulls_last(self) -> Order:
        return replace(self, direction=self.direction.split(" ")[0] + " NULLS LAST")


def asc(e: Column) -> Order:
    return Order(e, "ASC NULLS LAST")


def desc(e: Column) -> Order:
    return Order(e, "DESC NULLS FIRST")


def _split_order(o):
    if isinstance(o, Order):
        return o.column, _DIRECTIONS[o.direction]
    return o, _DIRECTIONS["ASC NULLS LAST"]


def _windowed(grouped: DataFrame) -> bool:
    """Whether the analyzed plan evaluates window functions above its topmost aggregation."""
    node = grouped._jdf.queryExecution().analyzed()
    while node.nodeName() not in ("Aggregate", "Window") and node.children().size():
        node = node.children().head()
    return node.nodeName() == "Window"


def _sorted(o) -> Column:
    column, direction = _split_order(o)
    return direction(column)


def From(df: DataFrame, alias: str, writable: bool = True) -> Query:
    """Open a query over a DataFrame; ``writable=False`` marks a view."""
    return Query(df, alias, writable=writable)
