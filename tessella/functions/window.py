"""Window specifications with all three frame modes, and ranking functions that return bigints."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

UNBOUNDED_PRECEDING = Window.unboundedPreceding
UNBOUNDED_FOLLOWING = Window.unboundedFollowing
CURRENT_ROW = Window.currentRow


def preceding(n: int) -> int:
    return -n


def following(n: int) -> int:
    return n


def asc(e: Column) -> Column:
    """Ascending with NULLs last, PostgreSQL's default."""
    return e.asc_nulls_last()


def desc(e: Column) -> Column:
    """Descending with NULLs first, PostgreSQL's default."""
    return e.desc_nulls_first()


@dataclass(frozen=True)
class Spec:
    """An OVER clause. Keys and orders accumulate, the last frame wins."""

    keys: tuple[Column, ...] = ()
    orders: tuple[Column, ...] = ()
    frame: tuple[str, int, int] | None = None

    def partition_by(self, *keys: Column) -> Spec:
        return replace(self, keys=self.keys + keys)

    def order_by(self, *orders: Column) -> Spec:
        return replace(self, orders=self.orders + orders)

    def rows_between(self, start: int, end: int) -> Spec:
        return replace(self, frame=("rows", start, end))

    def range_between(self, start: int, end: int) -> Spec:
        return replace(self, frame=("range", start, end))

    def groups_between(self, start: int, end: int) -> Spec:
        """Frame of peer groups; see :func:`over_groups`, which such a frame needs."""
        return replace(self, frame=("groups", start, end))

    def build(self):
        orders = self.orders or ((F.lit(1).asc(),) if self.frame is None else ())
        w = Window.partitionBy(*self.keys).orderBy(*orders) if orders else Window.partitionBy(*self.keys)
        if self.frame is None:
            return w
        mode, start, end = self.frame
        if mode == "groups":
            raise ValueError("a GROUPS frame needs over_groups")
        return w.rowsBetween(start, end) if mode == "rows" else w.rangeBetween(start, end)


spec = Spec()


def over(e: Column, s: Spec = spec) -> Column:
    """Attach a window; without an order an aggregate sees its whole partition."""
    if not s.orders and s.frame is None:
        return e.over(Window.partitionBy(*s.keys).orderBy(F.lit(1).asc()) if _ranks(e) else Window.partitionBy(*s.keys))
    return e.over(s.build())


def _ranks(e: Column) -> bool:
    name = str(e).lower()
    return any(f in name for f in ("row_number", "rank(", "ntile", "lag(", "lead(", "cume_dist"))


def over_groups(df, e: Column, s: Spec, name: str):
    """``df`` with ``e`` over a GROUPS frame as ``name``: a RANGE frame over the dense rank of the order.

    The rank is computed under the same keys and order, so both windows share one shuffle and sort.
    """
    mode, start, end = s.frame
    if mode != "groups" or not s.orders:
        raise ValueError("over_groups takes an ordered GROUPS frame")
    ranked = df.withColumn("_peer", F.dense_rank().over(Window.partitionBy(*s.keys).orderBy(*s.orders)).cast("long"))
    return ranked.withColumn(name, e.over(Window.partitionBy(*s.keys).orderBy("_peer").rangeBetween(start, end))).drop("_peer")


def row_number(s: Spec = spec) -> Column:
    return F.row_number().over(s.build()).cast("long")


def rank(s: Spec) -> Column:
    return F.rank().over(s.build()).cast("long")


def dense_rank(s: Spec) -> Column:
    return F.dense_rank().over(s.build()).cast("long")


def percent_rank(s: Spec) -> Column:
    return F.percent_rank().over(s.build())


def cume_dist(s: Spec) -> Column:
    return F.cume_dist().over(s.build())


def ntile(n: int, s: Spec) -> Column:
    return F.ntile(n).over(s.build())


def lag(e: Column, s: Spec, offset: int = 1, default=None) -> Column:
    return F.lag(e, offset, default).over(s.build())


def lead(e: Column, s: Spec, offset: int = 1, default=None) -> Column:
    return F.lead(e, offset, default).over(s.build())


def first_value(e: Column, s: Spec) -> Column:
    return F.first_value(e).over(s.build())


def last_value(e: Column, s: Spec) -> Column:
    return F.last_value(e).over(s.build())


def nth_value(e: Column, n: int, s: Spec) -> Column:
    return F.nth_value(e, n).over(s.build())
