"""Set operations over positional columns; INTERSECT binds tighter than UNION and EXCEPT."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessella.operators.query import Query

_FOLD = {
    "union": lambda a, b: a.union(b).distinct(),
    "union all": lambda a, b: a.unionAll(b),
    "intersect": lambda a, b: a.intersect(b),
    "intersect all": lambda a, b: a.intersectAll(b),
    "except": lambda a, b: a.subtract(b),
    "except all": lambda a, b: a.exceptAll(b),
}


def _frame(x) -> DataFrame:
    return x.df() if isinstance(x, (Query, SetOp)) else x


@dataclass(frozen=True)
class SetOp:
    """A flat chain of arms; a SetOp given as an arm is a parenthesis."""

    first: DataFrame
    rest: tuple[tuple[str, DataFrame], ...] = ()

    def _add(self, op: str, arm) -> SetOp:
        arm = _frame(arm)
        if len(arm.columns) != len(self.first.columns):
            raise ValueError("arms of a set operation need the same number of columns")
        mine = [f.dataType for f in self.first.schema.fields]
        if mine != [f.dataType for f in arm.schema.fields]:
            raise ValueError("arms of a set operation need the same types")
        return SetOp(self.first, (*self.rest, (op, arm)))

    def union(self, arm) -> SetOp:
        return self._add("union", arm)

    def union_all(self, arm) -> SetOp:
        return self._add("union all", arm)

    def intersect(self, arm) -> SetOp:
        return self._add("intersect", arm)

    def intersect_all(self, arm) -> SetOp:
        return self._add("intersect all", arm)

    def except_(self, arm) -> SetOp:
        return self._add("except", arm)

    def except_all(self, arm) -> SetOp:
        return self._add("except all", arm)

    def df(self) -> DataFrame:
        terms: list[tuple[str, DataFrame]] = [("", self.first)]
        for op, arm in self.rest:
            if op.startswith("intersect"):
                before, left = terms.pop()
                terms.append((before, _FOLD[op](left, arm)))
            else:
                terms.append((op, arm))
        out = terms[0][1]
        for op, arm in terms[1:]:
            out = _FOLD[op](out, arm)
        return out


def set_op(first) -> SetOp:
    return SetOp(_frame(first))
