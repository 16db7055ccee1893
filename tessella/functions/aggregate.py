"""Aggregates with PostgreSQL's result types and NULL rules, as Spark columns.

All work in projections, HAVING, ORDER BY and, with ``over``, as window aggregates. Types that Spark only knows
once a plan is analysed are passed by the caller where they change a result (``of``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def count_all() -> Column:
    return F.count(F.lit(1))


def count(e: Column) -> Column:
    return F.count(e)


def count_distinct(e: Column) -> Column:
    return F.count_distinct(e)


def sum_(e: Column, of: T.DataType | None = None) -> Column:
    """Sum; of bigints as decimal(38,0) so that it cannot overflow a long, of reals as real."""
    if isinstance(of, T.LongType):
        return F.sum(e.cast("decimal(38,0)"))
    if isinstance(of, T.FloatType):
        return F.sum(e).cast("float")
    return F.sum(e)


def avg(e: Column, of: T.DataType | None = None) -> Column:
    """Mean; of integers as decimal with six places more, else as Spark has it."""
    if isinstance(of, (T.ShortType, T.IntegerType, T.LongType)):
        return F.avg(e.cast("decimal(28,6)"))
    return F.avg(e)


def min_(e: Column) -> Column:
    return F.min(e)


def max_(e: Column) -> Column:
    return F.max(e)


def string_agg(e: Column, separator: str, ordered: bool = False) -> Column:
    """Concatenation without NULLs, NULL for none; ``ordered`` sorts the values, so that runs agree."""
    values = F.sort_array(F.collect_list(e)) if ordered else F.collect_list(e)
    return F.when(F.count(e) > 0, F.array_join(values, separator))


def bool_and(e: Column) -> Column:
    return F.bool_and(e)


def bool_or(e: Column) -> Column:
    return F.bool_or(e)


def stddev(e: Column) -> Column:
    return F.stddev_samp(e)


stddev_samp = stddev


def stddev_pop(e: Column) -> Column:
    return F.stddev_pop(e)


def variance(e: Column) -> Column:
    return F.var_samp(e)


var_samp = variance


def var_pop(e: Column) -> Column:
    return F.var_pop(e)


def corr(y: Column, x: Column) -> Column:
    return F.corr(y, x)


def covar_pop(y: Column, x: Column) -> Column:
    return F.covar_pop(y, x)


def covar_samp(y: Column, x: Column) -> Column:
    return F.covar_samp(y, x)


def regr_slope(y: Column, x: Column) -> Column:
    return F.regr_slope(y, x)


def regr_intercept(y: Column, x: Column) -> Column:
    return F.regr_intercept(y, x)


def regr_count(y: Column, x: Column) -> Column:
    return F.regr_count(y, x)


def regr_r2(y: Column, x: Column) -> Column:
    return F.regr_r2(y, x)


def regr_avgx(y: Column, x: Column) -> Column:
    return F.regr_avgx(y, x)


def regr_avgy(y: Column, x: Column) -> Column:
    return F.regr_avgy(y, x)


def regr_sxx(y: Column, x: Column) -> Column:
    return F.regr_sxx(y, x)


def regr_syy(y: Column, x: Column) -> Column:
    return F.regr_syy(y, x)


def regr_sxy(y: Column, x: Column) -> Column:
    return F.regr_sxy(y, x)


def array_agg(e: Column) -> Column:
    """Array of all values, NULLs kept; NULL for no rows."""
    return F.when(F.count(F.lit(1)) > 0, F.transform(F.collect_list(F.struct(e.alias("v"))), lambda s: s["v"]))


def grouping(*columns: Column) -> Column:
    """Bit mask of grouping columns that a row lacks; the last is the lowest bit."""
    n = len(columns)
    mask = F.lit(0)
    for k, c in enumerate(columns):
        mask = mask + F.grouping(c).cast("int") * (1 << (n - 1 - k))
    return mask.cast("int")
