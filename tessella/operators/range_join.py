"""Overlap joins of half-open intervals as equi-joins on bins.

A join on ``a.lo < b.hi and b.lo < a.hi`` has no equality to shuffle by, so Spark would compare all pairs. Here each
interval enters the bins it touches, pairs meet in bins, and a pair counts only in the bin where the later of the two
starts lies, so that it appears once. Choose a width near the typical length: an interval of length ``n`` makes
``n / width + 1`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, left_bounds: tuple[Column, Column], right_bounds: tuple[Column, Column], width: int) -> DataFrame:
    """Pairs of rows whose [lo, hi) overlap; bounds are integer columns of either side, NULL bounds match nothing.

    The sides need columns of different names. Empty intervals overlap nothing.
    """
    if set(left.columns) & set(right.columns):
        raise ValueError("the sides of an overlap join need columns of different names")

    def binned(df: DataFrame, bounds: tuple[Column, Column], tag: str) -> DataFrame:
        lo, hi = bounds
        rows = df.withColumns({f"_{tag}lo": lo.cast("long"), f"_{tag}hi": hi.cast("long")}).filter(F.col(f"_{tag}lo") < F.col(f"_{tag}hi"))
        first, last = F.floor(F.col(f"_{tag}lo") / width), F.floor((F.col(f"_{tag}hi") - 1) / width)
        return rows.withColumn(f"_{tag}bin", F.explode(F.sequence(first, last)))

    met = binned(left, left_bounds, "l").join(binned(right, right_bounds, "r"), F.col("_lbin") == F.col("_rbin"))
    overlap = (F.col("_llo") < F.col("_rhi")) & (F.col("_rlo") < F.col("_lhi"))
    once = F.col("_lbin") == F.floor(F.greatest("_llo", "_rlo") / width)
    return met.filter(overlap & once).select(*left.columns, *right.columns)
