"""Running queries: all rows, exactly one, at most one, or a stream of rows from the partitions in turn."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession


def run(df: DataFrame) -> list[Row]:
    return df.collect()


def unique(df: DataFrame) -> Row:
    """The only row; none or several raise."""
    rows = df.take(2)
    if len(rows) != 1:
        raise LookupError("expected one row, found " + ("none" if not rows else "several"))
    return rows[0]


def option(df: DataFrame) -> Row | None:
    """The only row or None; several raise."""
    rows = df.take(2)
    if len(rows) > 1:
        raise LookupError("expected at most one row, found several")
    return rows[0] if rows else None


def stream(df: DataFrame, chunk_size: int = 64) -> Iterator[list[Row]]:
    """Chunks of rows; the driver holds a partition at a time and fetches the next one ahead."""
    chunk: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        chunk.append(row)
        if len(chunk) == chunk_size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def cursor(df: DataFrame) -> Iterator[Row]:
    return df.toLocalIterator(prefetchPartitions=True)


def to(cls: type, rows: list[Row]) -> list:
    """Rows as dataclass values, by position."""
    names = [f.name for f in dataclasses.fields(cls)]
    return [cls(**dict(zip(names, row, strict=True))) for row in rows]


def later(build: Callable[[SparkSession], DataFrame], how: Callable = run) -> Callable[[SparkSession], object]:
    """A query as a function of the session it will run in."""
    return lambda spark: how(build(spark))
