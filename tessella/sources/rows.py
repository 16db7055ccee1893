"""Row sources: input tables, literal rows, series, unnested arrays and the single empty row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options) -> DataFrame:
    """Files of any format the session reads (parquet, orc, json, csv, text, avro where its package is loaded).

    Text formats need ``schema`` (a relation's ``struct()``), else they would be scanned once more to guess it.
    """
    if schema is None and kind in ("json", "csv"):
        raise ValueError(f"{kind} files need a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), **options) -> None:
    """Write a fresh path; nothing that is there is replaced."""
    df.write.format(kind).options(**options).partitionBy(*partition_by).mode("errorifexists").save(path)


def values(spark: SparkSession, rows: list[dict], schema: str | None = None) -> DataFrame:
    """Literal rows of dictionaries with the same keys; at least one."""
    if not rows:
        raise ValueError("VALUES needs at least one row")
    names = list(rows[0])
    if any(list(r) != names for r in rows):
        raise ValueError("all rows of VALUES need the same columns in the same order")
    return literal(spark, [tuple(r[n] for n in names) for r in rows], schema or names)


def literal(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """Rows that stand in the plan itself, so that Spark knows their size and broadcasts them to a larger side.

    Of a list alone it would take the size to be unknown, and joins would sort the larger side by its keys.
    """
    jvm, done = spark._jvm, spark.createDataFrame(rows, schema)._jdf.queryExecution()
    held = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(done.executedPlan().executeCollect())
    relation = jvm.org.apache.spark.sql.catalyst.plans.logical.LocalRelation(done.analyzed().output(), held, False, jvm.scala.Option.empty())
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, relation), spark)


def empty(spark: SparkSession) -> DataFrame:
    """One row without columns, for a SELECT without FROM."""
    return spark.range(1).select()


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """Column ``n`` from start to stop; nothing where the step leads away from the stop.

    A range scan, so that long series are made where they are used.
    """
    if step == 0:
        raise ValueError("step size cannot equal zero")
    return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").alias("n"))


def series(start: Column, stop: Column, step: Column | None = None) -> Column:
    """The series as an array of each row's own bounds, for a lateral join."""
    step = F.lit(1) if step is None else step
    fits = ((step > 0) & (start <= stop)) | ((step < 0) & (start >= stop))
    checked = F.when(step == 0, F.raise_error("step size cannot equal zero").cast("int")).otherwise(step)
    none = F.array().cast("array<bigint>")
    return F.when(fits | (step == 0), F.transform(F.sequence(start, stop, checked), lambda x: x.cast("bigint"))).otherwise(none)


def unnest(df: DataFrame, array: Column, name: str = "v", keep: list[str] | None = None) -> DataFrame:
    """A row per element next to the row's own columns; NULL and empty arrays give none."""
    kept = df.columns if keep is None else keep
    return df.select(*kept, F.explode(array).alias(name))
