"""What the training-data operators share: scratch tables, batch sizes, table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch where rows carry whole texts; bounds a Python worker's memory.
TEXT_BATCH_ROWS = 64

#: The white space of the contracts: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

_OWN_BASE: list[str] = []


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all of Spark is this process (unit tests) a temporary folder of it serves.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    if not _OWN_BASE:
        _OWN_BASE.append(tempfile.mkdtemp(prefix="tessella-"))
    return _OWN_BASE[0]


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, whatever store it lies in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its Hadoop file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


class Scratch:
    """Written tables that cut lineage; they live in the shared folder and survive lost executors.

    Tables that a returned DataFrame still reads go at the end of the process, others with ``drop``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_base(spark)}/tessella/{label}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write ``df`` as Parquet and read it back with the same schema."""
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.path(name))

    def _close(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # the session has ended; nothing can be removed through it
            return


@contextmanager
def session_conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Hold session settings (``__`` stands for a dot) while eager steps run."""
    names = {k.replace("__", "."): str(v) for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def freed_shuffles(spark: SparkSession):
    """Shuffle files go when the action that made them ends; for steps that write what later ones read."""
    return session_conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS):
    """Small Arrow batches while steps over whole texts run."""
    return session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(column: Column, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``modulus``; null ids give null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus
