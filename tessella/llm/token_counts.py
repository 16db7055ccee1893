"""Token counts through a digest cache.

Content is normalised as a text the tokenizer sees (null becomes empty, nothing else changes, since
every other change could alter a count), digested with SHA-256, and joined with the tokenizer file's
own digest to a Parquet cache. Only distinct contents that the cache lacks are encoded; their counts
are appended to it.

Scale: one shuffle carries texts, and only one copy of each content after map-side combination; a text
that a third of all rows hold costs one row a task there. The join back carries digests and counts only,
both sides straight from written tables, so adaptive execution can split a hot digest.

Null ids pass through; repeated rows each get their count; empty text has no tokens. Extra columns are
not read. The cache expects one writer at a time; rows that two writers both added count once.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, path_exists, text_batches
from tessella.llm.tokenize import load, public_path, version_digest


def _resolve(tokenizer: str) -> str:
    return tokenizer if os.sep in tokenizer else public_path(tokenizer)


def _encoder(tokenizer: str):
    """Counts of batches of (digest, content); the file is looked up where the task runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = load(_resolve(tokenizer))
        for batch in batches:
            counts = model.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame,
    cache: str,
    tokenizer: str = "piece_bpe_32k.model",
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; ``cache`` is a folder of counts.

    ``tokenizer`` is the path of a file or the name of a public one.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "token-counts")
    version = version_digest(_resolve(tokenizer))
    content = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), content.alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    index = scratch.save(rows.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), "digest"), "index")

    stored = None
    if path_exists(spark, cache):
        stored = spark.read.schema("digest binary, n_tokens long, tokenizer string").parquet(cache).filter(F.col("tokenizer") == version)
    distinct = rows.groupBy("digest").agg(F.first("content").alias("content"))
    misses = distinct if stored is None else distinct.join(stored.select("digest"), "digest", "left_anti")
    with text_batches(spark, 256):
        misses.mapInArrow(_encoder(tokenizer), "digest binary, n_tokens long").withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(
            f"{cache}/batch={uuid.uuid4().hex}"
        )
    counts = spark.read.schema("digest binary, n_tokens long, tokenizer string").parquet(f"{cache}/batch=*")
    counts = counts.filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    if stored is not None:  # several batches, so perhaps several writers
        counts = scratch.save(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return index.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
