"""Packing by optimal length buckets.

Each document is a sequence of its tokens and one end token; longer sequences than ``max_len`` go on in
further pieces, so every token is packed. A histogram of piece lengths over the whole corpus (at most
``max_len`` rows, whatever the corpus) goes to the driver, where dynamic programming chooses the
``n_buckets`` bucket lengths with the least padding, exactly. Inside a bucket, pieces in the order of
(length, id, piece) form batches of ``token_budget // bucket length`` pieces, so a padded batch never
exceeds the budget.

Scale: one scan counts tokens (a written table of counts follows), one map-side combined aggregation makes
the histogram, one range shuffle of narrow rows numbers the pieces. The range is on (bucket, length, id,
piece), so a length that a third of all pieces share is split; only a row per range and bucket meets in
one place, for the offsets.

Null text is an empty text: a sequence of its end token. Null ids sort first. Repeated rows are each
packed; ties in order are equal rows, so which of them takes which place changes nothing. Extra columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, text_batches
from tessella.llm.tokenize import calls, load, public_path


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """The at most ``n_buckets`` bucket lengths (ascending) that pad the fewest tokens in total.

    Each piece goes to the least bucket that holds it, so the largest length is always a bucket. Among
    equal plans the one with fewer buckets wins, then the shorter last boundary.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    if not len(lengths):
        return []
    pieces = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    n = len(lengths)
    # padding of lengths i..j (0-based, inclusive) in a bucket of length j is pieces * L[j] - tokens
    best = lengths * pieces[1:] - tokens[1:]
    backs: list[np.ndarray] = []
    totals = [int(best[-1])]
    for _ in range(1, min(n_buckets, n)):
        after, back = best.copy(), np.zeros(n, dtype=np.int64)
        for j in range(1, n):
            cost = best[:j] + lengths[j] * (pieces[j + 1] - pieces[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(cost.argmin())
            if cost[i] < after[j]:
                after[j], back[j] = cost[i], i + 1
        best = after
        backs.append(back)
        totals.append(int(best[-1]))
    used = int(np.argmin(totals))
    out, j = [int(lengths[-1])], n - 1
    for back in reversed(backs[:used]):
        if back[j]:
            j = int(back[j]) - 1
            out.append(int(lengths[j]))
    return out[::-1]


def _counter(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = load(tokenizer if os.sep in tokenizer else public_path(tokenizer))
        for numbers, texts in calls(batches):
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(model.count(texts), pa.int64())], names=["doc_id", "n"])

    return run


def pack(
    docs: DataFrame,
    scratch: Scratch,
    tokenizer: str = "byte_bpe_50k.json",
    max_len: int = 4096,
    n_buckets: int = 16,
    token_budget: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, n_tokens, bucket (number), bucket_len, batch (number in the bucket), slot (place in
    the batch) of every piece of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    with text_batches(spark):
        counted = scratch.save(rows.mapInArrow(_counter(tokenizer), "doc_id long, n long"), "counts")
    whole = F.floor(F.col("n") / max_len)  # the end token makes n + 1
    piece = F.explode(F.sequence(F.lit(0), whole.cast("int"))).alias("piece")
    pieces = counted.select("doc_id", "n", piece).select(
        "doc_id", "piece", F.least(F.lit(max_len), F.col("n") + 1 - F.col("piece").cast("long") * max_len).cast("int").alias("n_tokens")
    )
    histogram = sorted((r[0], r[1]) for r in pieces.groupBy("n_tokens").count().collect())
    lengths = optimal_buckets([x for x, _ in histogram], [c for _, c in histogram], n_buckets) or [max_len]
    bucket = F.lit(len(lengths) - 1)
    for k in range(len(lengths) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= lengths[k], k).otherwise(bucket)
    order = ("bucket", "n_tokens", "doc_id", "piece")
    dealt = pieces.withColumn("bucket", bucket).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = scratch.save(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    local = F.row_number().over(Window.partitionBy("range", "bucket").orderBy("n_tokens", "doc_id", "piece"))
    offsets = dealt.groupBy("range", "bucket").agg(F.count(F.lit(1)).alias("rows")).select(
        F.col("range").alias("r"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("rows").over(Window.partitionBy("bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    placed = dealt.withColumn("at", local).join(offsets, (F.col("range") == F.col("r")) & (F.col("bucket") == F.col("b")))
    placed = placed.withColumn("at", F.col("at") - 1 + F.col("before"))
    length = F.element_at(F.array(*[F.lit(x) for x in lengths]), F.col("bucket") + 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_len")))
    return placed.withColumn("bucket_len", length).select(
        "doc_id", "piece", "n_tokens", "bucket", "bucket_len",
        F.floor(F.col("at") / room).cast("long").alias("batch"), (F.col("at") % room).cast("long").alias("slot"),
    )
