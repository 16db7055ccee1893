"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features: words (runs of letters, digits and underscores, lower-cased), pairs of neighbours, pairs with one word
between, and the first five letters of longer words (for endings never learned from), hashed to ``dims``
places, each present or not. FTRL-proximal keeps a learning rate for
every coordinate, and its L1 term leaves most weights exactly zero, so the broadcast model is the few that
are not.

Learning: at most ``sample_rows`` labelled rows, the first by the order of a hash of their ids, turned to places on
the executors; the driver passes over them ``epochs`` times in fixed orders. The bounds are the same at
every size of input. Rows with null labels are not learned from.

Scoring: one scan over whole texts with the broadcast weights, no shuffle.

Null or empty texts score what the intercept says. Without labelled rows every score is 0.5 less a hair, so nothing
is predicted toxic. Null ids are never learned from and not held out. Documents with several different labels are
learned from once for each; of rows that share an id one text is learned from. Repeated rows are each scored. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, crc_bucket, text_batches

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityModel:
    """Non-zero weights by place, and the intercept."""

    dims: int
    places: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        table = np.zeros(self.dims, dtype=np.float32)
        table[self.places] = self.weights
        return table


def feature_places(text: str, dims: int) -> np.ndarray:
    """Distinct places of the words, the pairs, the skip pairs and the word beginnings of a text."""
    import xxhash

    hashed, words = xxhash.xxh64_intdigest, _WORD.findall(text.lower())
    one = np.fromiter((hashed(w) for w in words), dtype=np.uint64, count=len(words))
    odd, skip = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    heads = {w[:5] for w in words if len(w) > 5}
    begun = np.fromiter((hashed(w, 1) for w in heads), dtype=np.uint64, count=len(heads))
    mixed = np.concatenate([one, (one[:-1] * odd + one[1:]) * skip, (one[:-2] * skip + one[2:]) * odd, begun])
    mixed ^= mixed >> np.uint64(31)
    return np.unique((mixed * odd) >> np.uint64(64 - dims.bit_length() + 1)).astype(np.int32)


class FtrlProximal:
    """Per-coordinate FTRL-proximal with L1 and L2 terms; weights follow from the sums on demand."""

    def __init__(self, dims: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(dims + 1)  # the last is the intercept
        self.n = np.zeros(dims + 1)

    def weights(self, places: np.ndarray) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, places: np.ndarray, label: int) -> None:
        places = np.append(places, len(self.z) - 1)
        w = self.weights(places)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[places]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[places] += g - sigma * w
        self.n[places] = n + g * g


def _places(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [feature_places(t, dims).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["spot", "label", "places"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 12000, dims: int = 1 << 18, epochs: int = 4) -> ToxicityModel:
    """Learn from ``labels`` (doc_id, toxic) and the texts of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("label")).distinct()
    chosen = known.withColumn("spot", F.xxhash64("doc_id")).orderBy("spot", "doc_id", "label").limit(sample_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    with text_batches(spark):
        joined = texts.join(F.broadcast(chosen), "doc_id")  # at most sample_rows rows are broadcast
        # one text an id, so no more than the chosen rows reach the driver
        joined = joined.groupBy("spot", "doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("spot", "label", "text")
        rows = joined.mapInArrow(_places(dims), "spot long, label int, places binary").collect()
    rows.sort(key=lambda r: (r.spot, r.label, bytes(r.places)))
    learner = FtrlProximal(dims)
    examples = [(np.frombuffer(r.places, dtype=np.int32), r.label) for r in rows]  # as bytes, some 6 KB a row
    del rows
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            learner.learn(*examples[k])
    if not examples:
        return ToxicityModel(dims, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), -1e-6)
    w = learner.weights(np.arange(dims + 1))
    kept = np.flatnonzero(w[:-1])
    return ToxicityModel(dims, kept, w[kept].astype(np.float32), float(w[-1]))


def score(docs: DataFrame, model: ToxicityModel, held_out: Column, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        table = known.dense()
        for batch in batches:
            sums = [table[feature_places(t, known.dims)].sum(dtype=np.float64) + known.bias for t in batch.column(2).to_pylist()]
            scores = 1 / (1 + np.exp(-np.clip(np.array(sums, dtype=np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    with text_batches(spark):
        return scratch.save(rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int"), "scores")


def toxicity(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The contract's row per document, learned from labels whose crc32 bucket of five is not 0."""
    model = fit(docs, labels.filter(crc_bucket(F.col("doc_id"), 5) != 0))
    return score(docs, model, crc_bucket(F.col("doc_id"), 5) == 0, scratch)
