"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A test item is in a document if at least ``containment`` of the item's distinct ``width``-word shingles
are among the document's. Words are runs of letters, digits and underscores, lower-cased; an item of
fewer words is one shingle of all its words; an item without words matches nothing.

Candidates: items are partitioned by their number of shingles into parts of equal depth. All items of a
part get a bottom-k MinHash sketch, k fitted to the part's largest item ``u`` as
``floor((1 - containment) * u) + 1``. An item of ``n <= u`` shingles that a document contains lacks at most
``m = floor((1 - containment) * n)`` shingles there, so at least ``min(k, n) - m >= 1`` of its sketch is among
the document's hashes: no contained item is missed, however long the document. Documents are hashed
whole, without sketches, so long documents lose nothing.

Verification: the item's shingles, as text, are counted in the document. Hash collisions can only add
candidates.

Scale: one scan, no shuffle. Items are read ``block_bytes`` of text at a time; the index that is broadcast is pickled and measured, and
halved until it is within ``index_bytes``. Each index more is one more scan, so a benchmark takes as many as its size asks for.

Null or empty texts match nothing. Repeated items each match. Extra columns are not read.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import text_batches

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _shingle_hashes(words: list[str], width: int) -> np.ndarray:
    """64-bit hashes of the shingles in order: a polynomial over word hashes, then mixed."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    each = np.fromiter((hashed(w) for w in words), dtype=np.uint64, count=len(words))
    n = len(words) - width + 1
    if n < 1:
        return np.array([], dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * _MIX + each[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _gram(words: list[str], at: int, width: int) -> str:
    return " ".join(words[at : at + width])


@dataclass
class Index:
    """The sketches of a block of items, by shingle width."""

    items: list[tuple[int | None, int, frozenset[str], int]]  # id, shingles, shingles as text, sketch hits needed
    values: dict[int, tuple[np.ndarray, np.ndarray, list[list[int]]]]  # width: table, sorted sketch values, items of each
    hashes: dict[int, np.ndarray]  # width: all item hashes, sorted


def build_index(items: list[tuple[int | None, str]], containment: Fraction, width: int, parts: int) -> Index:
    """Sketch the items; see the module's text for the sizes of sketches."""
    sized = []
    for item, text in items:
        words = _words(text)
        if words:
            own = min(width, len(words))
            grams = frozenset(_gram(words, k, own) for k in range(len(words) - own + 1))
            sized.append((item, own, grams, np.unique(_shingle_hashes(words, own))))
    sized.sort(key=lambda x: len(x[2]))
    built, by_width, all_hashes = [], defaultdict(lambda: defaultdict(list)), defaultdict(list)
    depth = -(-len(sized) // parts) or 1
    for start in range(0, len(sized), depth):
        part = sized[start : start + depth]
        largest = len(part[-1][2])
        k = int((1 - containment) * largest) + 1
        for item, own, grams, hashes in part:
            sketch = hashes[:k]  # hashes are mixed, so the least are a uniform choice
            lacking = int((1 - containment) * len(grams))
            for value in sketch.tolist():
                by_width[own][value].append(len(built))
            all_hashes[own].append(hashes)
            built.append((item, own, grams, max(1, len(sketch) - lacking)))
    values = {}
    for own, found in by_width.items():
        keys = np.array(sorted(found), dtype=np.uint64)
        table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        table[(keys & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True
        values[own] = (table, keys, [found[int(k)] for k in keys])
    return Index(built, values, {own: np.unique(np.concatenate(h)) for own, h in all_hashes.items()})


def bounded_indexes(items: list[tuple[int | None, str]], containment: Fraction, width: int, parts: int, most_bytes: int) -> Iterator[Index]:
    """Indexes over all items, each of at most ``most_bytes`` as it travels; an item alone may be larger."""
    index = build_index(items, containment, width, parts)
    if len(items) < 2 or len(pickle.dumps(index)) <= most_bytes:
        yield index
        return
    for half in (items[: len(items) // 2], items[len(items) // 2 :]):
        yield from bounded_indexes(half, containment, width, parts, most_bytes)


def search(index: Index, text: str, containment: Fraction) -> list[tuple[int | None, int, int]]:
    """(item id, its shingles, those found) of every item that the text contains."""
    words, out = _words(text), []
    for own, (table, keys, owners) in index.values.items():
        hashes = _shingle_hashes(words, own)
        near = np.unique(hashes[table[(hashes & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)]])
        hits = np.intersect1d(near, keys, assume_unique=True)
        if not len(hits):
            continue
        votes: dict[int, int] = defaultdict(int)
        for place in np.searchsorted(keys, hits):
            for item in owners[place]:
                votes[item] += 1
        likely = sorted(item for item, n in votes.items() if n >= index.items[item][3])
        if likely:
            spots = np.flatnonzero(np.isin(hashes, index.hashes[own]))
            present = {_gram(words, int(k), own) for k in spots}
            for item in likely:
                name, _, grams, _ = index.items[item]
                found = len(grams & present)
                if found >= containment * len(grams):
                    out.append((name, len(grams), found))
    return out


def find_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    containment: str = "0.8",
    width: int = 5,
    parts: int = 8,
    block_bytes: int = 8 << 20,
    index_bytes: int = 96 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of each item and document that contains it."""
    spark = docs.sparkSession
    share = Fraction(containment)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = f"doc_id {id_type}, item_id long, n_shingles long, n_found long"

    def finder(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(k, hit) for k, text in enumerate(batch.column(1).to_pylist()) for hit in search(shared.value, text, share)]
                ids = batch.column(0).take(pa.array([k for k, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([h[c] for _, h in found], pa.int64()) for c in range(3)]], names=["doc_id", "item_id", "n_shingles", "n_found"])

        return run

    out = None
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), blocks) == block)
        for index in bounded_indexes([(r[0], r[1]) for r in part.collect()], share, width, parts, index_bytes):
            found = rows.mapInArrow(finder(spark.sparkContext.broadcast(index)), fields)
            out = found if out is None else out.union(found)
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, scratch) -> DataFrame:
    """The pairs as a written table, so that small batches hold while texts are read."""
    with text_batches(docs.sparkSession):
        return scratch.save(find_contaminated(docs, benchmark), "pairs")
