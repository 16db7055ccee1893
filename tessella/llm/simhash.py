"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: a bit is 1 if it is set in more than half of the XXH64 hashes of a text's word shingles.

Candidates: the bits are dealt into partitions, correlated bits together, and partition ``i`` gets a
threshold ``t_i`` (-1: not probed) with ``sum(t_i) = distance - partitions + 1``. Two fingerprints within
``distance`` then differ by at most ``t_i`` bits in some partition (were it not so, they would differ by
at least ``sum(t_i + 1) = distance + 1``). Dynamic programming picks the partitions and thresholds with
the least estimated cost, rows probed plus candidates, where candidates come from how often the
fingerprints of a bounded sample agree in each partition. The sample only shapes the plan: every
choice finds every link.

Probing: a fingerprint enters the index of partition ``i`` under its own bits, and probes with all keys
within ``t_i`` bits. Probes and entries of a key meet in one bucket. Equal fingerprints are one row. A
bucket is not turned into pairs: it is read in blocks of ``block_rows``, pairs of blocks are compared by
numpy (exclusive or, bit count) and only the links of a spanning forest leave a task, at most one less
than its rows.

Large buckets, above ``block_rows``, are not compared whole: the bits outside their partition are dealt into ``distance + 1``
further ones, in one of which two fingerprints within the distance agree, and rows meet by that key as well. So a
bucket of random fingerprints falls into thousands. What is large even then is dealt over tasks as pairs of
blocks, so that no task holds more than two blocks of a bucket.

Components then follow from the forest links (see :mod:`tessella.llm.components`).

Null text is empty text: its fingerprint is zero and links like any other. Texts with fewer words than a
shingle are hashed as one sequence. Repeated rows and ties share a fingerprint. Null ids sort last and
their rows join no component but their own. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, freed_shuffles, text_batches
from tessella.llm.components import components

BITS = 64
#: Bits of each value of a byte, for counting set bits by histograms of bytes.
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Unsigned XXH64 (seed 42) of the shingles of a lower-cased text, repeats included."""
    import xxhash

    hashed, words = xxhash.xxh64_intdigest, text.lower().split()
    if len(words) < width:
        return np.array([hashed(b" ".join(words), 42)] if words else [], dtype=np.uint64)
    if width == 3:
        grams = [b"%b %b %b" % g for g in zip(words, words[1:], words[2:], strict=False)]
    else:
        grams = [b" ".join(g) for g in zip(*(words[k:] for k in range(width)), strict=False)]
    return np.fromiter((hashed(g, 42) for g in grams), dtype=np.uint64, count=len(grams))


def fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes; no hashes give zero."""
    if not len(hashes):
        return 0
    each = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) > 64:
        counts = np.concatenate([np.bincount(each[:, j], minlength=256) @ _BYTE_BITS for j in range(8)])
    else:
        counts = np.unpackbits(each, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(shingle_hashes(text.encode(), width)) for text in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "p0"])

    return run


def fingerprint_table(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p0) of every document, the fingerprint as a signed long. Lazy."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(_fingerprints(width), "doc_id long, p0 long")


@dataclass(frozen=True)
class Partition:
    """Bits (by place) and the threshold of one partition."""

    bits: tuple[int, ...]
    threshold: int


def _extract(prints: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The chosen bits of each fingerprint (a row of words), packed."""
    out = np.zeros(len(prints), dtype=np.uint64)
    for place, bit in enumerate(bits):
        out |= ((prints[:, bit // BITS] >> np.uint64(bit % BITS)) & np.uint64(1)) << np.uint64(place)
    return out


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints along the last axis."""
    return np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int64)


def _correlated_order(sample: np.ndarray) -> list[int]:
    """Bits in an order that puts correlated ones side by side (a greedy chain over |correlation|)."""
    size = sample.shape[1] * BITS
    table = np.concatenate([(sample[:, k : k + 1] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1) for k in range(sample.shape[1])], axis=1).astype(np.float64)
    table -= table.mean(axis=0)
    norm = np.sqrt((table**2).sum(axis=0))
    norm[norm == 0] = 1
    linked = np.abs(table.T @ table / np.outer(norm, norm))
    order, left = [0], set(range(1, size))
    while left:
        order.append(max(left, key=lambda b: (linked[order[-1], b], -b)))
        left.remove(order[-1])
    return order


def plan_partitions(sample: np.ndarray, distance: int, total: int, most_probes: int = 400) -> list[Partition]:
    """Partitions and unequal thresholds of least estimated cost for ``total`` distinct fingerprints.

    For each number of partitions, correlated bits fill partitions in order and dynamic programming over
    (partition, threshold spent) picks the thresholds. The cost of a threshold is the keys probed plus the
    estimated fingerprints met, both per fingerprint.
    """
    sample = np.unique(np.asarray(sample, dtype=np.uint64).reshape(-1, 1), axis=0)
    order = _correlated_order(sample) if len(sample) > 1 else list(range(BITS))
    best: tuple[float, list[Partition]] = (float("inf"), [])
    for count in range(1, distance + 2):
        cuts = np.linspace(0, BITS, count + 1).round().astype(int)
        parts = [tuple(order[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        spend = distance - count + 1
        if spend < 0:
            continue
        costs = []
        for bits in parts:
            keys = _extract(sample, bits)
            apart = np.bitwise_count(keys[:, None] ^ keys[None, :]) if len(keys) > 1 else np.full((1, 1), BITS)
            np.fill_diagonal(apart, 255)
            row = [0.0]
            for t in range(spend + 1):
                share = max((apart <= t).sum() / max(1, len(keys) * (len(keys) - 1)), sum(comb(len(bits), k) for k in range(t + 1)) / 2.0 ** len(bits))
                row.append(1 + sum(comb(len(bits), k) for k in range(t + 1)) + share * total)
            costs.append(row)  # at place t + 1
        # spent counts t + 1 over the partitions so far; the sum must be spend + count
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in costs:
            after: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, chosen) in reach.items():
                for more in range(len(row)):
                    new = (cost + row[more], [*chosen, more - 1])
                    if spent + more <= spend + count and new[0] < after.get(spent + more, (float("inf"),))[0]:
                        after[spent + more] = new
            reach = after
        cost, chosen = reach[spend + count]
        probes = sum(sum(comb(len(b), k) for k in range(t + 1)) for b, t in zip(parts, chosen, strict=True))
        if cost < best[0] and probes <= most_probes:
            best = (cost, [Partition(b, t) for b, t in zip(parts, chosen, strict=True) if t >= 0])
    return best[1]


def _flips(bits: int, threshold: int) -> np.ndarray:
    """All masks of 1 to ``threshold`` set bits."""
    masks = [sum(1 << b for b in chosen) for k in range(1, threshold + 1) for chosen in combinations(range(bits), k)]
    return np.array(masks, dtype=np.uint64)


def _probes(plan: list[Partition]):
    """(part, key, entry, node, p0) rows of (node, p0): one entry and the probes of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, own_print = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            prints = own_print.view(np.uint64)[:, None]
            for number, part in enumerate(plan):
                own = _extract(prints, part.bits)
                masks = _flips(len(part.bits), part.threshold)
                keys = np.concatenate([own, *[own ^ m for m in masks]])
                rows, times = len(keys), 1 + len(masks)
                columns = [np.full(rows, number, dtype=np.int32), keys.view(np.int64), np.arange(rows) < len(node)]
                columns += [np.tile(c, times) for c in (node, own_print)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "key", "entry", "node", "p0"])

    return run


def rest_parts(part: Partition, distance: int) -> list[tuple[int, ...]]:
    """The bits outside a partition in ``distance + 1`` parts."""
    rest = [b for b in range(BITS) if b not in set(part.bits)]
    return [tuple(rest[k :: distance + 1]) for k in range(distance + 1)]


def _again(plan: list[Partition], distance: int):
    """Rows of large buckets under the key of each part of the other bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            number = batch.column(0).to_numpy(zero_copy_only=False)
            prints = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in batch.columns[names.index("node") + 1 :]], axis=1)
            for which in np.unique(number):
                own = np.flatnonzero(number == which)
                rows = batch.take(pa.array(own))
                for sub, bits in enumerate(rest_parts(plan[which], distance)):
                    keys = _extract(prints[own], bits).view(np.int64)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(own), sub, dtype=np.int32)), pa.array(keys)], names=[*names, "sub", "subkey"])

    return run


class Trees:
    """Disjoint sets of ids; the least id is a set's root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def join(self, u: int, v: int) -> bool:
        """Whether the two were apart."""
        p, q = self.root(u), self.root(v)
        if p != q:
            self.parent[max(p, q)] = min(p, q)
        return p != q


def forest(left: np.ndarray, left_ids: np.ndarray, right: np.ndarray, right_ids: np.ndarray, distance: int, tile: int = 1024) -> list[tuple[int, int]]:
    """Links (ids) of a spanning forest among all pairs of ``left`` x ``right`` within ``distance``.

    Tile by tile, each row that is near a row of another tree joins it, until none is; so dense tiles cost a few
    rounds over their matrix and not a step for each pair.
    """
    trees, links = Trees(), []
    for i in range(0, len(left), tile):
        for j in range(0, len(right), tile):
            near = _apart(left[i : i + tile, None], right[None, j : j + tile]) <= distance
            rows, columns = left_ids[i : i + tile].tolist(), right_ids[j : j + tile].tolist()
            while True:
                own = np.array([trees.root(x) for x in rows])
                other = np.array([trees.root(x) for x in columns])
                apart = near & (own[:, None] != other[None, :])
                open_rows = np.flatnonzero(apart.any(axis=1))
                if not len(open_rows):
                    break
                for x, y in zip(open_rows.tolist(), apart[open_rows].argmax(axis=1).tolist(), strict=True):
                    if trees.join(rows[x], columns[y]):
                        links.append((min(rows[x], columns[y]), max(rows[x], columns[y])))
    return links


#: Buckets up to this size are compared many at once, by shifting all rows against each other.
SMALL_BUCKET = 64


def _small_links(group: np.ndarray, prints: np.ndarray, ids: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All links (ids) inside runs of equal ``group``, every run of at most SMALL_BUCKET rows."""
    left, right = [], []
    for shift in range(1, SMALL_BUCKET):
        same = group[shift:] == group[:-shift]
        if not same.any():
            break
        at = np.flatnonzero(same)
        at = at[_apart(prints[at], prints[at + shift]) <= distance]
        left.append(ids[at])
        right.append(ids[at + shift])
    none = np.array([], dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def spanning(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The links, in order, that join two trees of those before."""
    trees = Trees()
    return [(min(u, v), max(u, v)) for u, v in links if trees.join(u, v)]


#: Rows that agree in these meet.
PLACE = ("part", "key", "sub", "subkey", "i", "j")


def _compare(distance: int):
    """Links among sorted rows (those of PLACE, side, node, p0); side 2 meets all, 0 meets 1.

    Only the last run of a batch waits for the next one, so a worker holds a batch and one block pair.
    """

    def links(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        change = np.zeros(len(rows["part"]), dtype=bool)
        for name in PLACE:
            change[1:] |= rows[name][1:] != rows[name][:-1]
        group = np.cumsum(change)
        sizes = np.bincount(group) if len(group) else np.array([], dtype=np.int64)
        small = (sizes <= SMALL_BUCKET)[group] & (rows["side"] == 2)
        us, vs = _small_links(group[small], rows["print"][small], rows["node"][small], distance)
        found = list(zip(us.tolist(), vs.tolist(), strict=True))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for g in np.flatnonzero((sizes > SMALL_BUCKET) | (rows["side"][starts[:-1]] != 2) if len(sizes) else []):
            own = slice(starts[g], starts[g + 1])
            side, prints, ids = rows["side"][own], rows["print"][own], rows["node"][own]
            found += forest(prints[side != 1], ids[side != 1], prints[side != 0], ids[side != 0], distance)
        kept = spanning(found)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.int64()) for k in (0, 1)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            new = {name: batch.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(batch.schema.names)}
            new["print"] = new.pop("p0").astype(np.int64).view(np.uint64)[:, None]
            rows = new if held is None else {k: np.concatenate([held[k], new[k]]) for k in new}
            last = np.ones(len(rows["part"]), dtype=bool)
            for name in PLACE:
                last &= rows[name] == rows[name][-1:]
            cut = len(last) - int(last.sum())
            held = {k: v[cut:] for k, v in rows.items()}
            if cut:
                yield links({k: v[:cut] for k, v in rows.items()})
        if held is not None and len(held["part"]):
            yield links(held)

    return run


def near_links(reps: DataFrame, scratch: Scratch, distance: int = 3, sample_rows: int = 2000, block_rows: int = 4096) -> DataFrame:
    """Links (u, v) between the nodes of distinct fingerprints (node, p0) that keep all components of ``distance``.

    ``sample_rows`` bounds the sample that shapes the plan; it is the same at every size of input.
    """
    total = reps.count()
    rows = reps.orderBy(F.xxhash64("p0"), "p0").limit(sample_rows).collect()
    sample = np.array([r.p0 for r in rows], dtype=np.int64).view(np.uint64)
    plan = plan_partitions(sample, distance, max(total, 1))
    fields = "part int, key long, entry boolean, node long, p0 long"
    rows = scratch.save(reps.select("node", "p0").mapInArrow(_probes(plan), fields), "probes")

    def large_of(rows: DataFrame, name: str, *keys: str) -> DataFrame:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("entry").cast("long")).alias("entries"))
        return scratch.save(sizes.filter(F.col("n") > block_rows).select(*[F.col(k).alias(f"_{k}") for k in keys], "n", "entries"), name)

    on = lambda *keys: reduce(and_, [F.col(k) == F.col(f"_{k}") for k in keys])
    whole = rows.withColumns({"sub": F.lit(-1), "subkey": F.lit(0).cast("long")})
    large = large_of(rows, "buckets", "part", "key").drop("n", "entries")
    if large.take(1):
        met = rows.join(large, on("part", "key")).drop("_part", "_key")
        again = scratch.save(met.mapInArrow(_again(plan, distance), f"{fields}, sub int, subkey long"), "probes-again")
        whole = whole.join(large, on("part", "key"), "left_anti").union(again.select(*whole.columns))
    else:
        again = None
    keys = PLACE[:4]
    if again is None:
        met = whole.withColumns({"n": F.lit(None).cast("long"), "entries": F.lit(None).cast("long")})
    else:  # a small bucket is one block; in one that is large still blocks of entries meet blocks of rows
        met = whole.join(large_of(again, "buckets-again", *keys), on(*keys), "left").drop(*[f"_{k}" for k in keys])
    pair = "array<struct<i:int,j:int,side:int>>"
    blocks = lambda n: F.ceil(F.col(n) / block_rows).cast("int")
    spot = F.xxhash64("node")
    as_entry = F.when(F.col("entry"), F.transform(F.sequence(F.lit(0), blocks("n") - 1), lambda j: F.struct(F.pmod(spot, blocks("entries")).cast("int").alias("i"), j.alias("j"), F.lit(0).alias("side"))))
    as_row = F.transform(F.sequence(F.lit(0), blocks("entries") - 1), lambda i: F.struct(i.alias("i"), F.pmod(spot, blocks("n")).cast("int").alias("j"), F.lit(1).alias("side")))
    single = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")))
    spots = (
        F.when(F.col("n").isNull(), single).when(F.col("entries") == 0, F.array().cast(pair))  # probes alone need not meet
        .otherwise(F.concat(F.coalesce(as_entry, F.array().cast(pair)), as_row))
    )
    dealt = met.select(*keys, "node", "p0", F.explode(spots).alias("b")).select(*keys, "b.i", "b.j", "b.side", "node", "p0")
    links = dealt.repartition(*PLACE).sortWithinPartitions(*PLACE, "side").mapInArrow(_compare(distance), "u long, v long")
    links = scratch.save(links.distinct(), "print-links")
    scratch.drop("probes", "buckets", *(["probes-again", "buckets-again"] if again is not None else []))
    return links


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable) of every document."""
    spark = docs.sparkSession
    with freed_shuffles(spark):
        with text_batches(spark, 256):
            prints = scratch.save(fingerprint_table(docs, width), "fingerprints")
        reps = scratch.save(prints.groupBy("p0").agg(F.min("doc_id").alias("node")), "reps")
        with text_batches(spark, 10000):
            links = near_links(reps.filter("node is not null"), scratch, distance)
        found = components(links, scratch).select(F.col("id").alias("node"), "component")
        rooted = reps.join(found, "node", "left").select(F.col("p0").alias("r"), F.coalesce("component", "node").alias("component_id"))
        rooted = scratch.save(rooted, "rooted")
    return prints.join(rooted, F.col("p0") == F.col("r")).select("doc_id", F.lower(F.lpad(F.hex("p0"), 16, "0")).alias("fingerprint"), "component_id")
