"""Near duplicates at an exact Jaccard similarity of word shingles, by SimHash first and by prefixes for the rest.

Two texts link if ``|A & B| / |A | B| >= num / den`` over their sets of shingles (64-bit hashes of lower-cased words;
sets and shingles are told apart by 64 bits). No link is lost and none is added:

1. Every distinct set gets a SimHash fingerprint. The pigeonhole search of :mod:`tessella.llm.simhash` probes for
   fingerprints within ``distance`` bits.
2. Fingerprints of sets at a similarity of 0.8 lie some 10 of 64 bits apart, with a spread that no planned pigeonhole
   search can probe. So sets also meet by the least hash of each of 8 ranges (one-permutation MinHash). The links of both
   searches are verified on the whole sets, and components follow; they join most copies, however large their group.
3. What is left are links between different components, and they are found exactly: the shingles of every set are put in one
   common order; sets that are similar enough share one of their first ``n - ceil(n * num / den) + 1`` (prefix filter), and the
   places of a shared one tell how many they can share at all (positional filter, which bounds the sizes too). The order
   puts shingles that a sample finds common last; the sample only shapes the order: every order finds every link.

Candidates under a key of few rows are pairs at once. Rows of larger keys get bitmaps of the parity of shingles in bins, which
tell how many only one of two sets must have; a key's candidates are first a spanning forest, at most a row less than its
rows, then all that are still apart. Pairs are held against the bitmaps, too, before they are verified.

Copies of a text are one set. Null text is empty text; empty sets are equal. Texts with fewer words than a shingle are
one sequence. Ids must be unique and not null. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, freed_shuffles, text_batches
from tessella.llm.components import components
from tessella.llm.repeats import Words
from tessella.llm.simhash import Trees, fingerprint, near_links

#: One of so many texts is read for common shingles (all of small tables); so many of them are put last.
SAMPLE, COMMON = 16, 1 << 18
#: Bins of a bitmap at least and at most, powers of two.
LEAST_BINS, MOST_BINS = 64, 1 << 16
#: Ranges of hashes, as a power of two, whose least ones are met first.
RANGE_BITS = 3
#: Rows of a bucket that are compared with it at once.
BLOCK = 512
#: Rows of a key up to which its candidates are pairs at once.
SMALL = 8


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; the texts are hashed together."""
    import xxhash

    unit = Words(2 * width, width)
    viewed = [unit.view((t or "").lower().encode()) if (t or "").isascii() else unit.view((t or "").encode().lower()) for t in texts]
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(texts)
    at = 0
    while at < len(texts):  # as many texts as make a megabyte
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(viewed[upto][0]) <= 1 << 20):
            size += len(viewed[upto][0])
            upto += 1
        views, offsets = viewed[at:upto], np.cumsum([0, *(len(v) for v, _ in viewed[at:upto])])
        places = np.concatenate([p + o for (_, p), o in zip(views, offsets, strict=False)])
        hashes = unit.grams(np.frombuffer(b"".join(v for v, _ in views), np.uint8), places)
        first = 0
        for k, (view, own) in enumerate(views, at):
            words = len(own) - 1
            if words >= width:
                found = np.sort(hashes[first : first + words - width + 1])
                out[k] = found[np.r_[True, found[1:] != found[:-1]]]
            elif view.strip():
                out[k] = np.array([xxhash.xxh64_intdigest(view)], dtype=np.uint64)
            first += len(own)
        at = upto
    return out


def bitmap(own: np.ndarray) -> bytes:
    """For each bin the parity of how many shingles fall into it; four bins or more a shingle, up to MOST_BINS."""
    size = min(MOST_BINS, max(LEAST_BINS, 1 << (4 * len(own)).bit_length()))
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def stacked(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of words of the least size; the parities of bins that fall together add up."""
    least, out = min(map(len, maps)), np.empty((len(maps), min(map(len, maps)) // 8), dtype=np.uint64)
    for k, one in enumerate(maps):
        words = np.frombuffer(one, dtype="<u8")
        out[k] = words if len(one) == least else np.bitwise_xor.reduce(words.reshape(-1, least // 8), axis=0)
    return out


def _set_id(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles of a set in the common order, of which similar sets share one."""
    count = len(own) - -(-len(own) * num // den) + 1 if len(own) else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        last = common[at] == own
        own = np.concatenate([own[~last], own[last][np.argsort(rank[at[last]])]])
    return own[:count]


def range_minima(own: np.ndarray) -> np.ndarray:
    """The least hash of each range that holds one."""
    bounds = np.searchsorted(own, np.arange(1 << RANGE_BITS, dtype=np.uint64) << np.uint64(64 - RANGE_BITS))
    return own[bounds[bounds < np.append(bounds[1:], len(own))]]


def _described(width: int, shared_order, num: int, den: int):
    """(doc_id, node, n, p0, bits, minima, prefix) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = shared_order.value
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            columns = [
                batch.column(0), pa.array([_set_id(own) for own in sets], pa.int64()), pa.array([len(own) for own in sets], pa.int32()),
                pa.array(np.array([fingerprint(own) for own in sets], dtype=np.uint64).view(np.int64)),
                pa.array([bitmap(own) for own in sets], pa.binary()), pa.array([range_minima(own).tobytes() for own in sets], pa.binary()),
                pa.array([prefix(own, common, rank, num, den).tobytes() for own in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n", "p0", "bits", "minima", "prefix"])

    return run


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(0).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array([], np.uint64), *sets]).view(np.int64))], names=["key"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.tobytes() for own in sets], pa.binary())], names=["node", "shingles"])

    return run


def _dealt(ordered: bool):
    """(key, node, comp, n, pos) of each hash of (node, comp, n, hashes); places count where hashes are in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, comp, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            keys = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(3)]
            counts = np.array([len(k) for k in keys], dtype=np.int64)
            places = np.concatenate([np.array([], np.int32), *(np.arange(c, dtype=np.int32) * ordered for c in counts)]).astype(np.int32)
            columns = [np.concatenate([np.array([], np.int64), *keys]), np.repeat(node, counts), np.repeat(comp, counts), np.repeat(size, counts), places]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "comp", "n", "pos"])

    return run


def may_match(n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of sizes ``n`` and ``m`` that share a shingle at these places can be similar enough."""
    most = np.minimum(pos, at) + np.minimum(n - pos, m - at)
    return most * (num + den) >= num * (n + m)


def may_differ(bits: np.ndarray, others: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these bitmaps (last axis) and sizes can be similar enough."""
    return np.bitwise_count(bits ^ others).sum(axis=-1, dtype=np.int64) * (num + den) <= (den - num) * (n + m)


def _buckets(make, names: list[str], kinds: list):
    """Batches of what ``make`` yields for the rows of one or more whole keys (sorted by key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []  # of one key
        give = lambda rows: (pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names) for out in make(rows) if len(out[0]))
        joined = lambda parts: {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {name: batch.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(batch.schema.names)}
            cut = int(np.searchsorted(rows["key"], rows["key"][-1]))
            if cut or (held and held[0]["key"][0] != rows["key"][0]):
                yield from give(joined([*held, {k: v[:cut] for k, v in rows.items()}]))
                held = []
            held.append({k: v[cut:] for k, v in rows.items()})
        if held:
            yield from give(joined(held))

    return run


def _groups(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the keys with rows of different components."""
    starts = np.flatnonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1]]) if len(rows["key"]) else np.zeros(0, dtype=np.int64)
    if not len(starts):
        return starts, starts
    apart = np.minimum.reduceat(rows["comp"], starts) != np.maximum.reduceat(rows["comp"], starts)
    return starts[apart], np.r_[starts[1:], len(rows["key"])][apart]


def _near(n: np.ndarray, pos: np.ndarray, comp: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Starts of two blocks of rows sorted by size, and which rows of the later block may match each of the first."""
    for i in range(0, len(n), BLOCK):
        to = int(np.searchsorted(n, n[min(i + BLOCK, len(n)) - 1] * den // num, side="right"))  # larger sets cannot match
        for j in range(i, to, BLOCK):
            a, b = slice(i, min(i + BLOCK, len(n))), slice(j, min(j + BLOCK, to))
            near = (comp[a, None] != comp[None, b]) & may_match(n[a, None], pos[a, None], n[None, b], pos[None, b], num, den)
            yield i, j, np.triu(near, 1) if i == j else near


def _shared(num: int, den: int, most: int):
    """Candidates of different components under small keys as pairs (their nodes as key and node, ``pos`` of -1), each row with
    the ``most`` rows after it; of larger keys the rows that may match a row of another component."""

    def make(rows):
        keep = np.zeros(len(rows["key"]), dtype=bool)
        starts, ends = _groups(rows)
        sizes = ends - starts
        small = np.zeros(len(keep) + 1, dtype=np.int64)
        np.add.at(small, starts[sizes <= SMALL], 1)
        np.add.at(small, ends[sizes <= SMALL], -1)
        own = np.flatnonzero(np.cumsum(small[:-1]))
        key, node, n, pos, comp = (rows[k][own].astype(np.int64) for k in ("key", "node", "n", "pos", "comp"))
        us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for by in range(1, min(SMALL, most + 1)):
            met = np.flatnonzero(key[by:] == key[:-by])
            if not len(met):
                break
            far = met + by
            near = (comp[met] != comp[far]) & may_match(n[met], pos[met], n[far], pos[far], num, den)
            us.append(np.minimum(node[met[near]], node[far[near]]))
            vs.append(np.maximum(node[met[near]], node[far[near]]))
        for a, b in zip(starts[sizes > SMALL], ends[sizes > SMALL], strict=True):
            n, pos, comp = rows["n"][a:b].astype(np.int64), rows["pos"][a:b].astype(np.int64), rows["comp"][a:b]
            for i, j, near in _near(n, pos, comp, num, den):
                keep[a + i : a + i + near.shape[0]] |= near.any(axis=1)
                keep[a + j : a + j + near.shape[1]] |= near.any(axis=0)
        yield [rows[k][keep] for k in ("key", "node", "comp", "n", "pos")]
        us, vs = np.concatenate(us), np.concatenate(vs)
        yield [us, vs, np.zeros(len(us), np.int64), np.zeros(len(us), np.int32), np.full(len(us), -1, np.int32)]

    return _buckets(make, ["key", "node", "comp", "n", "pos"], [pa.int64()] * 3 + [pa.int32()] * 2)


def _bounded(num: int, den: int):
    """The pairs (u, v, n, bits, m, others) whose bitmaps let them be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, bits, m, others in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                a, b = stacked([bits, others])
                keep.append(bool(may_differ(a, b, n, m, num, den)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _apart(num: int, den: int, forest: bool):
    """Pairs of a key that may match and lie in different components; with ``forest`` those that join further components."""

    def make(rows):
        us, vs = [], []
        for a, b in zip(*_groups(rows), strict=True):
            n, pos, node, comp = (rows[k][a:b].astype(np.int64) for k in ("n", "pos", "node", "comp"))
            bits, trees = stacked(list(rows["bits"][a:b])), Trees()
            for i, j, near in _near(n, pos, comp, num, den):
                x, y = np.nonzero(near)
                some = np.concatenate([np.zeros(0, dtype=bool), *(
                    may_differ(bits[x[s : s + 4096] + i], bits[y[s : s + 4096] + j], n[x[s : s + 4096] + i], n[y[s : s + 4096] + j], num, den) for s in range(0, len(x), 4096)
                )])
                x, y = x[some] + i, y[some] + j
                if forest:
                    joins = [k for k, (p, q) in enumerate(zip(comp[x].tolist(), comp[y].tolist(), strict=True)) if trees.join(p, q)]
                    x, y = x[joins], y[joins]
                us.append(np.minimum(node[x], node[y]))
                vs.append(np.maximum(node[x], node[y]))
                if sum(map(len, us)) > 1 << 16:
                    yield [np.concatenate(us), np.concatenate(vs)]
                    us, vs = [], []
        if us:
            yield [np.concatenate(us), np.concatenate(vs)]

    return _buckets(make, ["u", "v"], [pa.int64()] * 2)


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (left, right))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both * (num + den) >= num * (len(a) + len(b)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles (ascending) and their ranks, rarest first; the list is bounded at every size of input."""
    part = max(1, min(SAMPLE, docs.count() // 4000))
    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).select("text")
    counts = sample.mapInArrow(_shingles(width), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 2")
    rows = counts.orderBy(F.desc("c"), "key").limit(COMMON).toArrow()
    keys = rows.column("key").to_numpy().astype(np.int64).view(np.uint64)
    rank = np.arange(len(keys), 0, -1)
    order = np.argsort(keys)
    return keys[order], rank[order]


def similar_texts(docs: DataFrame, scratch: Scratch, width: int = 5, num: int = 4, den: int = 5, distance: int = 3) -> DataFrame:
    """(doc_id, node, component_id) of every document: its set and the least set it is linked to, over any chain."""
    with freed_shuffles(docs.sparkSession):
        return _Search(docs, scratch, width, num, den).run(distance)


class _Search:
    """The distinct sets of a table of documents and the steps that link them."""

    def __init__(self, docs: DataFrame, scratch: Scratch, width: int, num: int, den: int):
        self.spark, self.scratch, self.width, self.num, self.den = docs.sparkSession, scratch, width, num, den
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        with text_batches(self.spark, 256):
            order = self.spark.sparkContext.broadcast(_common(self.docs, width))
            fields = "doc_id long, node long, n int, p0 long, bits binary, minima binary, prefix binary"
            told = scratch.save(self.docs.mapInArrow(_described(width, order, num, den), fields), "described")
        self.ids = scratch.save(told.select("doc_id", "node"), "ids")
        sets = told.groupBy("node").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("n", "p0", "bits", "minima", "prefix")])
        self.sets = scratch.save(sets, "distinct-sets")
        scratch.drop("described")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame | None:
        """The pairs (u, v) that are similar enough, by whole sets; only texts of pairs are read as sets. None without pairs."""
        scratch = self.scratch
        pairs = scratch.save(pairs.distinct(), f"{name}-pairs")
        if not pairs.take(1):
            return None
        wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(self.sets.select("node", "id"), "node")
        with text_batches(self.spark, 256):
            texts = self.docs.join(wanted, F.col("doc_id") == F.col("id")).select("node", "text")
            whole = scratch.save(texts.mapInArrow(_sets(self.width), "node long, shingles binary"), f"{name}-sets")
            left = whole.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
            right = whole.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
            met = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
            links = scratch.save(met.mapInArrow(_verified(self.num, self.den), "u long, v long"), name)
        scratch.drop(f"{name}-pairs", f"{name}-sets")
        return links

    def placed(self, rows: DataFrame, links: DataFrame | None, *columns: str) -> DataFrame:
        """The rows with the components of their sets."""
        if links is None:
            return rows.select("node", F.col("node").alias("comp"), *columns)
        found = components(links, Scratch(self.spark, "near-components"))
        return rows.join(found, F.col("node") == F.col("id"), "left").select("node", F.coalesce("component", "node").alias("comp"), *columns)

    def met(self, links: DataFrame | None, hashes: str, most: int) -> tuple[DataFrame, DataFrame]:
        """Sets of different components that may match under one of their hashes: pairs (u, v) of small keys, and rows
        (key, node, comp, n, pos, bits) of larger ones."""
        fields = "key long, node long, comp long, n int, pos int"
        rows = self.placed(self.sets.select("node", "n", hashes), links, "n", hashes)
        with text_batches(self.spark, 256):
            rows = rows.mapInArrow(_dealt(hashes == "prefix"), fields).repartition("key").sortWithinPartitions("key", "n", "node")
        with text_batches(self.spark, 10000):
            found = self.scratch.save(rows.mapInArrow(_shared(self.num, self.den, most), fields), f"met-{hashes}")
        told = lambda name, **more: self.sets.select(F.col("node").alias(name), *[F.col(k).alias(v) for k, v in more.items()])
        pairs = found.filter("pos < 0").select(F.col("key").alias("u"), F.col("node").alias("v")).distinct()
        pairs = pairs.join(told("u", n="n", bits="bits"), "u").join(told("v", n="m", bits="others"), "v").select("u", "v", "n", "bits", "m", "others")
        rows = found.filter("pos >= 0").join(told("of", bits="bits"), F.col("node") == F.col("of")).drop("of")
        with text_batches(self.spark, 1000):
            pairs = self.scratch.save(pairs.mapInArrow(_bounded(self.num, self.den), "u long, v long"), f"pairs-{hashes}")
            rows = self.scratch.save(rows, f"rows-{hashes}")
        self.scratch.drop(f"met-{hashes}")
        return pairs, rows

    def apart(self, rows: DataFrame, forest: bool) -> DataFrame:
        rows = rows.select("key", "node", "comp", "n", "pos", "bits").repartition("key").sortWithinPartitions("key", "n", "node")
        return rows.mapInArrow(_apart(self.num, self.den, forest), "u long, v long")

    def run(self, distance: int) -> DataFrame:
        spark, sets = self.spark, self.sets
        reps = self.scratch.save(sets.groupBy("p0").agg(F.min("node").alias("node")), "fingerprints")
        with text_batches(spark, 10000):
            near = near_links(reps, self.scratch, distance)
        same = sets.join(reps.select(F.col("p0").alias("q"), F.col("node").alias("u")), F.col("p0") == F.col("q")).filter("node != u").select("u", F.col("node").alias("v"))
        near = near.union(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        pairs, rows = self.met(None, "minima", 2)
        with text_batches(spark, 1000):
            links = self.verified(near.union(pairs).union(self.apart(rows, True)), "first-links")
        self.scratch.drop("pairs-minima", "rows-minima")
        pairs, rows = self.met(links, "prefix", SMALL)
        with text_batches(spark, 1000):
            more = self.verified(pairs.union(self.apart(rows, True)), "forest-links")
            if more is not None:  # else no candidate is left
                links = more if links is None else links.union(more)
                rest = self.verified(self.apart(self.placed(rows.drop("comp"), links, "key", "n", "pos", "bits"), False), "other-links")
                links = links if rest is None else links.union(rest)
        return self.placed(self.ids, links, "doc_id").select("doc_id", "node", F.col("comp").alias("component_id"))
