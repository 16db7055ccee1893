"""Suffix and common-prefix arrays of a shard by induced sorting, over disk-backed bucket queues.

A shard is a string of symbols. Its leftmost S-type (LMS) substrings are named; the names are refined
over twice as many substrings a round until they differ or span ``depth`` symbols, which sorts the LMS
suffixes as deep as is asked. From them, one ascending pass induces the L-type suffixes and one descending pass the S-type
ones. Both passes take suffix tuples (position, common prefix with the tuple before) from a priority
queue and push the suffix one symbol to the left. Its priority is (first symbol, order of arrival), so
it is a row of first-in first-out buckets, whose older chunks lie on disk.

Common prefixes are induced along: neighbours in a bucket share one symbol more than the least common
prefix between their sources. That least value is looked up in a sparse table inside a batch and kept in a running
minimum for each symbol between batches. Prefixes are capped at ``depth``.

What a large shard keeps (text, types, ranks of every round, marks) lies in memory-mapped files of a temporary
folder, which goes when the sort ends; a round of naming takes about ten bytes a symbol of memory meanwhile.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of one array above which it lies on disk, and bytes of queue chunks kept in memory.
MEMORY_BYTES = 64 << 20
#: Suffixes that one batch of an induction pass takes.
BATCH = 1 << 16


class Spill:
    """Arrays that move to a temporary folder when they are large."""

    def __init__(self, memory_bytes: int = MEMORY_BYTES):
        self.memory_bytes = memory_bytes
        self.folder = tempfile.TemporaryDirectory(prefix="induced-")
        self.files = 0

    def array(self, size: int, dtype) -> np.ndarray:
        if size * np.dtype(dtype).itemsize <= self.memory_bytes:
            return np.zeros(size, dtype=dtype)
        self.files += 1
        return np.memmap(f"{self.folder.name}/{self.files}", dtype=dtype, mode="w+", shape=(size,))

    def keep(self, values: np.ndarray) -> np.ndarray:
        """The values, in a mapped file if they are large."""
        if values.nbytes <= self.memory_bytes:
            return values
        out = self.array(len(values), values.dtype)
        out[:] = values
        return out

    def close(self) -> None:
        self.folder.cleanup()


class BucketQueue:
    """A monotone priority queue of (position, common prefix) tuples: by symbol, then order of arrival."""

    def __init__(self, symbols: int, spill: Spill):
        self.chunks: list[list] = [[] for _ in range(symbols)]
        self.spill, self.held = spill, 0
        self.file = None

    def push(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.chunks[symbol].append((positions, prefixes))
        self.held += positions.nbytes + prefixes.nbytes
        if self.held > self.spill.memory_bytes:
            self._write_out()

    def _write_out(self) -> None:
        if self.file is None:
            self.file = open(f"{self.spill.folder.name}/queue-{id(self)}", "w+b")
        self.file.seek(0, 2)
        for bucket in self.chunks:
            for k, chunk in enumerate(bucket):
                if chunk is not None and not isinstance(chunk[0], int):
                    at = self.file.tell()
                    chunk[0].astype("<i8").tofile(self.file)
                    chunk[1].astype("<i4").tofile(self.file)
                    bucket[k] = (at, len(chunk[0]))
        self.held = 0

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A bucket's tuples in order, BATCH or so at a time, with those that arrive meanwhile; it ends empty."""
        bucket = self.chunks[symbol]
        k = 0
        while k < len(bucket):
            positions, prefixes, size = [], [], 0
            while k < len(bucket) and size < BATCH:
                first, second = bucket[k]
                bucket[k] = None
                k += 1
                if isinstance(first, int):
                    self.file.seek(first)
                    first, second = np.fromfile(self.file, "<i8", second), np.fromfile(self.file, "<i4", second)
                else:
                    self.held -= first.nbytes + second.nbytes
                positions.append(first)
                prefixes.append(second)
                size += len(first)
            yield np.concatenate(positions), np.concatenate(prefixes)
        bucket.clear()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def s_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last symbol is a unique least one."""
    n = len(text)
    rises = np.zeros(n, dtype=bool)
    rises[:-1] = text[:-1] < text[1:]
    rises[-1] = True
    decided = np.ones(n, dtype=bool)
    decided[:-1] = text[:-1] != text[1:]
    ends = np.flatnonzero(decided)  # the last place of each run of equal symbols
    return np.repeat(rises[ends], np.diff(np.concatenate([[-1], ends])))


def _ranks(keys: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Ranks of keys below ``2 ** bits`` among the different ones, in 32 bits, and how many there are."""
    place = max(1, (len(keys) - 1).bit_length())
    if bits + place <= 64:  # key and place in one number: a plain sort moves eight bytes a key
        packed = np.sort((keys.astype(np.uint64) << np.uint64(place)) | np.arange(len(keys), dtype=np.uint64))
        order, ranked = (packed & np.uint64((1 << place) - 1)).astype(np.int64), packed >> np.uint64(place)
        del packed
    else:
        order = np.argsort(keys)
        ranked = keys[order]
    fresh = np.ones(len(ranked), dtype=np.int32)
    fresh[1:] = ranked[1:] != ranked[:-1]
    del ranked
    names = np.empty(len(order), dtype=np.int32)
    numbers = np.cumsum(fresh, dtype=np.int32)
    names[order] = numbers - 1
    return names, int(numbers[-1])


def _paired(first: np.ndarray, second: np.ndarray, kinds: int, others: int) -> tuple[np.ndarray, int]:
    """Ranks of pairs of a rank below ``kinds`` and a number below ``others``."""
    low = max(1, (others - 1).bit_length())
    return _ranks((first.astype(np.uint64) << np.uint64(low)) | second.astype(np.uint64), low + max(1, (kinds - 1).bit_length()))


def _named(text: np.ndarray, lms: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the LMS substrings: as many symbols at once as a key holds, further ones only where substrings go on.

    Where one substring ends and another goes on with the same symbols, the place is S-type in the first and L-type in
    the other, so the end counts as greater than any symbol.
    """
    n, count = len(text), len(lms)
    present = np.flatnonzero(np.bincount(text))
    code = np.zeros(int(present[-1]) + 1, dtype=np.uint64)
    code[present] = np.arange(len(present))
    end = len(present)
    width = max(1, end.bit_length())
    per_key, longest = 64 // width, int(lengths.max())
    names, kinds, at = np.zeros(count, dtype=np.int32), 1, 0
    while at < longest:
        taken = min(per_key, longest - at)
        key = np.zeros(count, dtype=np.uint64)
        for k in range(at, at + taken):
            symbol = code[text[np.minimum(lms + k, n - 1)]]
            symbol[lengths <= k] = end
            key = (key << np.uint64(width)) | symbol
        fresh, more = _ranks(key, width * taken)
        names, kinds = (fresh, more) if not at else _paired(names, fresh, kinds, more)
        at += taken
        if kinds == count:
            break
    return names, kinds


def sort_lms(text: np.ndarray, lms: np.ndarray, depth: int, spill: Spill) -> tuple[np.ndarray, np.ndarray]:
    """Order of the LMS suffixes (as places in ``lms``) to ``depth`` symbols, and common prefixes of neighbours."""
    n, count = len(text), len(lms)
    names, total = _named(text, lms, np.append(lms[1:] + 1, n) - lms)  # an LMS substring ends with the next LMS symbol
    # symbols that 2 ** round substrings span, without the one that the next shares
    rounds = [spill.keep(names)]
    steps = np.append(np.diff(lms), n - lms[-1])
    reach = [spill.keep(np.minimum(steps, depth).astype(np.int32))]
    while total < count and ((np.bincount(names)[names] > 1) & (reach[-1] < depth)).any():
        hop = 1 << (len(rounds) - 1)
        after = np.zeros(count, dtype=np.int64)
        after[:-hop] = rounds[-1][hop:]
        after[:-hop] += 1
        names, total = _paired(rounds[-1], after, total, total + 1)
        span = np.array(reach[-1])
        span[:-hop] += reach[-1][hop:]
        rounds.append(spill.keep(names))
        reach.append(spill.keep(np.minimum(span, depth)))
    order = np.argsort(rounds[-1], kind="stable").astype(np.int64)
    # neighbours: the longest equal stretches first, then symbol by symbol inside the substring that differs
    shared = np.zeros(count - 1, dtype=np.int64)
    moved = np.zeros(count - 1, dtype=np.int64)  # substrings passed
    for k in range(len(rounds) - 1, -1, -1):
        live = np.flatnonzero((shared < depth) & (order[:-1] + moved < count) & (order[1:] + moved < count))
        a, b = order[live] + moved[live], order[live + 1] + moved[live]
        same = rounds[k][a] == rounds[k][b]
        live = live[same]
        shared[live] += reach[k][a[same]]
        moved[live] += 1 << k
    live = np.flatnonzero(shared < depth)
    p, q = lms[order[live]] + shared[live], lms[order[live + 1]] + shared[live]
    while len(live):
        equal = (np.maximum(p, q) < n) & (shared[live] < depth)
        equal[equal] = text[p[equal]] == text[q[equal]]
        live, p, q = live[equal], p[equal] + 1, q[equal] + 1
        shared[live] += 1
    prefix = np.zeros(count, dtype=np.int32)
    prefix[1:] = np.minimum(shared, depth)
    return order, prefix


def common_prefix(text: np.ndarray, p: int, q: int, depth: int) -> int:
    """Symbols two suffixes share, up to ``depth``."""
    room = min(depth, len(text) - max(p, q))
    differ = np.flatnonzero(np.asarray(text[p : p + room]) != np.asarray(text[q : q + room]))
    return int(differ[0]) if len(differ) else room


class _Inducer:
    """One pass: takes suffixes in order, pushes those one symbol to the left that are of the wanted type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queue: BucketQueue, depth: int, symbols: int):
        self.text, self.wanted, self.queue, self.depth = text, wanted, queue, depth
        self.least = np.zeros(symbols, dtype=np.int32)  # least common prefix since a symbol's last push
        self.last = None

    def feed(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """Process suffixes in order; ``prefixes[k]`` is shared with the suffix before, across calls too."""
        for start in range(0, len(positions), BATCH):
            self._batch(positions[start : start + BATCH], prefixes[start : start + BATCH])

    def _batch(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        left = positions - 1
        chosen = np.flatnonzero((left >= 0) & self.wanted[np.maximum(left, 0)])
        running = np.minimum.accumulate(prefixes)
        if not len(chosen):
            self.least = np.minimum(self.least, running[-1])
            return
        symbols = self.text[left[chosen]]
        order = np.argsort(symbols, kind="stable")
        at, symbols = chosen[order], symbols[order]
        first = np.ones(len(at), dtype=bool)
        first[1:] = symbols[1:] != symbols[:-1]
        # sparse table of least values: level j covers 2 ** j prefixes
        levels = [prefixes]
        while (1 << len(levels)) <= len(prefixes):
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        shared = np.empty(len(at), dtype=np.int32)
        heads = np.flatnonzero(first)
        shared[heads] = np.minimum(self.least[symbols[heads]], running[at[heads]])
        rest = np.flatnonzero(~first)
        if len(rest):
            low, high = at[rest - 1] + 1, at[rest]
            level = np.frexp(high - low + 1)[1] - 1
            for j in np.unique(level):
                own = level == j
                table = levels[j]
                shared[rest[own]] = np.minimum(table[low[own]], table[high[own] - (1 << j) + 1])
        shared = np.minimum(shared + 1, self.depth)
        ends = np.append(heads[1:], len(at))
        backwards = np.minimum.accumulate(prefixes[::-1])[::-1]
        self.least = np.minimum(self.least, running[-1])
        for a, b in zip(heads, ends, strict=True):
            symbol = int(symbols[a])
            self.queue.push(symbol, left[at[a:b]], shared[a:b])
            tail = at[b - 1] + 1
            self.least[symbol] = backwards[tail] if tail < len(prefixes) else self.depth


def induced_order(text: np.ndarray, depth: int, spill: Spill) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of ``text`` by bucket from the greatest symbol down, each bucket's in chunks from the greatest suffix down.

    Yields (positions, prefixes): a prefix is what a suffix shares with the one yielded before it, capped at
    ``depth``; 0 across buckets. ``text`` holds symbols below 512 and ends with a unique least symbol 0.
    """
    symbols = int(text.max()) + 1
    small = spill.keep(s_types(text))
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order, shared = sort_lms(text, lms, depth, spill)
    seeds = spill.keep(lms[order])
    seed_symbols = text[seeds]
    bounds = np.searchsorted(seed_symbols, np.arange(symbols + 1))
    large_queue, large = BucketQueue(symbols, spill), ~small
    inducer = _Inducer(text, large, large_queue, depth, symbols)
    archive = BucketQueue(symbols, spill)  # the L-type suffixes of each bucket, kept for the second pass
    for c in range(symbols):
        before = None
        for positions, prefixes in large_queue.take(c):
            prefixes = prefixes.copy()
            if before is None:
                prefixes[0] = 0
            archive.push(c, positions, prefixes)
            inducer.feed(positions, prefixes)
            before = int(positions[-1])
        a, b = int(bounds[c]), int(bounds[c + 1])
        if a < b:
            prefixes = shared[a:b].copy()
            prefixes[0] = 0 if before is None else common_prefix(text, before, int(seeds[a]), depth)
            inducer.feed(seeds[a:b], prefixes)
    del seeds, order, shared
    small_queue = BucketQueue(symbols, spill)
    inducer = _Inducer(text, small, small_queue, depth, symbols)
    # the last suffix is the sentinel alone; it is S-type without a source and the least of all
    for c in range(symbols - 1, -1, -1):
        before = None
        for positions, prefixes in small_queue.take(c):
            prefixes = prefixes.copy()
            if before is None:
                prefixes[0] = 0
            yield positions, prefixes
            inducer.feed(positions, prefixes)
            before = int(positions[-1])
        chunks = list(archive.take(c)) if archive.chunks[c] else []
        following = 0  # what the suffix after a chunk shares with the chunk's last
        for k in range(len(chunks) - 1, -1, -1):
            positions, prefixes = chunks[k]
            down = positions[::-1]
            shifted = np.empty(len(down), dtype=np.int32)
            shifted[1:] = prefixes[::-1][:-1]
            if k == len(chunks) - 1:
                shifted[0] = 0 if before is None else common_prefix(text, before, int(down[0]), depth)
            else:
                shifted[0] = following
            following = int(prefixes[0])
            yield down, shifted
            inducer.feed(down, shifted)
            chunks[k] = None
    for queue in (large_queue, archive, small_queue):
        queue.close()


def repeated_starts(text: np.ndarray, need, memory_bytes: int = MEMORY_BYTES) -> np.ndarray:
    """Whether the ``need`` symbols from each place also start at another place.

    ``need`` is one number or one for each place, 0 where nothing is asked. Places with fewer symbols left hold False.
    ``text`` must end with a unique least symbol 0.
    """
    spill = Spill(memory_bytes)
    try:
        text = spill.keep(text)
        if np.ndim(need):
            need, depth = spill.keep(np.asarray(need, dtype=np.int32)), int(need.max())
            asked = lambda at: np.where(need[at] > 0, need[at], depth + 1)
        else:
            depth = int(need)
            asked = lambda at: depth
        marked = spill.array(len(text), bool)
        if depth < 1:
            return np.array(marked)
        last = None
        for positions, prefixes in induced_order(text, depth, spill):
            least = asked(positions)
            marked[positions[prefixes >= least]] = True
            after = positions[:-1]
            marked[after[prefixes[1:] >= asked(after)]] = True
            if last is not None and prefixes[0] >= np.max(asked(np.array([last]))):
                marked[last] = True
            last = int(positions[-1])
        return np.array(marked)
    finally:
        spill.close()
