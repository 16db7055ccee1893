"""Suffix-array deduplication: removes what is covered by strings that also start anywhere else.

A *window* is ``size`` neighbouring tokens: bytes (:class:`Bytes`, the contract of op6) or words (:class:`Words`,
passages, whatever white space is between the words). Equal windows must meet without a row for each of them:

1. Equal texts become one (their digest), with the number of copies. A text with copies is repeated
   whole if it is long enough; it stays in the search for others.
2. Every window is owned by its anchor, the least gram of ``gram`` tokens in it by hash (the leftmost among equals).
   Neighbouring windows with one anchor are one segment. Equal windows have equal anchors, so only segments
   of anchors that occur twice or more go on, a small part of a corpus of prose.
3. Segments that are equal in whole become one, with their number; where an anchor has just that one, its
   windows are repeated. Segments of other anchors are sorted by anchor, and suffix arrays with common prefixes are
   induced (:mod:`tessella.llm.suffix_sort`) over as many whole anchors as ``batch_bytes`` hold. A window is
   repeated if a neighbour shares it or its segment occurs more than once. Before, ends of a segment that share no core (see
   below) with another segment of their anchor are cut off, as no window in them can be repeated.
4. Repeated windows go back to the texts, are united to spans, and the spans are cut out.

Hot anchors, with over ``split_segments`` distinct segments (a line that many texts share), never meet in one task:
their segments are cut into pieces whose windows begin within ``width`` tokens of each other, as counted from the anchor. All
windows of a piece hold the same core, which is the new key: cores that run over the common line are of one text only and
are done with, equal pieces become one with their number, and what is still hot is cut by the next smaller width. At
a width of 1 the core is the window itself, so that equal pieces are all that is left to find.

Memory: a task holds ``batch_bytes`` and the segments of one anchor, at most ``split_segments``; partitions are streams
sorted by Spark, so their number is bounded (``most_shards``, ``most_buckets``) whatever the corpus. The sorts' queues
lie on the task's own disk beyond their memory limit; a lost executor's task sorts anew.

Scale: texts cross one shuffle, combined before it, into a table bucketed by digest, which both later
joins read without another shuffle. All else is narrow rows. Joins on anchors read written tables on both
sides, so adaptive execution can split a hot one.

Null text is empty text; texts shorter than a window lose nothing. Repeated rows are copies. Null ids
pass through. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, freed_shuffles, session_conf, text_batches
from tessella.llm.suffix_sort import repeated_starts

#: Windows that are anchored at once; bounds the arrays of very long texts.
PIECE = 1 << 20
_PLACE_BITS = 21  # PIECE + windows of one more window fit
_SPACE = 32
#: Most digits there are at one place of a word's number.
_DIGITS = 100
#: Columns of hashes have no dictionary worth trying.
_HASHES = {"parquet.enable.dictionary": "false"}


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = hashes ^ (hashes >> np.uint64(29))
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


@dataclass(frozen=True)
class Bytes:
    """Windows of ``size`` bytes, anchored by grams of ``gram`` bytes (8 times a power of two)."""

    size: int = 400
    gram: int = 64
    widths: tuple[int, ...] = (64, 8, 1)

    def view(self, content: bytes) -> tuple[bytes, range]:
        """What is compared, and the place of each token in it and of the end."""
        return content, range(len(content) + 1)

    def grams(self, view: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The hash of the gram that begins with each token but the last, by doubling from 8 bytes."""
        if len(view) < self.gram:
            return np.zeros(0, dtype=np.uint64)
        view = np.ascontiguousarray(view)
        hashes = np.lib.stride_tricks.as_strided(view, (len(view) - 7, 8), (1, 1)).copy().view("<u8")[:, 0]
        hashes *= np.uint64(0x9E3779B97F4A7C15)
        size = 8
        while size < self.gram:
            hashes ^= hashes >> np.uint64(31)
            hashes = hashes[:-size] * np.uint64(0xD6E8FEB86659FD93) + hashes[size:]
            size *= 2
        return _mixed(hashes)

    def windows(self, segment: bytes) -> int:
        """How many windows a segment has."""
        return len(segment) - self.size + 1

    def symbols(self, segments: list[bytes]) -> tuple[np.ndarray, int, np.ndarray]:
        """The segments as symbols from 2 on, a 1 after each and a 0 at the end; symbols a token; tokens of each segment."""
        text = np.frombuffer(b"\0".join(segments) + b"\0\0", np.uint8).astype(np.uint16)
        text += 2
        tokens = np.fromiter(map(len, segments), np.int64, len(segments))
        text[np.cumsum(tokens + 1) - 1] = 1
        text[-1] = 0
        return text, 1, tokens

    def past(self, places: np.ndarray, window) -> np.ndarray:
        """The end of a window by its number."""
        return places[window + self.size]


@dataclass(frozen=True)
class Words:
    """Windows of ``size`` words, anchored by grams of ``gram`` words; a space stands before and after each word."""

    size: int = 50
    gram: int = 8
    widths: tuple[int, ...] = (8, 1)

    def view(self, content: bytes) -> tuple[bytes, np.ndarray]:
        view = b" " + b" ".join(content.split()) + b" " if content else b" "
        return view, np.flatnonzero(np.frombuffer(view, np.uint8) == _SPACE)

    def grams(self, view: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Differences of a running polynomial, brought to one scale by the inverse of its base."""
        if len(places) <= self.gram:
            return np.zeros(0, dtype=np.uint64)
        base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        powers = np.cumprod(np.full(len(view), base, dtype=np.uint64))
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((view.astype(np.uint64) + np.uint64(7)) * powers)])
        back = np.cumprod(np.full(int(places[-1]) + 1, inverse, dtype=np.uint64))
        first = places[: -self.gram]
        return _mixed(_mixed((running[places[self.gram :]] - running[first]) * back[first]))

    def windows(self, segment: bytes) -> int:
        return segment.count(b" ") - self.size

    def symbols(self, segments: list[bytes]) -> tuple[np.ndarray, int, np.ndarray]:
        """Words are numbered; a number is written in as many digits as keep the alphabet, and so the sort's buckets, small.

        First digits are less than others, so equal symbols are whole equal words.
        """
        cut = pc.split_pattern(pa.array([b"".join(segments)], pa.large_binary()), b" ").values[1:]  # an empty word ends each segment
        coded = pc.dictionary_encode(pa.concat_arrays([pa.array([b""], pa.large_binary()), cut]))
        numbers, kinds = coded.indices.to_numpy()[1:], len(coded.dictionary)
        digits = 1
        while _DIGITS**digits < kinds:
            digits += 1
        base = next(b for b in range(1, _DIGITS + 1) if b**digits >= kinds)
        text = np.ones(len(numbers) * digits + 1, dtype=np.uint16)
        text[-1] = 0
        for k in range(digits):
            text[k:-1:digits] = np.where(numbers > 0, numbers // base**k % base + (2 + base if k else 2), 1)
        return text, digits, np.diff(np.flatnonzero(numbers == 0), prepend=-1) - 1

    def past(self, places: np.ndarray, window) -> np.ndarray:
        return places[window + self.size] + 1

    def spans(self, content: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words in the text itself."""
        data = np.frombuffer(content, np.uint8)
        inner = np.concatenate([[False], (data != _SPACE) & ((data < 9) | (data > 13)), [False]]).astype(np.int8)
        edges = np.diff(inner)
        return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _owners(hashes: np.ndarray, reach: int) -> np.ndarray:
    """The place of the least of every ``reach`` neighbouring hashes, the leftmost among equals."""
    place = np.uint64((1 << _PLACE_BITS) - 1)
    least = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if reach > size:
        least = np.minimum(least[: -(reach - size)], least[reach - size :])
    return (least & place).astype(np.int64)


def anchored(contents: list[bytes], unit) -> Iterator[tuple[np.ndarray, bytes]]:
    """Columns (text, anchor hash, first window, windows, anchor's token from the first, start, end) of the segments of the texts, and
    the bytes that starts and ends refer to.

    Short texts are hashed together; windows never reach over a text's end.
    """
    held: list[tuple[int, bytes, np.ndarray]] = []
    size = 0
    for number, content in enumerate(contents):
        view, places = unit.view(content)
        if len(places) <= unit.size:
            continue
        if held and size + len(places) > PIECE:
            yield from _anchored(held, unit)
            held, size = [], 0
        held.append((number, view, places))
        size += len(places)
    if held:
        yield from _anchored(held, unit)


def _anchored(held: list, unit) -> Iterator[tuple[np.ndarray, bytes]]:
    """Segments of texts of at most PIECE tokens together, or of a single longer one."""
    joined = held[0][1] if len(held) == 1 else b"".join(v for _, v, _ in held)
    tokens = np.cumsum([0, *(len(p) for _, _, p in held)])  # a text's end counts as a token of it
    offsets = np.cumsum([0, *(len(v) for _, v, _ in held)])
    if isinstance(unit, Bytes):  # the next text's first byte stands where this one ends
        tokens = tokens - np.arange(len(tokens))
        places = np.arange(len(joined) + 1)
    else:
        places = np.concatenate([p + o for (_, _, p), o in zip(held, offsets, strict=False)])
    counts = np.array([len(p) - unit.size for _, _, p in held])
    numbers = np.array([k for k, _, _ in held])
    data, reach = np.frombuffer(joined, np.uint8), unit.size - unit.gram + 1
    for start in range(0, int(tokens[len(held) - 1] + counts[-1]), PIECE):
        upto = min(start + PIECE + unit.size, len(places))
        own = places[start:upto]
        hashes = unit.grams(data[own[0] : own[-1] + (1 if isinstance(unit, Words) else 0)], own - own[0])
        at = _owners(hashes, reach)
        # windows of this piece that lie inside a text
        windows = np.concatenate([np.arange(max(start, t), min(start + PIECE, t + c)) for t, c in zip(tokens, counts, strict=False)])
        if not len(windows):
            continue
        owner = at[windows - start]
        text = np.searchsorted(tokens[: len(held)], windows, side="right") - 1
        heads = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])])
        size = np.diff(np.append(heads, len(windows)))
        first, text = windows[heads], text[heads]
        columns = (numbers[text], hashes[owner[heads]].view(np.int64), first - tokens[text], size, owner[heads] + start - first, places[first], unit.past(places, first + size - 1))
        yield np.stack(columns), joined


def _batches(rows: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _segments(unit):
    """(tid, tid2, anchor, seg, start, windows, spot) of each segment of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashed = xxhash.xxh3_64_intdigest
        names = ["tid", "tid2", "anchor", "seg", "start", "windows", "spot"]
        for batch in batches:
            tid, tid2 = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
            for (text, anchor, start, windows, spot, begin, end), joined in anchored(batch.column(2).to_pylist(), unit):
                segs = np.fromiter((hashed(joined[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(text))
                columns = [tid[text], tid2[text], anchor, segs.view(np.int64), *(x.astype(np.int32) for x in (start, windows, spot))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


SEGMENT = "tid long, tid2 long, anchor long, seg long, start int, windows int, spot int"
GROUP = "key long, anchor long, seg long, copies long, spot int, content binary"
PIECES = "anchor long, seg long, first int, copies long, key long, piece long, spot int, windows int, content binary"


def _cut(unit):
    """(key, anchor, seg, copies, spot, bytes) of the wanted segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["key", "anchor", "seg", "copies", "spot", "content"], [pa.int64()] * 4 + [pa.int32(), pa.binary()]
        for batch in batches:
            rows = []
            for content, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                view, places = unit.view(content)
                for s in wanted:
                    part = view[places[s["start"]] : unit.past(places, s["start"] + s["windows"] - 1)]
                    rows.append((s["anchor"], s["anchor"], s["seg"], s["copies"], s["spot"], part))
            yield _batches(rows, names, kinds)

    return run


def pieces(segment: bytes, spot: int, width: int, unit) -> Iterator[tuple[int, int, int, bytes, range | np.ndarray]]:
    """(first window, windows, core's number, core, the segment's places) of the pieces of a segment whose anchor is token ``spot``."""
    places = range(len(segment) + 1) if isinstance(unit, Bytes) else np.flatnonzero(np.frombuffer(segment, np.uint8) == _SPACE)
    windows, size, most = len(places) - unit.size, unit.size, unit.size - unit.gram  # an anchor is at most so far from a window's start
    for number in range((spot - windows + 1) // width, spot // width + 1):
        low, high = number * width, min(number * width + width - 1, most)
        first, last = max(0, spot - high), min(windows - 1, spot - low)
        yield first, last - first + 1, number, segment[places[spot - low] : places[spot - high + size]], places


def trimmed(rows: list[tuple[int, int, int, bytes]], unit) -> list[tuple[int, int, int, bytes]]:
    """What may hold repeated windows of one anchor's (anchor, seg, spot, bytes): from the first to the last piece whose core
    another segment has, as (anchor, seg, first window, bytes)."""
    seen, own = Counter(), []
    for _, _, spot, content in rows:
        found = list(pieces(content, spot, unit.widths[0], unit))
        own.append(found)
        seen.update((number, core) for _, _, number, core, _ in found)
    out = []
    for (anchor, seg, _, content), found in zip(rows, own, strict=True):
        shared = [p for p in found if seen[p[2], p[3]] > 1]
        if shared:
            first, past = min(p[0] for p in shared), max(p[0] + p[1] for p in shared)
            out.append((anchor, seg, first, content[shared[0][4][first] : unit.past(shared[0][4], past - 1)]))
    return out


def _hot(unit, level: int, whole: bool):
    """Pieces of hot segments: of texts with wanted segments (``whole``) or of larger pieces."""
    names = ["anchor", "seg", "first", "copies", "key", "piece", "spot", "windows", "content"]
    kinds = [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]

    def segments(batch):
        if not whole:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
            return
        for content, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            view, places = unit.view(content)
            for s in wanted:
                part = view[places[s["start"]] : unit.past(places, s["start"] + s["windows"] - 1)]
                yield s["anchor"], s["seg"], s["copies"], s["spot"], part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            rows = []
            for anchor, seg, copies, spot, content in segments(batch):
                for first, windows, number, core, places in pieces(content, spot, unit.widths[level], unit):
                    part = content[places[first] : unit.past(places, first + windows - 1)]
                    key = xxhash.xxh3_64_intdigest(core, (anchor + number) & (1 << 63) - 1)
                    rows.append((anchor, seg, first, copies, signed(key), signed(xxhash.xxh3_64_intdigest(part)), spot - first, windows, part))
            yield _batches(rows, names, kinds)

    return run


def repeated_ranges(segments: list[tuple[int, int, int, bytes]], unit) -> list[tuple[int, int, int, int]]:
    """(anchor, seg, first, past) ranges of repeated windows among whole anchors' (anchor, seg, first window, bytes)."""
    if not segments:
        return []
    text, width, tokens = unit.symbols([s[3] for s in segments])
    starts = (np.cumsum(tokens + 1) - tokens - 1) * width
    spans = [slice(a, a + n * width, width) for a, n in zip(starts.tolist(), (tokens - unit.size + 1).tolist(), strict=True)]
    need = np.zeros(len(text), dtype=np.int32)
    for span in spans:
        need[span] = unit.size * width
    marked = repeated_starts(text, need)
    out = []
    for span, (anchor, seg, first, _) in zip(spans, segments, strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], marked[span], [False]]).astype(np.int8)))
        out += [(anchor, seg, first + int(a), first + int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return out


def _sort_groups(unit, batch_bytes: int):
    """Sorts rows that come by key, whole keys of about ``batch_bytes`` at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["anchor", "seg", "first", "past"], [pa.int64()] * 2 + [pa.int32()] * 2
        rows, group, whole, size, last = [], [], [], 0, None
        for batch in batches:
            for key, anchor, seg, copies, spot, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    rows += (more := trimmed(group, unit))
                    size += sum(len(r[3]) for r in more)
                    group, last = [], key
                    if size >= batch_bytes:
                        yield _batches(repeated_ranges(rows, unit) + whole, names, kinds)
                        rows, whole, size = [], [], 0
                group.append((anchor, seg, spot, content))
                if copies > 1:
                    whole.append((anchor, seg, 0, unit.windows(content)))
        yield _batches(repeated_ranges(rows + trimmed(group, unit), unit) + whole, names, kinds)

    return run


def _gone(tokens: int, copies: int, ranges, unit) -> np.ndarray:
    """Whether each of a text's tokens is in a repeated window."""
    change = np.zeros(tokens + 1, dtype=np.int32)
    if copies > 1 and tokens >= unit.size:
        change[0], change[-1] = 1, -1
    for r in ranges or ():
        change[r["a"]] += 1
        change[r["b"] - 1 + unit.size] -= 1
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def _runs(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that hold."""
    edges = np.flatnonzero(gone[1:] != gone[:-1]) + 1
    edges = np.concatenate([[0], edges] if len(gone) and gone[0] else [edges])
    ends = edges[1::2]
    return edges[::2], ends if len(ends) == len(edges[::2]) else np.append(ends, len(gone))


def _spans(content: bytes, copies: int, ranges, unit) -> tuple[int, np.ndarray, np.ndarray]:
    """How many of a text's tokens are in repeated windows, and the bytes where their runs start and end."""
    if copies < 2 and not ranges:
        return 0, *(np.zeros(0, dtype=np.int64),) * 2
    if isinstance(unit, Bytes):
        gone = _gone(len(content), copies, ranges, unit)
        return int(gone.sum()), *_runs(gone)
    starts, ends = unit.spans(content)
    gone = _gone(len(starts), copies, ranges, unit)
    first, past = _runs(gone)
    return int(gone.sum()), starts[first], ends[past - 1]


def _cut_out(unit, passages, keep: bool):
    """What is left of each text without its repeated windows; with ``passages`` the words of repeated passages, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "n_removed", "n_spans", "kept_sha256", "kept", "n_passage_words"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
        for batch in batches:
            rows = []
            for digest, content, copies, ranges, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, starts, ends = _spans(content, copies, ranges, unit)
                # what lies before, between and after the spans
                left = b"".join(content[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(content)], strict=True))
                words = _spans(content, copies, more, passages)[0] if passages else 0
                kept = _whole_characters(content, starts, ends) if keep else None
                rows.append((digest, len(content) - len(left), len(starts), hashlib.sha256(left).hexdigest(), kept, words))
            yield _batches(rows, names, kinds)

    return run


def _whole_characters(content: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """What is left, with characters that a span cuts through kept whole, so that it is UTF-8 text."""
    change = np.zeros(len(content) + 1, dtype=np.int8)
    change[starts], change[ends] = 1, -1
    gone, data = np.cumsum(change[:-1], dtype=np.int8) > 0, np.frombuffer(content, np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80)
    stays = np.bincount(character[~gone], minlength=int(character[-1]) + 1 if len(character) else 1) > 0
    return data[stays[character]].tobytes()


class _Bucketed:
    """The distinct long texts, bucketed by the ends of their digests; an external table in the scratch folder."""

    def __init__(self, spark: SparkSession, scratch: Scratch, rows: DataFrame, bucket_bytes: int, most_buckets: int):
        self.spark, self.name = spark, f"tessella_texts_{uuid.uuid4().hex}"
        total = rows.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
        self.buckets = min(most_buckets, max(8, -(-total // bucket_bytes)))
        keyed = rows.withColumn("digest", F.unhex(F.sha2("content", 256)))
        long_of = lambda at, size: F.conv(F.hex(F.substring("digest", at, size)), 16, 10).cast("long")
        keyed = keyed.withColumns({"tid": long_of(1, 6), "tid2": long_of(7, 6)})
        distinct = keyed.groupBy("tid", "tid2").agg(F.first("digest").alias("digest"), F.first("content").alias("content"), F.count(F.lit(1)).alias("copies"))
        with session_conf(spark, spark__sql__shuffle__partitions=self.buckets, spark__sql__adaptive__coalescePartitions__enabled="false"):
            distinct.write.bucketBy(int(self.buckets), "tid", "tid2").option("path", scratch.path("texts")).format("parquet").saveAsTable(self.name)

    def __enter__(self) -> _Bucketed:
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def partitions(self):
        """A shuffle partition a bucket while joins with the texts run: with any more, Spark would shuffle the texts, too."""
        return session_conf(self.spark, spark__sql__shuffle__partitions=self.buckets)

    def with_lists(self, rows: DataFrame, name: str, value, how: str = "inner") -> DataFrame:
        """The texts with the lists of ``value`` that rows (tid, tid2, ...) have for them."""
        lists = rows.groupBy(F.col("tid").alias("t"), F.col("tid2").alias("t2")).agg(F.collect_list(value).alias(name))
        return self.read().join(lists, (F.col("tid") == F.col("t")) & (F.col("tid2") == F.col("t2")), how).drop("t", "t2")


@dataclass(frozen=True)
class _Search:
    """The search for one kind of windows over the bucketed texts."""

    texts: _Bucketed
    scratch: Scratch
    unit: Bytes | Words
    batch_bytes: int
    shard_bytes: int
    split_segments: int
    most_shards: int

    def _sorted(self, groups: DataFrame, load: int) -> DataFrame:
        shards = min(self.most_shards, max(1, -(-load // self.shard_bytes)))
        dealt = groups.repartition(int(shards), "key").sortWithinPartitions("key")
        return dealt.mapInArrow(_sort_groups(self.unit, self.batch_bytes), "anchor long, seg long, first int, past int")

    def _hot_marks(self, found: DataFrame, level: int) -> DataFrame:
        """Marks of hot segments' pieces (PIECES), by their owners' anchor, seg and first window."""
        scratch, unit = self.scratch, self.unit
        owners = scratch.save(found, f"hot-{level}")
        distinct = owners.groupBy("key", "piece").agg(F.sum("copies").alias("copies"), F.first("spot").alias("spot"), F.first("windows").alias("windows"), F.first("content").alias("content"))
        distinct = scratch.save(distinct, f"hot-pieces-{level}")
        kinds = scratch.save(distinct.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), f"hot-kinds-{level}")
        distinct = distinct.join(kinds, F.col("key") == F.col("k"), "left").drop("k")  # of written tables, so a hot key can be split
        last = level + 1 == len(unit.widths)
        # at the last width pieces of one key are equal but for collisions of 64 bits, so they are never split
        split = F.lit(False) if last else F.col("kinds") > self.split_segments
        marks = distinct.filter("copies > 1").select("key", "piece", F.lit(0).alias("first"), F.col("windows").alias("past"))
        several = distinct.filter((F.col("kinds") > 1) & ~split)
        load = several.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
        if load:
            groups = several.select("key", F.col("key").alias("anchor"), F.col("piece").alias("seg"), F.lit(1).cast("long").alias("copies"), "spot", "content")
            marks = marks.union(self._sorted(groups, load))
        if not last:
            deeper = distinct.filter(split).select("key", "piece", "copies", "spot", "content")
            if deeper.take(1):
                marks = marks.union(self._hot_marks(deeper.mapInArrow(_hot(unit, level + 1, False), PIECES), level + 1))
        marks = scratch.save(marks.toDF("mk", "mp", "a", "b"), f"hot-marks-{level}")
        met = owners.join(marks, (F.col("key") == F.col("mk")) & (F.col("piece") == F.col("mp")))
        return met.select("anchor", "seg", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b")).alias("past"))

    def ranges(self) -> DataFrame:
        """(tid, tid2, r) of every range of repeated windows: struct(a, b), the first and the one past the last."""
        spark, scratch, unit = self.texts.spark, self.scratch, self.unit
        with text_batches(spark):
            segments = scratch.save(self.texts.read().select("tid", "tid2", "content").mapInArrow(_segments(unit), SEGMENT), "segments", **_HASHES)
        twice = scratch.save(segments.groupBy("anchor").count().filter("count > 1").select(F.col("anchor").alias("k")), "twice")
        shared = scratch.save(segments.join(twice, F.col("anchor") == F.col("k")).drop("k"), "shared", **_HASHES)
        scratch.drop("segments", "twice")
        # numbers alone, whose first row is found without a sort
        place = ("tid", "tid2", "start", "windows", "spot")
        distinct = shared.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in place))
        distinct = distinct.select("anchor", "seg", "copies", F.struct(*place).alias("at"))
        distinct = scratch.save(distinct, "distinct", **_HASHES)
        sizes = scratch.save(distinct.groupBy(F.col("anchor").alias("k")).agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("at.windows").cast("long")).alias("w")).filter("kinds > 1"), "sizes")
        joined = distinct.join(sizes, F.col("anchor") == F.col("k"), "left")
        marks = joined.filter("kinds is null and copies > 1").select("anchor", "seg", F.lit(0).alias("first"), F.col("at.windows").alias("past"))
        hot = F.col("kinds") > self.split_segments
        token = 1 if isinstance(unit, Bytes) else 7  # bytes, about
        load, hottest = sizes.agg(F.sum(F.when(~hot, F.col("w") + F.col("kinds") * unit.size)), F.max("kinds")).first()
        with text_batches(spark), self.texts.partitions():
            several = joined.filter("kinds is not null").select(F.col("at.tid").alias("tid"), F.col("at.tid2").alias("tid2"), hot.alias("hot"),
                F.struct(F.col("at.start").alias("start"), F.col("at.windows").alias("windows"), F.col("at.spot").alias("spot"), "anchor", "seg", "copies").alias("s"))
            if load:
                cut = self.texts.with_lists(several.filter("not hot"), "wanted", "s").select("content", "wanted")
                marks = marks.union(self._sorted(cut.mapInArrow(_cut(unit), GROUP), int(load) * token))
            if (hottest or 0) > self.split_segments:
                cut = self.texts.with_lists(several.filter("hot"), "wanted", "s").select("content", "wanted")
                marks = marks.union(self._hot_marks(cut.mapInArrow(_hot(unit, 0, True), PIECES), 0))
            marks = scratch.save(marks.withColumnsRenamed({"anchor": "k", "seg": "ks"}), "marks")
            spots = shared.join(marks, (F.col("anchor") == F.col("k")) & (F.col("seg") == F.col("ks")))
            spots = scratch.save(spots.select("tid", "tid2", F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("past")).alias("b")).alias("r")), "ranges")
        scratch.drop("shared", "distinct", "sizes", "marks")
        return spots


def repeated_spans(
    docs: DataFrame,
    scratch: Scratch,
    unit: Bytes | Words = Bytes(),
    passages: Words | None = None,
    keep_text: bool = False,
    batch_bytes: int = 3 << 19,
    shard_bytes: int = 8 << 20,
    bucket_bytes: int = 24 << 20,
    split_segments: int = 250,
    most_shards: int = 20000,
    most_buckets: int = 20000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_removed (bytes), n_spans, kept_sha256 of every document.

    With ``passages`` also ``n_passage_words``, the words of passages of that many words that start elsewhere, too; nothing of
    these is removed on their account. With ``keep_text`` also ``kept``, the text left (characters that a span cuts
    through stay whole; null where nothing was removed).
    """
    if unit.size < 2 * unit.gram:
        raise ValueError(f"windows must hold at least {2 * unit.gram} tokens")
    spark = docs.sparkSession
    content = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), content.alias("content")).withColumn("n_bytes", F.octet_length("content").cast("long"))
    index = scratch.save(rows.select("doc_id", "n_bytes", F.unhex(F.sha2("content", 256)).alias("digest")), "index")
    least = min(u.size if isinstance(u, Bytes) else 2 * u.size - 1 for u in (unit, passages) if u)
    with freed_shuffles(spark), _Bucketed(spark, scratch, rows.filter(F.col("n_bytes") >= least).select("content"), bucket_bytes, most_buckets) as texts:
        search = lambda u, name: _Search(texts, Scratch(spark, f"repeats-{name}"), u, batch_bytes, shard_bytes, split_segments, most_shards).ranges()
        found = search(unit, "windows").select("tid", "tid2", F.lit(False).alias("more"), "r")
        if passages:
            found = found.union(search(passages, "passages").select("tid", "tid2", F.lit(True), "r"))
        with text_batches(spark), texts.partitions():
            held = texts.with_lists(found, "found", F.struct("more", "r"), "left").filter("copies > 1 or found is not null")
            of = lambda more: F.transform(F.filter("found", lambda x: x["more"] if more else ~x["more"]), lambda x: x["r"])
            cleaned = held.select("digest", "content", "copies", of(False).alias("ranges"), of(True).alias("passages")).mapInArrow(
                _cut_out(unit, passages, keep_text), "digest binary, n_removed long, n_spans long, kept_sha256 string, kept binary, n_passage_words long"
            )
            cleaned = scratch.save(cleaned.withColumnRenamed("digest", "d"), "cleaned")
    scratch.drop("texts")
    none = F.lit(0).cast("long")
    out = index.join(cleaned, F.col("digest") == F.col("d"), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"), F.coalesce("n_passage_words", none).alias("n_passage_words"),
        F.when(F.col("n_removed") > 0, F.col("kept")).alias("kept"),
    )
    return out.drop(*([] if passages else ["n_passage_words"]), *([] if keep_text else ["kept"]))
