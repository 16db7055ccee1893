"""Token-id files with Elias-Fano document boundaries.

A block is a header, the document ids, the boundaries and the concatenated ids:

    magic 8 bytes | uint64 x 8: file number, block number, documents, documents with null id, ids,
    byte lengths of the document-id part, the boundary part and the id part

* Document ids (ascending, nulls first) are Elias-Fano over their distance from the first, with that
  first id as int64 in front.
* Boundaries (documents + 1 values from 0 to the number of ids) are Elias-Fano: the low bits of all
  values packed, the high bits as a unary bit vector, and for select the position of every 256th set
  bit as uint32. One offset costs about 2 + log2(ids / documents) bits.
* Ids take 2 bytes each while all are below 65,536, else 4.

Files hold one or more blocks, each followed by one line feed, in ascending id order; a block's file number
is the place of its id range and its block number the place in it. Spark's committer writes them to whatever store the
path names, so a task that is lost or run twice leaves no partial or double file.

Scale: one shuffle carries each text once, by sampled ranges of (id, digest, place in the input), so rows that are repeated are
split, too. A range takes about ``file_text_bytes`` of text, and more where there would be over ``most_ranges``; its blocks then
fill several files of ``file_blocks`` each, so readers, who get a file a row, hold no more of it. Running totals go by
ranges first and by blocks inside a range, so no task sees more rows than there are ranges.

Null text is empty text and still gets its end id. Null ids come first. Repeated rows are each stored.
Extra columns are not read. An empty table makes no block.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, text_batches
from tessella.llm.tokenize import calls, load, public_path

MAGIC = b"TSLIDS02"
HEADER = struct.Struct("<8s8Q")
SELECT_EVERY = 256


class EliasFano:
    """A non-decreasing sequence of unsigned integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = values & np.uint64((1 << low_bits) - 1)
        bits = ((low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        upper[ones] = 1
        return cls(
            n, low_bits, np.packbits(bits.ravel(), bitorder="little").tobytes(),
            np.packbits(upper, bitorder="little").tobytes(), ones[::SELECT_EVERY].astype("<u4"),
        )

    def to_bytes(self) -> bytes:
        return struct.pack("<4Q", self.n, self.low_bits, len(self.low), len(self.high)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, n_low, n_high = struct.unpack_from("<4Q", data)
        at = 32 + n_low
        samples = np.frombuffer(data, "<u4", -(-n // SELECT_EVERY), at + n_high)
        return cls(n, low_bits, data[32:at], data[at : at + n_high], samples)

    def _low(self, i: int) -> int:
        start = i * self.low_bits
        window = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8], "little")
        return (window >> start % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The value at place ``i``: from the nearest sample, set bits are counted byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SELECT_EVERY]), i % SELECT_EVERY
        byte, rest = at // 8, self.high[at // 8] >> at % 8 << at % 8
        while (found := rest.bit_count()) <= left:
            left -= found
            byte += 1
            rest = self.high[byte]
        for _ in range(left):
            rest &= rest - 1
        position = byte * 8 + (rest & -rest).bit_length() - 1
        return (position - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """All values as int64."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
        low = bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return ((ones - np.arange(self.n)) << self.low_bits) + low


def pack_block(file_no: int, block_no: int, doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One block; ``ids`` are little-endian uint32, the end id included, documents in ascending id order."""
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    first = int(known[0]) if len(known) else 0
    doc_part = struct.pack("<q", first) + EliasFano.encode((known - first).astype(np.uint64)).to_bytes()
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.uint64)
    bound_part = EliasFano.encode(ends).to_bytes()
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    if not len(flat) or flat.max() < 1 << 16:
        flat = flat.astype("<u2")
    head = HEADER.pack(MAGIC, file_no, block_no, len(doc_ids), len(doc_ids) - len(known), len(flat), len(doc_part), len(bound_part), flat.nbytes)
    return head + doc_part + bound_part + flat.tobytes()


def unpack_blocks(content: bytes) -> Iterator[tuple[int, int, list[int | None], EliasFano, np.ndarray]]:
    """(file number, block number, document ids, boundaries, ids) of each block of a file."""
    at = 0
    while at < len(content):
        magic, file_no, block_no, n_docs, n_null, n_ids, *lengths = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a token-id block")
        at += HEADER.size
        parts = []
        for length in lengths:
            parts.append(content[at : at + length])
            at += length
        if len(parts[-1]) != lengths[-1] or content[at : at + 1] != b"\n":
            raise ValueError("a token-id block is cut short")
        at += 1
        known = EliasFano.from_bytes(parts[0][8:]).all() + struct.unpack_from("<q", parts[0])[0]
        bounds = EliasFano.from_bytes(parts[1])
        if bounds.n != n_docs + 1 or bounds.select(n_docs) != n_ids:
            raise ValueError("boundaries disagree with the ids")
        width = 2 if lengths[2] == 2 * n_ids else 4
        yield file_no, block_no, [None] * n_null + known.tolist(), bounds, np.frombuffer(parts[2], f"<u{width}")


def _writer(tokenizer: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = load(tokenizer if os.sep in tokenizer else public_path(tokenizer))
        end = np.array([end_id], dtype="<u4").tobytes()
        file_no, block_no, held, docs, ids = TaskContext.get().partitionId(), 0, 0, [], []
        block = lambda: pa.RecordBatch.from_arrays([pa.array([pack_block(file_no, block_no, docs, ids)], pa.binary())], names=["block"])
        for numbers, texts in calls(batches):
            for doc, found in zip(numbers, model.encode(texts), strict=True):
                docs.append(doc)
                ids.append(found + end)
                held += len(found) // 4 + 1
                if held >= block_ids:
                    yield block()
                    block_no, held, docs, ids = block_no + 1, 0, [], []
        if docs:
            yield block()

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    file_text_bytes: int = 16 << 20,
    block_ids: int = 2 << 20,
    file_blocks: int = 4,
    most_ranges: int = 20000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every text and write the id files under ``path`` in ascending id order."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(1, min(most_ranges, -(-total // file_text_bytes)))
    order = ("doc_id", "digest", "place")
    placed = rows.withColumns({"digest": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")
    with text_batches(spark):
        blocks = ordered.mapInArrow(_writer(tokenizer, end_id, block_ids), "block binary")
        blocks.select(F.col("block").cast("string").alias("value")).write.options(lineSep="\n", maxRecordsPerFile=file_blocks).text(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "file_no", "block_no", "local_start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for content in batch.column(0):
            for file_no, block_no, docs, bounds, ids in unpack_blocks(content.as_py()):
                ends = bounds.all()
                wide = ids.astype("<u4")
                crcs = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                columns = [docs, [file_no] * len(docs), [block_no] * len(docs), ends[:-1], np.diff(ends), crcs]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def read_token_files(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files alone."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("content")
    with text_batches(spark, 1):
        rows = scratch.save(
            files.mapInArrow(_reader, "doc_id long, file_no long, block_no long, local_start long, n_tokens long, ids_crc32 long"), "documents"
        )
    earlier = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = rows.groupBy("file_no", "block_no").agg(F.sum("n_tokens").alias("n"))
    blocks = blocks.withColumn("inside", earlier(Window.partitionBy("file_no").orderBy("block_no")))
    # a row a range, of which there are at most ``most_ranges``
    ranges = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    ranges = ranges.select("file_no", earlier(Window.orderBy("file_no")).alias("base"))
    before = blocks.join(ranges, "file_no").select("file_no", "block_no", (F.col("base") + F.col("inside")).alias("base"))
    return rows.join(before, ["file_no", "block_no"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def read_document(content: bytes, doc_id: int) -> list[np.ndarray]:
    """The ids of a document's rows in a file, by two selects of its boundaries each; no other offset is decoded."""
    out = []
    for _, _, docs, bounds, ids in unpack_blocks(content):
        known = np.array([d for d in docs if d is not None], dtype=np.int64)
        nulls = len(docs) - len(known)
        for k in range(int(np.searchsorted(known, doc_id)), int(np.searchsorted(known, doc_id, side="right"))):
            out.append(ids[bounds.select(nulls + k) : bounds.select(nulls + k + 1)])
    return out
