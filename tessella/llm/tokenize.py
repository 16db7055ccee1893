"""Token ids and counts from public tokenizer files; repeated pieces are encoded once.

Both fast paths rest on a property of the model that is checked when it is loaded; texts outside
the property go to the library whole, so results always equal the library's own.

* sentencepiece BPE: if no vocabulary piece holds a non-space character before a space mark, merges
  never cross a word start; if none holds a line feed, they never cross a line feed either. Each word
  is then encoded once and its count kept.
* byte-level BPE of the tokenizers library: merges never cross the pre-tokenizer's pieces. Texts of
  ordinary Latin characters without white-space runs are cut where its pattern always cuts, and each
  stretch is encoded once. Cutting, finding a call's distinct stretches and putting their ids together are
  Arrow's work; only distinct stretches are looked up.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries a memo holds before it starts anew; bounds its memory at about 100 MB a worker.
MEMO_ENTRIES = 400_000

#: Fixed value: the pre-tokenizer pattern of byte-level BPE.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text that is worth one call of ``encode`` or ``count``, so that repeated stretches meet; bounds its memory at some 150 MB.
CALL_CHARS = 4 << 20


class PieceModel:
    """Counts of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        inner = any("▁" in p.lstrip("▁") for p in pieces) or any("\n" in p for p in pieces)
        probe = "Añ ﬁx ①\té\u0301\nb"
        self.decomposes = not inner and self.sp.normalize(probe).replace("▁", " ").lstrip(" ") == probe
        self.words: dict[str, int] = {}
        self.tails: dict[str, int] = {}

    def count_whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.sp.encode(texts, num_threads=1)]

    def _learn(self, texts: list[str]) -> None:
        if len(self.words) + len(self.tails) > MEMO_ENTRIES:
            self.words.clear()
            self.tails.clear()
        words, tails = set(), set()
        for text in texts:
            for piece in set(text.split(" ")):
                if "\n" in piece:
                    first, *rest = piece.split("\n")
                    words.add(first)
                    tails.update(rest)
                else:
                    words.add(piece)
        fresh = [w for w in words if w and w not in self.words]
        self.words.update(zip(fresh, (len(x) for x in self.sp.encode(fresh, num_threads=1)), strict=True))
        fresh = [w for w in tails if w and w not in self.tails]
        # the space mark and the line feed go before the tail
        self.tails.update(zip(fresh, (len(x) - 2 for x in self.sp.encode(["\n" + w for w in fresh], num_threads=1)), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        """Token counts, equal to the library's for each text."""
        fit = [t for t in texts if self.decomposes and "▁" not in t and "\x00" not in t and "  " not in t and t[:1] != " " and t[-1:] != " "]
        self._learn(fit)
        chosen = set(map(id, fit))
        out = []
        for text in texts:
            if id(text) not in chosen:
                out.append(self.count_whole([text])[0])
                continue
            total = 0
            for piece in text.split(" ") if text else ():
                if "\n" in piece:
                    first, *rest = piece.split("\n")
                    total += (self.words[first] if first else 1) + sum(1 + (self.tails[w] if w else 0) for w in rest)
                else:
                    total += self.words[piece]
            out.append(total)
        return out


def _buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of large strings or binaries."""
    _, offsets, data = values.buffers()
    if offsets is None or not len(values):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    return np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1], np.frombuffer(data or b"", np.uint8)


def _array(kind: pa.DataType, offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class ByteBpeModel:
    """Ids of a tokenizers file; in byte-level BPE without a normaliser equal stretches are encoded once a call."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.tokenize = self.tokenizer.model.tokenize
        self.byte_level = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and spec["model"].get("type") == "BPE"
            and not spec["model"].get("dropout")
        )
        self.specials = [t["content"] for t in spec.get("added_tokens", ())]
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = np.arange(256, dtype="<u2")
        self.alphabet[hidden] = 256 + np.arange(len(hidden))
        self.ordinary = re.compile("[\n\x20-\x7e¡-ſ]*")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _fits(self, text: str) -> bool:
        """Whether the text has only ordinary Latin characters, no white-space runs and no special tokens."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return False
        if not self.byte_level or any(s in text for s in self.specials):
            return False
        flat = text.replace("\n", "")
        try:
            flat.encode("latin-1")
        except UnicodeEncodeError:
            return self.ordinary.fullmatch(text) is not None
        return flat.isprintable()

    def _distinct(self, parts: pa.Array) -> pa.Array:
        """Ids of pre-tokens, each of which goes to the library's model once."""
        coded = parts.dictionary_encode()
        offsets, data = _buffers(coded.dictionary)
        shown = self.alphabet[data].tobytes().decode("utf-16-le")  # a character for each byte
        tokenize, ids, ends, at = self.tokenize, array("I"), [0], offsets.tolist()
        for a, b in zip(at, at[1:], strict=False):
            ids.extend([t.id for t in tokenize(shown[a:b])])
            ends.append(4 * len(ids))
        return _array(pa.large_binary(), np.array(ends), np.frombuffer(ids, np.uint32)).take(coded.indices)

    def _stretch_ids(self, pieces: pa.Array) -> pa.Array:
        """Ids of stretches: a space and letters are one pre-token, ASCII marks after them another; others are cut by the pattern."""
        words = pc.utf8_rtrim(pieces, string.punctuation)
        plain = pc.utf8_is_alpha(pc.utf8_ltrim(words, " "))
        words, whole = words.filter(plain), pieces.filter(plain)
        (starts, _), (ends, data) = _buffers(words), _buffers(whole)
        size = np.diff(ends) - np.diff(starts)
        past = np.cumsum(size)
        marks = _array(pa.large_string(), np.append(0, past), data[np.repeat(ends[1:] - past, size) + np.arange(size.sum())])
        parts = [self.pattern.findall(p) for p in pieces.filter(pc.invert(plain)).to_pylist()]
        ids = self._distinct(pa.concat_arrays([words, marks, pa.array([x for p in parts for x in p], pa.large_string())]))
        known = pc.binary_join_element_wise(ids[: len(words)], ids[len(words) : 2 * len(words)], pa.scalar(b"", pa.large_binary()))
        ends, data = _buffers(ids[2 * len(words) :])
        other = _array(pa.large_binary(), ends[np.cumsum([0, *map(len, parts)])], data)
        plain = plain.to_numpy(zero_copy_only=False)
        return pa.concat_arrays([known, other]).take(pa.array(np.where(plain, np.cumsum(plain) - 1, len(known) + np.cumsum(~plain) - 1)))

    def _stretches(self, texts: list[str]) -> tuple[np.ndarray, pa.Array]:
        """Of texts that fit: each text's first stretch and the end, and the ids of the stretches.

        In a text without white-space runs, each space opens a piece and each line feed is a piece, so the
        stretches between them encode independently: those after a space with that space, others without.
        """
        marked = [t.replace(" ", "\x00 ").replace("\n", "\x00\n\x00") for t in texts]
        cut = pc.split_pattern(pa.array(marked, pa.large_string()), "\x00")
        coded = cut.values.dictionary_encode()
        return cut.offsets.to_numpy(), self._stretch_ids(coded.dictionary).take(coded.indices)

    def _found(self, texts: list[str]) -> tuple[list[bool], np.ndarray, np.ndarray]:
        """Whether each text fits; where the ids of those that do begin and end, in bytes; these ids."""
        fit = [self._fits(t) for t in texts]
        firsts, ids = self._stretches([t for t, f in zip(texts, fit, strict=True) if f])
        ends, data = _buffers(ids)
        return fit, ends[firsts], data

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        fit, ends, data = self._found(texts)
        spans = iter(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        return [data[slice(*next(spans))].tobytes() if f else self._whole(t) for t, f in zip(texts, fit, strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        fit, ends, _ = self._found(texts)
        counts = iter((np.diff(ends) // 4).tolist())
        return [next(counts) if f else len(self._whole(t)) // 4 for t, f in zip(texts, fit, strict=True)]


def calls(batches: Iterator[pa.RecordBatch], chars: int = CALL_CHARS) -> Iterator[tuple[list, list[str]]]:
    """The rows (first column, text) of small batches, as many together as are worth one call."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text)
            held += len(text) + 16
            if held >= chars:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel | ByteBpeModel:
    """The model of a file, once a worker: ``.json`` for tokenizers, ``.model`` for sentencepiece."""
    return PieceModel(path) if path.endswith(".model") else ByteBpeModel(path)


@lru_cache(maxsize=4)
def version_digest(path: str) -> str:
    """SHA-256 of the tokenizer file: the version under which counts are cached."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def public_path(name: str) -> str:
    """Place of a public tokenizer file, on whichever machine asks."""
    import public_tokenizers

    return public_tokenizers.path(name)
