"""Language identification with error-correcting output codes.

Each language gets a codeword. For every bit a logistic classifier over hashed byte n-grams (1 to 3 bytes of
the lower-cased letters, other ASCII as spaces) predicts the bit. Decoding sums, per language, the
logistic losses of its bits, each weighted by how far that bit's classifier beats chance on
examples kept aside, and picks the least; a small lead over the next language flags ambiguity.

Up to six languages use the exhaustive code (2^(k-1) - 1 bits), more use the random code with the largest
least distance of 200 drawn from a fixed seed.

Learning: of every language at most ``per_language`` documents, fewer where languages are many (``sample_rows`` over their number, 8
at least), chosen by the order of a hash of their ids and one a repeated row, whole, plus windows of their letters so that
short texts are seen. Executors turn them to sparse counts; the driver fits the bits over blocks of them. The bounds are the
same at every size of input.

Prediction: one scan with broadcast weights of fixed size, over whole texts, without shuffle.

``und`` where the text is null or holds no letter, or where no language could be learned; its score is 0.
Null ids are never learned from and not held out. Repeated rows are each predicted and learned from once; rows that
share an id but not their text count as different ones. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, crc_bucket, text_batches

_LETTER = re.compile(r"[^\W\d_]")
_TO_SPACE = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256))
_ORDERS = 3


@dataclass(frozen=True)
class LanguageModel:
    """What executors need to predict."""

    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # dims x bits, float32
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit
    ambiguous_lead: float


def letters(text: str) -> bytes:
    """Lower-cased letters with one space for each run of other characters, a space at either end."""
    return b" " + b" ".join(text.lower().encode().translate(_TO_SPACE).split()) + b" "


def gram_places(data: bytes, dims: int) -> np.ndarray:
    """Places of all n-grams of all orders in a table of ``dims`` (a power of two) rows."""
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    shift = np.uint32(32 - dims.bit_length() + 1)
    out, gram = [], np.zeros(len(raw), dtype=np.uint32)
    for order in range(1, _ORDERS + 1):
        n = len(raw) - order + 1
        if n < 1:
            break
        gram = gram[:n] * np.uint32(257) + raw[order - 1 :] + np.uint32(1)
        out.append((gram * np.uint32(2654435761)) >> shift)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def _bits_of(places: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[places].mean(axis=0, dtype=np.float64) if len(places) else np.zeros(weights.shape[1])


def codewords(k: int) -> np.ndarray:
    """Codewords of ``k`` languages as rows of -1 and 1."""
    if k <= 6:
        bits = np.arange(1, 1 << (k - 1)) if k > 1 else np.array([1])
        first = np.ones((1, len(bits)), dtype=np.int64)
        rest = [1 - 2 * ((bits >> j) & 1) for j in range(k - 1)]
        return np.vstack([first, *rest]) if k > 1 else first
    rng, length = np.random.default_rng(7), int(10 * np.log2(k))
    best, most = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], size=(k, length))
        apart = (length - code @ code.T) // 2
        least = int((apart + length * np.eye(k, dtype=np.int64)).min())
        if least > most:
            best, most = code, least
    return best


def decode(margins: np.ndarray, model: LanguageModel) -> tuple[str, float, bool]:
    """(language, score, ambiguous) of the bit classifiers' margins."""
    losses = (np.logaddexp(0, -model.code * margins) * model.trust).sum(axis=1)
    odds = np.exp(losses.min() - losses)
    shares = np.sort(odds / odds.sum())
    lead = shares[-1] - (shares[-2] if len(shares) > 1 else 0)
    return model.languages[int(losses.argmin())], float(shares[-1]), bool(lead < model.ambiguous_lead)


def _examples(dims: int, windows: int):
    """Sparse counts of whole documents and of windows of their letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, places, counts = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = letters(text)
                rng = np.random.default_rng(len(data))
                cuts = [(0, len(data))]
                for _ in range(windows):
                    size = int(rng.integers(12, 160))
                    at = int(rng.integers(0, max(1, len(data) - size)))
                    cuts.append((at, at + size))
                for a, b in cuts:
                    found, n = np.unique(gram_places(data[a:b], dims), return_counts=True)
                    langs.append(lang)
                    places.append(found.astype(np.int32).tobytes())
                    counts.append((n / max(1, n.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "places", "shares"]
            )

    return run


#: Examples that are dense at once while bits are fitted.
DENSE_ROWS = 2048


def dense(examples: list[tuple[np.ndarray, np.ndarray]], dims: int) -> np.ndarray:
    """Sparse (places, shares) as rows."""
    out = np.zeros((len(examples), dims), dtype=np.float32)
    for k, (places, shares) in enumerate(examples):
        out[k, places] = shares
    return out


def fit_bits(examples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, scale: float = 1.0, epochs: int = 60, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic weights of all bits at once, by Adam over full batches; ``y`` holds -1 and 1.

    Few examples stay dense; more are made dense block by block in each step.
    """
    w, b = np.zeros((dims, y.shape[1]), dtype=np.float32), np.zeros(y.shape[1], dtype=np.float32)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    blocks = [slice(k, k + DENSE_ROWS) for k in range(0, len(examples), DENSE_ROWS)]
    held = [dense(examples[s], dims) * np.float32(scale) for s in blocks] if len(blocks) <= 4 else None
    for step in range(1, epochs + 1):
        grad, lean = 1e-7 * w, np.zeros_like(b)
        for k, s in enumerate(blocks):
            x = held[k] if held else dense(examples[s], dims) * np.float32(scale)
            slope = (-y[s] / (1 + np.exp(np.clip(y[s] * (x @ w + b), -30, 30)))).astype(np.float32)
            grad += x.T @ slope / len(examples)
            lean += slope.sum(axis=0) / len(examples)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        b -= rate * lean
    return w, b


def _temperature(margins: np.ndarray, truth: np.ndarray, code: np.ndarray, trust: np.ndarray) -> float:
    """The divisor of the margins under which the scores of examples kept aside are likeliest."""

    def surprise(heat: float) -> float:
        losses = (np.logaddexp(0, -code[None] * margins[:, None] / heat) * trust).sum(axis=2)
        shares = -losses - np.logaddexp.reduce(-losses, axis=1, keepdims=True)
        return -shares[np.arange(len(truth)), truth].sum()

    return min((1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0), key=surprise) if len(truth) else 1.0


def fit(docs: DataFrame, learn: Column, per_language: int = 200, sample_rows: int = 1600, dims: int = 1 << 13, windows: int = 3, ambiguous_lead: float = 0.2) -> LanguageModel | None:
    """Learn from rows of ``docs`` (doc_id, text, lang) where ``learn`` holds; None if there are none."""
    spark = docs.sparkSession
    usable = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    names = sorted(r[0] for r in usable.select("lang").distinct().collect())
    if not names:
        return None
    each = max(8, min(per_language, sample_rows // len(names)))
    rows_at_most = each * len(names)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h"))
    chosen = usable.select("doc_id", "lang", "h").withColumn("place", place).filter(F.col("place") <= each).drop("place").distinct()
    chosen = F.broadcast(chosen) if rows_at_most <= 100_000 else chosen
    with text_batches(spark):
        # a row that is repeated comes once, so no more than the chosen rows reach the driver
        sample = usable.join(chosen, ["doc_id", "lang", "h"]).groupBy("doc_id", "lang", "h").agg(F.first("text").alias("text")).select("lang", "text")
        rows = sample.mapInArrow(_examples(dims, windows), "lang string, places binary, shares binary").collect()
    rows = [r for r in rows if r.places]
    rows.sort(key=lambda r: (r.lang, bytes(r.places), bytes(r.shares)))
    if not rows:
        return None
    examples = [(np.frombuffer(r.places, np.int32), np.frombuffer(r.shares, np.float32)) for r in rows]
    scale, code, number = 50.0, codewords(len(names)), {name: k for k, name in enumerate(names)}
    truth = np.array([number[r.lang] for r in rows])
    y = code[truth].astype(np.float32)
    aside = np.arange(len(rows)) % 8 == 5
    w, b = fit_bits([e for e, a in zip(examples, aside, strict=True) if not a], y[~aside], dims, scale)
    margins = np.array([scale * (shares @ w[places]) + b for (places, shares), a in zip(examples, aside, strict=True) if a], dtype=np.float64).reshape(-1, y.shape[1])
    right = (margins * y[aside] > 0).mean(axis=0) if aside.any() else np.ones(code.shape[1])
    trust = np.clip(2 * right - 1, 0.05, 1.0)
    heat = _temperature(margins, truth[aside], code, trust)
    return LanguageModel(names, code, (w * scale / heat).astype(np.float32), (b / heat).astype(np.float64), trust, ambiguous_lead)


def predict(docs: DataFrame, model: LanguageModel | None, held_out: Column, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                if known is None or text is None or not _LETTER.search(text):
                    out.append(("und", 0.0, True))
                else:
                    out.append(decode(_bits_of(gram_places(letters(text), len(known.weights)), known.weights) + known.bias, known))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    with text_batches(spark):
        return scratch.save(rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, ambiguous boolean"), "languages")


def identify(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The contract's row per document, learned from rows whose crc32 bucket of four is not 2."""
    bucket = crc_bucket(F.col("doc_id"), 4)
    model = fit(docs, bucket != 2)
    return predict(docs.select("doc_id", "text"), model, bucket == 2, scratch)
