"""The corpus pipeline: five stages from raw documents to packed batches (``corpus_pipeline.py`` gives them their place).

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which :func:`run` writes as Parquet and
reads back as the next stage's ``docs``. All but the last return the columns of ``docs``.

1. quality rules: lines that break a rule go from the text, documents that are rejected go whole.
2. SimHash near-dedup over five-word shingles: documents link at an exact Jaccard similarity of 0.8 or more, found by
   fingerprints and, beyond their reach, by prefixes; of each component the smallest id stays, once.
3. suffix-array dedup: passages of 50 words that start more than once go from the text, whatever white space is
   between their words; documents without a word left go.
4. benchmark decontamination: documents that contain 0.8 of the five-word shingles of an item go.
5. packing: pieces in length buckets and token-budget batches.

``n_chars`` follows the text. Null texts are empty texts and fail the quality rules. Rows with a null id or one that
others have too are judged each on its own: of a near-duplicate group the row with the smallest id stays, null ids last.
Repeated rows count as copies. Extra columns are carried along, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import SPACE_CLASS, Scratch, table
from tessella.llm.decontaminate import contaminated_pairs
from tessella.llm.near_sets import similar_texts
from tessella.llm.packing import pack
from tessella.llm.quality import quality_report
from tessella.llm.repeats import Words, repeated_spans


def _packed(docs: DataFrame) -> DataFrame:
    """Rows as one struct, so that their columns clash with nothing."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.col("text"))


def _keyed(spark: SparkSession, docs: DataFrame, label: str) -> DataFrame:
    """Packed rows with a unique ``key`` in the order of ids, null ids last: the id, or a number written with the row."""
    rows = _packed(docs)
    total, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if total == ids:
        return rows.withColumn("key", F.col("doc_id"))
    rows = rows.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text"))
    return Scratch(spark, label).save(rows.withColumn("key", F.monotonically_increasing_id()), "rows")


def _unpacked(rows: DataFrame, columns: list[str], text=None, keep: str | None = None) -> DataFrame:
    """The columns of documents again, with a new text where one is given; with ``keep`` as a struct next to that flag."""
    new = {} if text is None else {"text": text, "n_chars": F.length(text).cast("long")}
    out = [new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in columns]
    return rows.select(*out) if keep is None else rows.select(F.struct(*out).alias("row"), F.col(keep).alias("kept"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_report(_packed(docs).select("row", "text"))
    rows = _unpacked(judged, docs.columns, F.col("_q.clean_text"), keep="_q.kept")
    # rows that stay are generated: a filter would be pushed below the judgement, which would then run twice
    return rows.select(F.inline(F.when(F.col("kept"), F.array("row"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(spark, docs, "pipeline-near-rows")
    found = similar_texts(rows.select(F.col("key").alias("doc_id"), "text"), Scratch(spark, "pipeline-near"))
    first = found.groupBy("component_id").agg(F.min("doc_id").alias("kept_key")).select("kept_key")
    return _unpacked(rows.drop("text").join(first, F.col("key") == F.col("kept_key")), docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(spark, docs, "pipeline-repeats-rows")
    cut = repeated_spans(rows.select(F.col("key").alias("doc_id"), "text"), Scratch(spark, "pipeline-repeats"), unit=Words(50), keep_text=True)
    cut = cut.filter("kept is not null").select(F.col("doc_id").alias("cut_key"), F.decode("kept", "UTF-8").alias("kept"))
    rows = rows.join(cut, F.col("key") == F.col("cut_key"), "left")
    left = F.when(F.col("cut_key").isNull(), F.col("text")).otherwise(F.col("kept"))
    return _unpacked(rows.filter(F.col("cut_key").isNull() | (F.regexp_replace("kept", SPACE_CLASS, "") != "")), docs.columns, left)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(spark, docs, "pipeline-leaks-rows")
    pairs = contaminated_pairs(rows.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), Scratch(spark, "pipeline-leaks"))
    leaks = pairs.select(F.col("doc_id").alias("leak_key")).distinct()
    return _unpacked(rows.drop("text").join(leaks, F.col("key") == F.col("leak_key"), "left_anti"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs.select("doc_id", "text"), Scratch(spark, "pipeline-pack"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("repeats", repeats),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL can express neither the fingerprint search nor the sorts; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
