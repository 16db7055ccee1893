"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import oracles, pipeline
from tessella.llm.common import Scratch, table
from tessella.llm.decontaminate import contaminated_pairs
from tessella.llm.language import identify
from tessella.llm.packing import pack
from tessella.llm.quality import line_quality
from tessella.llm.repeats import Words, repeated_spans
from tessella.llm.simhash import near_duplicates
from tessella.llm.token_counts import count_tokens
from tessella.llm.token_files import read_token_files, write_token_files
from tessella.llm.toxicity import toxicity
from tessella.llm.warc import warc_round_trip


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), Scratch(spark, "packing"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "leaks"))


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"), Scratch(spark, "warc"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents"))


def op5_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), Scratch(spark, "language"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"), Scratch(spark, "repeats"), passages=Words())


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), scratch.path("files"))
    return read_token_files(spark, scratch.path("files"), scratch)


def op8_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "toxicity"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-counts")
    return count_tokens(table(spark, sf_dir, "documents"), scratch.path("cache"), scratch=scratch)


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "simhash"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_length_buckets": op1_length_buckets,
        "op2_decontamination": op2_decontamination,
        "op3_warc_segments": op3_warc_segments,
        "op4_line_quality": op4_line_quality,
        "op5_language_codes": op5_language_codes,
        "op6_suffix_array": op6_suffix_array,
        "op7_token_files": op7_token_files,
        "op8_toxicity_ftrl": op8_toxicity_ftrl,
        "op9_token_counts": op9_token_counts,
        "op10_simhash_components": op10_simhash_components,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
