"""Quality rules, line first: bad lines go, then documents that lost too much text.

Native: every step is a Spark SQL function, so the plan is one scan with a projection and neither
shuffles nor starts Python.

Per line that holds a word, four rules; a line that breaks one of them is removed:

* punctuation - a line must hold a sentence end (one of ``. ! ? …`` or their full-width forms, closing
  quotes may follow, then white space or the line's end), unless it has fewer than ``min_prose_words``
  words and no separators (short headings and list items stay);
* navigation - the share of separator words (``| » › • > ·`` alone) exceeds ``max_separators``;
* shouting or symbols - over ``max_shouted`` of the words end in two or more marks of
  ``! # * $ % &``;
* boilerplate - the line matches one of :data:`BOILERPLATE`.

A document is rejected when the lines removed hold more than ``max_lost`` of its words.

Null text counts as empty text. Empty text has no words: it fails the base rule, and nothing is
removed from it. Repeated rows are judged each on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACE_CLASS

WORD = r"[^\x20\x09-\x0D]"

#: Lines of page furniture, whole line, case ignored.
BOILERPLATE = (
    r"(?i)^\s*(?:(?:please )?(?:enable|turn on) (?:java ?script|cookies)\b.*"
    r"|(?:this (?:site|website)|we) uses? cookies\b.*"
    r"|(?:accept|reject|manage) (?:all )?cookies\s*\W*"
    r"|(?:home|menu|log ?in|sign ?(?:in|up)|share|tweet|print|read more|skip to content|back to top|next|previous|subscribe|search)\s*\W*"
    r"|(?:share this|follow us) on\b.*"
    r"|lorem ipsum\b.*"
    r"|\W*(?:copyright|©|\(c\))\s*\d{4}.*all rights reserved\W*)$"
)


@dataclass(frozen=True)
class QualityRules:
    """Thresholds of the rules."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_prose_words: int = 12
    max_separators: float = 0.2
    max_shouted: float = 0.3
    max_lost: float = 0.5


def words_of(text: Column) -> Column:
    """Words of a text, in order; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def line_is_bad(line: Column, rules: QualityRules) -> Column:
    """Whether a line with words breaks a rule; the counts run only on lines that a cheap search marks."""
    n_words = F.size(words_of(line))
    spaced = F.concat(F.lit(" "), F.regexp_replace(line, SPACE_CLASS, "  "), F.lit(" "))
    has_separator = line.rlike(r"[|»›•>·]") & line.rlike(r"(?:^|[\x20\x09-\x0D])[|»›•>·]+(?:[\x20\x09-\x0D]|$)")
    has_marks = line.rlike(r"[!#*$%&]{2}")
    ended = line.rlike(r"[.!?…。！？][\"'”’»)\]]*(?:[\x20\x09-\x0D]|$)")
    return (
        F.when(has_separator & (F.regexp_count(spaced, F.lit(r" [|»›•>·]+ ")) > n_words * rules.max_separators), True)
        .when(has_marks & (F.regexp_count(spaced, F.lit(r"[!#*$%&]{2,} ")) > n_words * rules.max_shouted), True)
        .when(~ended & (has_separator | (n_words >= rules.min_prose_words)), True)
        .otherwise(line.rlike(BOILERPLATE))
    )


def _measured(docs: DataFrame, rules: QualityRules, text_col: str) -> DataFrame:
    """_row (all columns of ``docs`` as a struct), the measures, the text without bad lines and the verdicts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text.alias("_text"))
    split = rows.withColumns({
        "words": words_of(F.col("_text")),
        "all_lines": F.split(F.col("_text"), "\n"),
    }).withColumn("lines", F.filter("all_lines", lambda x: x.rlike(WORD)))
    hashed = split.select(
        "_row", "_text", "lines", "all_lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.when(
            F.size("words") >= 3,
            F.expr("transform(sequence(0, greatest(size(words) - 3, 0)), i -> xxhash64(words[i], words[i + 1], words[i + 2]))"),
        ).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
        F.transform("all_lines", lambda x: F.when(x.rlike(WORD), line_is_bad(x, rules)).otherwise(False)).alias("bad"),
    )
    sorted_windows = hashed.withColumn(
        "windows",
        F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ),
    )
    repeated = F.expr(
        "filter(transform(windows, (w, k) -> if(w.h = get(windows, k - 1).h or w.h = get(windows, k + 1).h, w.p, -1)), p -> p >= 0)"
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda p: F.array(p, p + 1, p + 2)))))
    bad_lines = F.filter("all_lines", lambda x, i: F.element_at("bad", i + 1))
    good_lines = F.filter("all_lines", lambda x, i: ~F.element_at("bad", i + 1))
    symbols = "[#*$%&|<>]"
    figures = sorted_windows.select(
        "_row", "_text", "n_words", "word_chars",
        F.when(F.col("_text").rlike(symbols), F.length("_text") - F.length(F.regexp_replace("_text", symbols, "")))
        .otherwise(0).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("windows").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.when(F.array_contains("bad", True), F.size(words_of(F.array_join(bad_lines, " ")))).otherwise(0).cast("long").alias("lost_words"),
        F.size(F.filter("bad", lambda b: b)).cast("long").alias("n_bad_lines"),
        F.when(F.array_contains("bad", True), F.array_join(good_lines, "\n")).otherwise(F.col("_text")).alias("clean_text"),
    )
    judged = figures.withColumn(
        "base_failed",
        (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
    )
    # the row number keeps a filter on the verdict above this projection; below it, the optimizer
    # would put every measure into the filter again, nested ones for each word
    within = (F.col("lost_words") <= F.col("n_words") * rules.max_lost) & (F.monotonically_increasing_id() >= 0)
    return judged.withColumn("kept", ~F.col("base_failed") & within)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "n_bad_lines")


def quality_report(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus a struct ``_q`` with the measures, the verdicts and the clean text.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words,
    n_bad_lines, kept, clean_text. The struct keeps input columns of any name apart from the results.

    Repeated 3-word windows are found by XXH64 of their words: where all hashes of a text differ, none
    repeats; else hashes are sorted with their positions and neighbours compared, n log n a text.
    """
    return _measured(docs, rules, text_col).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns],
        F.struct(*MEASURES, "clean_text").alias("_q"),
    )


def line_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The contract's row per document: doc_id, the measures, base_failed, kept and the lost words."""
    return _measured(docs.select("doc_id", "text"), rules, "text").select(F.col("_row.doc_id").alias("doc_id"), *MEASURES)
