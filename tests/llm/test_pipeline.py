"""The pipeline's stages, one after another, on the smallest tables and on odd ones."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm.decontaminate import _words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before the first stage and after each."""
    out = [spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("clash")).withColumn("row", F.lit(1))]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert after.columns == before.columns
    assert {"doc_id", "piece", "n_tokens", "bucket_len", "batch", "slot"} <= set(stages[-1].columns)


def test_quality_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    words = {r.doc_id: len(r.text.split()) for r in stages[0].collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    good = [d for d, q in labels.items() if q == 1 and words[d] >= 50]
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    assert not [d for d, q in labels.items() if q == 0 and d in kept]


def test_near_dedup_keeps_one_of_each_group(stages):
    def grams(text):
        w = text.encode().lower().split()
        return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)}

    before = {r.doc_id: grams(r.text) for r in stages[1].collect()}
    after = {r.doc_id for r in stages[2].collect()}
    index = collections.defaultdict(set)
    for d, g in before.items():
        for x in g:
            index[x].add(d)
    close, alone = [], set(before)
    for d, g in before.items():
        for e in {e for x in g for e in index[x]} - {d}:
            share = len(g & before[e]) / len(g | before[e])
            if share >= 0.9 and d < e:
                close.append((d, e))
            if share >= 0.6:
                alone.discard(d)
    assert close and not [p for p in close if p[0] in after and p[1] in after]
    assert alone <= after


def test_repeats_are_gone(stages):
    """Passages of 50 words that start twice before the stage are not left, and nothing else is gone."""
    before, seen = {r.doc_id: r.text.split() for r in stages[2].collect()}, collections.Counter()
    for words in before.values():
        seen.update(tuple(words[i : i + 50]) for i in range(len(words) - 49))
    after = {r.doc_id: r for r in stages[3].collect()}
    for d, words in before.items():
        gone = {k for i in range(len(words) - 49) if seen[tuple(words[i : i + 50])] > 1 for k in range(i, i + 50)}
        left = [w for k, w in enumerate(words) if k not in gone]
        assert (d in after) == bool(left) and (not left or after[d].text.split() == left)
    assert all(r.n_chars == len(r.text) and r.text.strip() for r in after.values())


def test_leaks_are_gone(spark, stages):
    items = [_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in items]
    left = {r.doc_id for r in stages[4].collect()}
    for r in stages[3].collect():
        w = _words(r.text)
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        assert (r.doc_id not in left) == any(len(i & own) >= 0.8 * len(i) for i in items)


def test_packing_covers_what_is_left(stages):
    assert {r.doc_id for r in stages[5].select("doc_id").collect()} == {r.doc_id for r in stages[4].select("doc_id").collect()}


def test_odd_tables(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, None, "en", "s", 0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.limit(0)):
            assert stage(spark, df, SF).count() <= 3, name
