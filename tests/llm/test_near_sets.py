"""The pipeline's near-duplicate stage against brute force around its similarity of 0.8."""

import random

import pytest

import corpus_pipeline
from tessella.llm import near_sets


def grams(text):
    w = text.encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)}


@pytest.fixture(scope="module")
def copies(spark):
    """Texts, 0 to 16 words of their copies replaced, the similarity of each pair, and the ids that stay."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    texts, shares = {}, {}
    for k in range(150):
        own = rng.choices(words, k=rng.randint(60, 400))
        copy = list(own)
        for at in rng.sample(range(len(copy)), round(len(copy) * rng.uniform(0.015, 0.035))):
            copy[at] = rng.choice(words)
        texts[2 * k], texts[2 * k + 1] = " ".join(own), " ".join(copy)
        a, b = grams(texts[2 * k]), grams(texts[2 * k + 1])
        shares[2 * k] = len(a & b) / len(a | b)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return shares, {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}


def test_no_pair_at_the_similarity_stays(copies):
    shares, left = copies
    close = [d for d, share in shares.items() if 0.8 <= share < 0.85]
    assert len(close) >= 15 and not [d for d, share in shares.items() if share >= 0.8 and d + 1 in left]
    assert all(d in left for d in shares)


def test_texts_below_the_similarity_stay(copies):
    shares, left = copies
    below = [d for d, share in shares.items() if 0.75 <= share < 0.8]
    assert len(below) >= 15 and all(d + 1 in left for d, share in shares.items() if share < 0.8)


@pytest.mark.parametrize("small", [1, 8, 1000])
def test_large_groups_of_one_template(spark, tmp_path, monkeypatch, small):
    """Components are those of brute force where all texts share a template, whatever the blocks."""
    from tessella.llm.common import Scratch
    from tessella.llm.simhash import Trees

    monkeypatch.setattr(near_sets, "BLOCK", 16)
    monkeypatch.setattr(near_sets, "SMALL", small)
    rng = random.Random(6)
    base = [f"b{k}" for k in range(150)]
    texts = {}
    for d in range(160):
        own = list(base)
        for at in rng.sample(range(150), rng.randint(0, 9)):
            own[at] = f"x{rng.randint(0, 10**6)}"
        texts[d] = " ".join(own)
    sets, trees = {d: grams(t) for d, t in texts.items()}, Trees()
    for d in sets:
        for e in range(d):
            if 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e]):
                trees.join(d, e)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {}
    for r in near_sets.similar_texts(docs, Scratch(spark, "test-near")).collect():
        found.setdefault(r.component_id, set()).add(r.doc_id)
    want = {}
    for d in sets:
        want.setdefault(trees.root(d), set()).add(d)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_rows_with_null_or_repeated_ids_are_judged_alone(spark):
    """Different texts stay, copies go once, repeated spans and leaks go from the rows that have them."""
    rng = random.Random(7)
    make = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(120))
    one, two, three, four, five = (make() for _ in range(5))
    rows = [(None, one), (None, two), (None, one), (7, three), (7, four), (8, five), (None, five)]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted([(True, 0, one), (True, 0, two), (False, 7, three), (False, 7, four), (False, 8, five)])

    shared = make()
    rows = [(None, f"{one} {shared}"), (7, f"{shared} {two}"), (7, three)]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    got = [r.text for r in corpus_pipeline.repeats(spark, docs, "").collect()]
    assert len(got) == 3 and three in got and not [t for t in got if shared in t]

    sf = "/root/testdata/sf0.001"
    leak = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    docs = spark.createDataFrame([(None, leak, 1), (None, one, 1), (7, leak, 1), (7, two, 1)], "doc_id long, text string, n_chars long")
    assert sorted(r.text for r in corpus_pipeline.decontaminate(spark, docs, sf).collect()) == sorted([one, two])
