"""Training-data operators against brute force, exact round trips and edge cases, on small tables."""

import collections
import hashlib
import itertools
import json
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontaminate, language, packing, quality, repeats, simhash, suffix_sort, token_counts, token_files, toxicity, warc
from tessella.llm.common import Scratch, session_conf
from tessella.llm.components import components
from tessella.llm.tokenize import ByteBpeModel, load, public_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "eins", "zwei", "né", "été", "straße", "run", "stop", "go."]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def texts():
    """Odd texts: null, empty, blank, short, repeated, long, copies and shared passages."""
    rng = random.Random(5)
    shared = prose(rng, 90)
    out = [None, "", " \n\t ", "a", "a b", "x y z", "\n", prose(rng, 60), "same line here.\n" * 30, "w " * 200, "A" * 3000, prose(rng, 3000)]
    copy = prose(rng, 120)
    out += [copy, copy, copy + " tail9.", prose(rng, 40) + " " + shared + " " + prose(rng, 30), prose(rng, 20) + " " + shared, "# $ % & | < >", "é" * 500, "é" * 500]
    out += [prose(rng, rng.randrange(1, 200)) for _ in range(25)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k * 7, t, None if k % 9 == 0 else "en", "s", None) for k, t in enumerate(texts)]
    rows.append((None, "no id at all.", None, None, None))
    return spark.createDataFrame(rows, DOCS).withColumn("count", F.lit(1)).withColumn("words", F.lit("clash"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# quality


def measures(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {p + k for at in windows.values() if len(at) > 1 for p in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs, texts):
    got = by_id(quality.line_quality(docs))
    for k, t in enumerate(texts):
        r = got[k * 7]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_lines(spark, none):
    good = "This is a plain line of prose that ends as it should, with a stop. " * 6
    shout = " ".join(f"WORD{k}!!" for k in range(70))
    table = " | ".join(f"cell{k}" for k in range(70))
    page = good.strip() + "\nHome\nLorem ipsum dolor sit amet.\n" + " | ".join(["News", "Sport", "Shop"])
    rows = [(1, good), (2, shout), (3, table), (4, page), (5, good + "idiot")]
    got = {r.doc_id: r for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "_q.*").collect()}
    assert [got[k].kept for k in (2, 3)] == [False, False]
    assert got[1].clean_text == good
    assert got[4].clean_text == good.strip()
    assert quality.line_quality(none).count() == 0


# warc


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    big, mid = "é<p>\r\n\r\nWARC/1.1\r\n" * 400, "m" * 999
    htmls = [None, "", "x", big, big, big, mid, mid, "k" * 1000, "k" * 1000, "".join(rng.choice("ab\n") for _ in range(5000))]
    rows = [(k, None if k == 2 else f"http://a/{k} ä\r\nX: y", h) for k, h in enumerate(htmls)]
    rows += [(7, "http://again", "k" * 1000), (None, "http://none", "k" * 1000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("segment", [300, 1 << 16])
def test_warc_round_trip(spark, pages, segment):
    scratch = Scratch(spark, "t-warc")
    warc.write_warc(pages, scratch.path("a"), scratch, segment_bytes=segment, chunk_bytes=77, bundle_bytes=900, bundles_per_file=2)
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, scratch.path("a"), scratch).collect())
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    top = {}
    for page, body in rows:
        if len(body) >= 1000 and page is not None:
            top[body] = max(page, top.get(body, page))
    want = collections.Counter()
    for page, body in rows:
        refers = top[body] if body in top and (page is None or page < top[body]) else None
        want[(page, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers)] += 1
    assert got == want


def test_warc_payload_and_faults(spark, pages):
    scratch = Scratch(spark, "t-warc")
    warc.write_warc(pages.filter("page_id = 3"), scratch.path("a"), scratch, segment_bytes=500)
    assert warc.read_warc(spark, scratch.path("a"), scratch, keep_payload=True).first().payload == pages.filter("page_id = 3").first().html.encode()
    assert warc.warc_round_trip(pages.limit(0), Scratch(spark, "t-warc")).count() == 0
    for bad in ([(1, None, b"a"), (3, 2, b"b")], [(1, None, b"a"), (2, 9, b"b")], [(1, None, b"a")]):
        with pytest.raises(ValueError):
            warc.assemble(bad)
    assert warc.assemble([(2, 2, b"b"), (1, None, b"a")]) == b"ab"
    with pytest.raises(ValueError):
        warc.unchunk_body(b"5\r\nabc\r\n0\r\n\r\n")


# tokens


def test_tokenizers_equal_the_libraries(texts):
    odd = ["", "a\n", "\nb", "a \nb", "x\n \ny", "a  b", " a", "a ", "▁q", "a\n\nb", "<s> x", "<|endoftext|> z", "é\x01", "<0x0A>", "日本 語\n漢", "don't I'll", "½ ² ª", "tab\there", "ſt œ", " x", "x­"] + [t for t in texts if t]
    pieces = load(public_path("piece_bpe_32k.model"))
    assert pieces.decomposes
    assert pieces.count(odd) == pieces.count_whole(odd)
    ids = load(public_path("byte_bpe_50k.json"))
    assert ids.byte_level
    assert ids.encode(odd) == [ids._whole(t) for t in odd]


def test_byte_level_encodes_each_pre_token_once_a_call():
    ids = ByteBpeModel(public_path("byte_bpe_50k.json"))
    library, asked = ids.tokenize, []
    ids.tokenize = lambda part: asked.append(part) or library(part)
    texts = ["beta beta, beta. Ärger's 'beta' beta|beta (beta)\nbeta_ x1 beta...", "", "beta\n", "a  beta", "été, | | 12, beta"]
    assert ids.encode(texts) == [ids._whole(t) for t in texts]
    assert asked.count("Ġbeta") == 1 and asked.count(",") == 1
    assert ids.count(texts) == [len(ids._whole(t)) // 4 for t in texts]
    for some in ([], [""], ["a  b"], ["_"], ["", "", "\n"]):
        assert ids.encode(some) == [ids._whole(t) for t in some]
        assert ids.count(some) == [len(ids._whole(t)) // 4 for t in some]


def test_token_counts_use_the_cache(spark, docs, texts, none):
    scratch = Scratch(spark, "t-counts")
    cache = scratch.path("cache")
    model = load(public_path("piece_bpe_32k.model"))
    first = by_id(token_counts.count_tokens(docs.limit(10), cache, limit=50))
    assert len(first) == 10
    got = by_id(token_counts.count_tokens(docs, cache, limit=50))
    for k, t in enumerate(texts):
        n = model.count_whole([t or ""])[0]
        assert (got[k * 7].n_bytes, got[k * 7].n_tokens, got[k * 7].over_limit) == (len((t or "").encode()), n, n > 50)
    stored = spark.read.parquet(f"{cache}/batch=*")
    assert stored.count() == stored.select("digest").distinct().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert token_counts.count_tokens(none, Scratch(spark, "t-counts").path("cache")).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n in (1, 2, 300, 1000):
        for top in (0, 3, 10_000, 1 << 40):
            values = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
            data = token_files.EliasFano.encode(values).to_bytes()
            back = token_files.EliasFano.from_bytes(data)
            assert back.all().tolist() == values.tolist()
            for i in rng.integers(0, n, 20).tolist() + [0, n - 1]:
                assert back.select(int(i)) == int(values[i])
            assert len(data) <= 40 + n * (3 + max(0, math.log2((top + 1) / n))) / 8 + 4 * (n // 256 + 1)
    with pytest.raises(IndexError):
        back.select(n)


def test_token_files(spark, docs, texts, none):
    scratch = Scratch(spark, "t-files")
    token_files.write_token_files(docs, scratch.path("f"), file_text_bytes=9000, block_ids=500, file_blocks=2, most_ranges=3)
    rows = token_files.read_token_files(spark, scratch.path("f"), scratch).collect()
    model = load(public_path("byte_bpe_50k.json"))
    order = sorted([(k * 7, t or "") for k, t in enumerate(texts)])
    start, want = 0, {}
    head = model.encode(["no id at all."])[0] + b"\0\0\0\0"
    want[None] = (0, len(head) // 4, zlib.crc32(head))
    start = len(head) // 4
    for doc, t in order:
        ids = model.encode([t])[0] + b"\0\0\0\0"
        want[doc] = (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == want
    contents = [bytes(r.content) for r in spark.read.format("binaryFile").load(scratch.path("f")).filter("length > 0").collect()]
    for doc, t in order[:: 5]:
        found = [x.astype("<u4").tobytes() for c in contents for x in token_files.read_document(c, doc)]
        assert found == [model.encode([t])[0] + b"\0\0\0\0"]
    same = spark.createDataFrame([(3, "one text")] * 500 + [(4, None)] * 40, "doc_id long, text string").repartition(4)
    again = Scratch(spark, "t-files")
    token_files.write_token_files(same, again.path("f"), file_text_bytes=500)
    rows = token_files.read_token_files(spark, again.path("f"), again).orderBy("start").collect()
    n = len(model.encode(["one text"])[0]) // 4 + 1
    assert [(r.doc_id, r.start) for r in rows] == [(3, k * n) for k in range(500)] + [(4, 500 * n + k) for k in range(40)]
    spread = spark.read.format("binaryFile").load(again.path("f")).filter("length > 0").count()
    assert spread > 2
    empty = Scratch(spark, "t-files")
    token_files.write_token_files(none, empty.path("f"))
    assert token_files.read_token_files(spark, empty.path("f"), empty).count() == 0


# repeats


def brute_repeats(bodies, size):
    seen = collections.Counter(b[i : i + size] for b in bodies for i in range(len(b) - size + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_induced_sorting_against_brute_force():
    rng = np.random.default_rng(3)
    before = suffix_sort.BATCH
    try:
        for _ in range(120):
            n, k, depth = int(rng.integers(2, 250)), int(rng.integers(1, 5)), int(rng.integers(1, 40))
            text = rng.integers(1, k + 1, n)
            for _ in range(int(rng.integers(0, 5))):
                a = int(rng.integers(0, n))
                text = np.concatenate([text, [1], text[a : a + int(rng.integers(1, 60))]])
            text = np.append(text, 0).astype(np.uint16)
            suffix_sort.BATCH = int(rng.choice([3, 50, 1 << 16]))
            got = suffix_sort.repeated_starts(text, depth, int(rng.choice([64, 1 << 20])))
            own = [tuple(text[i : i + depth]) for i in range(len(text) - depth + 1)]
            seen = collections.Counter(own)
            assert got.tolist() == [seen[x] > 1 for x in own] + [False] * (len(text) - len(own))
    finally:
        suffix_sort.BATCH = before


def brute_passages(texts, size):
    """Words of each text in passages of ``size`` words that also start elsewhere, and what is left without them."""
    words = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    seen = collections.Counter(tuple(x[2] for x in w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for t, w in zip(texts, words, strict=True):
        gone = {k for i in range(len(w) - size + 1) if seen[tuple(x[2] for x in w[i : i + size])] > 1 for k in range(i, i + size)}
        left, at = b"", 0
        for k in sorted(gone):
            if k - 1 not in gone:
                left, at = left + t[at : w[k][0]], w[k][0]
            if k + 1 not in gone:
                at = w[k][1]
        out.append((len(gone), left + t[at:]))
    return out


@pytest.mark.parametrize("split", [0, 1, 250])
def test_repeated_spans(spark, docs, texts, split):
    got = by_id(repeats.repeated_spans(docs, Scratch(spark, "t-repeats"), passages=repeats.Words(), split_segments=split, shard_bytes=4000, batch_bytes=900, keep_text=True))
    bodies = [(t or "").encode() for t in texts] + [b"no id at all."]
    passages = brute_passages(bodies, 50)
    for k, (t, want) in enumerate(zip(bodies, brute_repeats(bodies, 400), strict=True)):
        r = got[k * 7 if k < len(texts) else None]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) == (len(t), *want, passages[k][0]), k
        if r.n_removed:
            r.kept.decode()


@pytest.mark.parametrize("split", [0, 250])
def test_repeated_passages(spark, texts, split):
    """Windows of words, whatever the white space between them; spans are cut from the text as it is."""
    rng = random.Random(3)
    shared = [prose(rng, n).split() for n in (20, 60, 51)]
    spread = lambda ws: "".join(w + rng.choice([" ", "\n", "\t ", "  "]) for w in ws)
    bodies = [(t or "") for t in texts] + [prose(rng, rng.randrange(30)) + " " + spread(rng.choice(shared)) + prose(rng, rng.randrange(30)) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    got = by_id(repeats.repeated_spans(rows, Scratch(spark, "t-passages"), unit=repeats.Words(20, 4), keep_text=True, split_segments=split, batch_bytes=900))
    for k, (t, (words, left)) in enumerate(zip(bodies, brute_passages([b.encode() for b in bodies], 20), strict=True)):
        assert got[k].n_removed == len(t.encode()) - len(left) and (not words or bytes(got[k].kept) == left), k
        assert got[k].kept_sha256 == hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize("unit", [repeats.Bytes(), repeats.Words(40, 6)])
def test_repeated_spans_in_pieces(spark, none, monkeypatch, unit):
    """Segments, and pieces of them at every width, cover each window once and hold its core."""
    rng = random.Random(8)
    body = prose(rng, 800)
    bodies = [body.encode(), (prose(rng, 30) + body[500:3300] + prose(rng, 30)).encode(), ("ab" * 1500).encode(), ("x y " * 90).encode(), b"short"]
    views = [unit.view(b) for b in bodies]
    window = lambda k, i: views[k][0][views[k][1][i] : unit.past(views[k][1], i)]
    count = [max(0, len(places) - unit.size) for _, places in views]
    seen = collections.Counter(window(k, i) for k in range(len(bodies)) for i in range(count[k]))
    for piece in (1 << 20, 700):
        monkeypatch.setattr(repeats, "PIECE", piece)
        cuts = [(*c[:5], joined[c[5] : c[6]]) for columns, joined in repeats.anchored(bodies, unit) for c in columns.T.tolist()]
        assert sorted((k, i) for k, _, a, n, _, _ in cuts for i in range(a, a + n)) == [(k, i) for k in range(len(bodies)) for i in range(count[k])]
        groups, marks = collections.defaultdict(list), collections.defaultdict(list)
        for j, c in enumerate(cuts):
            groups[c[1]].append((c[1], j, c[4], c[5]))
        for rows in (
            [(c[1], j, 0, c[5]) for j, c in enumerate(cuts)],
            [r for g in groups.values() for r in repeats.trimmed(g, unit)],
        ):
            marks.clear()
            for _, seg, first, past in repeats.repeated_ranges(rows, unit):
                marks[seg].append((first, past))
            for j, (k, _, a, n, _, _) in enumerate(cuts):
                assert {x for p, q in marks[j] for x in range(p, q)} == {x for x in range(n) if seen[window(k, a + x)] > 1}
        for k, _, a, n, spot, part in cuts:
            for width in unit.widths:
                parts = list(repeats.pieces(part, spot, width, unit))
                assert sorted(x for first, m, *_ in parts for x in range(first, first + m)) == list(range(n))
                assert all(core in window(k, a + x) for first, m, _, core, _ in parts for x in range(first, first + m))
    assert repeats.repeated_spans(none, Scratch(spark, "t-repeats"), unit=unit).count() == 0


def test_joins_with_the_texts_do_not_shuffle_them(spark, texts, monkeypatch):
    plans, joined = [], repeats._Bucketed.with_lists

    def watched(*args):
        out = joined(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(repeats._Bucketed, "with_lists", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with session_conf(spark, spark__sql__shuffle__partitions=20, spark__sql__autoBroadcastJoinThreshold=-1):
        repeats.repeated_spans(docs, Scratch(spark, "t-shuffles"), repeats.Bytes(32, 16, (8, 1)), repeats.Words(12, 4, (4, 1)))
    assert len(plans) >= 3
    for plan in plans:
        lines = [(len(re.match(r"[ :+-]*", line).group()), line) for line in plan.splitlines()]
        at = next(k for k, (_, line) in enumerate(lines) if "tessella_texts" in line)
        depth, above = lines[at][0], []
        for indent, line in reversed(lines[:at]):
            if indent < depth:
                depth, above = indent, [*above, line]
        below_join = list(itertools.takewhile(lambda line: "Join" not in line, above))
        assert len(below_join) < len(above) and not any("Exchange" in line for line in below_join)


@pytest.mark.parametrize("kinds", [3, 90, 4000, 20_000])
def test_words_are_sorted_as_numbers(kinds):
    rng, unit = np.random.default_rng(kinds), repeats.Words(6, 3, (3, 1))
    runs = [[f"w{x}" for x in rng.integers(0, kinds, n)] for n in (6, 40, 9000, 300)]
    runs += [runs[2][50:90], runs[1][:7] + runs[2][-8:], [*runs[3][:5], "é", *runs[3][6:]]]
    segments = [(0, k, 0, f" {' '.join(words)} ".encode()) for k, words in enumerate(runs)]
    symbols, width, tokens = unit.symbols([s[3] for s in segments])
    assert tokens.tolist() == [len(words) for words in runs] and len(symbols) == (sum(tokens) + len(runs)) * width + 1
    assert len(symbols) < sum(len(s[3]) for s in segments) and symbols.max() < 256
    windows = [[tuple(words[a : a + 6]) for a in range(len(words) - 5)] for words in runs]
    seen = collections.Counter(w for own in windows for w in own)
    marked = {(k, a) for k, own in enumerate(windows) for a, w in enumerate(own) if seen[w] > 1}
    assert {(k, a) for _, k, first, past in repeats.repeated_ranges(segments, unit) for a in range(first, past)} == marked


def test_a_passage_in_many_texts(spark):
    """A hot anchor's segments are cut until no key holds more than ``split_segments`` of them."""
    rng = random.Random(12)
    passage = prose(rng, 75)
    bodies = [f"{prose(rng, 60)} {passage[: rng.choice([300, 390, 420, 500, len(passage)])]} {prose(rng, 60)}".encode() for _ in range(120)]
    rows = spark.createDataFrame([(k, b.decode()) for k, b in enumerate(bodies)], "doc_id long, text string")
    got = by_id(repeats.repeated_spans(rows, Scratch(spark, "t-hot"), passages=repeats.Words(), split_segments=10))
    words = brute_passages(bodies, 50)
    for k, want in enumerate(brute_repeats(bodies, 400)):
        assert (got[k].n_removed, got[k].n_spans, got[k].kept_sha256, got[k].n_passage_words) == (*want, words[k][0])


# near duplicates


def _components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return [root(x) for x in range(n)]


def test_simhash_components(spark, docs, texts, none):
    import xxhash

    def slow(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [slow(t) for t in texts]
    near = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = _components(len(prints), near)
    got = by_id(simhash.near_duplicates(docs, Scratch(spark, "t-simhash")))
    assert {k * 7: (f"{p:016x}", roots[k] * 7) for k, p in enumerate(prints)} == {d: (r.fingerprint, r.component_id) for d, r in got.items() if d is not None}
    assert got[None].component_id is None
    assert simhash.near_duplicates(none, Scratch(spark, "t-simhash")).count() == 0


@pytest.mark.parametrize(("total", "block"), [(None, 4096), (None, 60), (10**9, 60)])
def test_links_in_large_buckets(spark, monkeypatch, total, block):
    rng = random.Random(4)
    prints = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = np.array(sorted(prints), dtype=np.uint64)
    if total:
        plan = simhash.plan_partitions
        monkeypatch.setattr(simhash, "plan_partitions", lambda sample, distance, _: plan(sample, distance, total))
    df = spark.createDataFrame([(k, int(p)) for k, p in enumerate(prints.view(np.int64))], "node long, p0 long")
    links = [(r.u, r.v) for r in simhash.near_links(df, Scratch(spark, "t-links"), block_rows=block).collect()]
    near = [(i, int(j)) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[:i]) <= 3)]
    assert set(map(tuple, map(sorted, links))) <= {(j, i) for i, j in near}
    assert _components(len(prints), links) == _components(len(prints), near)


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 6])
def test_plans_obey_the_pigeonhole(distance):
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    for total in (10, 10**6, 10**10):
        plan = simhash.plan_partitions(sample, distance, total, most_probes=10**6)
        bits = [b for p in plan for b in p.bits]
        assert len(bits) == len(set(bits))
        for _ in range(300):
            flipped = set(rng.choice(64, size=int(rng.integers(0, distance + 1)), replace=False).tolist())
            assert any(len(flipped & set(p.bits)) <= p.threshold for p in plan)


def test_components(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(60)] + [(200, 200 + k) for k in range(1, 50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(500, 500)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t-cc")).collect()}
    roots = _components(600, links)
    assert got == {x: roots[x] for pair in links if pair[0] != pair[1] for x in pair}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t-cc")).count() == 0


# decontamination


def test_decontamination(spark, docs, texts, none):
    rng = random.Random(9)
    item = texts[7]
    words = item.split()
    near = " ".join(words[:30] + ["changed"] + words[31:])
    items = [(1, item), (2, None), (3, ""), (4, "x y z"), (5, near), (6, prose(rng, 20)), (7, item), (None, "A"), (8, " ".join(words[:12]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))

    def grams(text):
        w = decontaminate._words(text or "")
        return {" ".join(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)} if w else set(), min(5, len(w))

    want = set()
    for k, t in list(enumerate(texts)) + [(None, "no id at all.")]:
        w = decontaminate._words(t or "")
        for i, text in items:
            own, width = grams(text)
            have = {" ".join(w[j : j + width]) for j in range(len(w) - width + 1)} if width else set()
            if own and len(own & have) >= Fraction("0.8") * len(own):
                want.add((None if k is None else k * 7, i))
    for block in (8 << 20, 300):
        found = decontaminate.find_contaminated(docs, bench, block_bytes=block, index_bytes=block >> 1, parts=3)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert (7 * 7, 1) in want and (7 * 7, 5) in want
    assert decontaminate.find_contaminated(none, bench).count() == 0
    assert decontaminate.find_contaminated(docs, bench.limit(0)).count() == 0


# packing


def test_optimal_buckets_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 30, 8))
        counts, k = rng.integers(1, 9, len(lengths)), int(rng.integers(1, 5))
        pad = lambda b: sum(int(n) * (min(x for x in b if x >= v) - int(v)) for v, n in zip(lengths, counts, strict=True))  # noqa: B023, E731
        best = min(pad([*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], m))
        assert pad(packing.optimal_buckets(lengths, counts, k)) == best


def test_packing(spark, docs, texts, none):
    rows = packing.pack(docs, Scratch(spark, "t-pack"), max_len=64, n_buckets=4, token_budget=256).collect()
    model = load(public_path("byte_bpe_50k.json"))
    want = {k * 7: model.count([t or ""])[0] + 1 for k, t in enumerate(texts)}
    got = collections.Counter()
    for r in rows:
        assert 1 <= r.n_tokens <= min(64, r.bucket_len)
        got[r.doc_id] += r.n_tokens
    assert {k: v for k, v in got.items() if k is not None} == want
    batches = collections.defaultdict(list)
    for r in rows:
        batches[(r.bucket, r.batch)].append(r.slot)
    for (bucket, _), slots in batches.items():
        size = max(1, 256 // next(r.bucket_len for r in rows if r.bucket == bucket))
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= size
    full = collections.Counter(bucket for bucket, _ in batches)
    for bucket, n in full.items():
        size = max(1, 256 // next(r.bucket_len for r in rows if r.bucket == bucket))
        assert n == -(-sum(r.bucket == bucket for r in rows) // size)
    order = sorted((r.bucket, r.batch, r.slot, r.n_tokens) for r in rows)
    assert all(a[0] < b[0] or a[3] <= b[3] for a, b in itertools.pairwise(order))
    assert packing.pack(none, Scratch(spark, "t-pack")).count() == 0


# classifiers


def test_codewords():
    for k in (1, 2, 3, 4, 6, 9, 20):
        code = language.codewords(k)
        assert code.shape[0] == k and set(np.unique(code)) <= {-1, 1}
        assert len({tuple(r) for r in code}) == k
        if k in (4, 5):
            apart = min((a != b).sum() for a, b in itertools.combinations(code, 2))
            assert apart == 1 << (k - 2)


def test_decoding_against_plain_loops():
    """Loss-weighted decoding, language by language and bit by bit; many languages; bits fitted in blocks."""
    rng = np.random.default_rng(2)
    for k in (2, 4, 9, 90):
        code = language.codewords(k)
        model = language.LanguageModel([f"l{j:02}" for j in range(k)], code, None, None, rng.uniform(0.05, 1, code.shape[1]), 0.2)
        for _ in range(20):
            margins = rng.normal(size=code.shape[1]) * 3
            losses = [sum(model.trust[b] * math.log1p(math.exp(-code[j, b] * margins[b])) for b in range(code.shape[1])) for j in range(k)]
            odds = sorted(math.exp(min(losses) - x) for x in losses)
            name, score, ambiguous = language.decode(margins, model)
            assert name == model.languages[losses.index(min(losses))] and score == pytest.approx(odds[-1] / sum(odds))
            assert ambiguous == ((odds[-1] - odds[-2]) / sum(odds) < 0.2)
    examples = [(np.sort(rng.choice(64, 9, replace=False)), rng.uniform(0, 1, 9).astype(np.float32)) for _ in range(300)]
    y = rng.choice([-1.0, 1.0], size=(300, 3)).astype(np.float32)
    whole = language.fit_bits(examples, y, 64, 5.0)
    before, language.DENSE_ROWS = language.DENSE_ROWS, 17
    try:
        parts = language.fit_bits(examples, y, 64, 5.0)
    finally:
        language.DENSE_ROWS = before
    assert all(np.allclose(a, b, atol=0.05) for a, b in zip(whole, parts, strict=True))


def test_repeated_ids_stay_within_the_samples(spark):
    """Many languages and rows that share an id: every language is learned, one row of each id is."""
    rows = [(k % 40, f"{chr(97 + k % 20) * 4} {chr(98 + k % 20) * 3} " * 8 + str(k // 40), f"l{k % 20:02}") for k in range(800)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs, Scratch(spark, "t-many")).collect()
    truth = {f"{t}": lang for _, t, lang in rows}
    assert len(got) == 1600 and {r.lang_pred for r in got} == set(truth.values())
    model = toxicity.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(40)] * 3, "doc_id long, toxic int"), dims=1 << 12)
    assert model.dims == 1 << 12 and math.isfinite(model.bias)
    long = spark.createDataFrame([(1, "the whale with thorn " * 60000), (2, "kala talo " * 60000), (2, "kala"), (2, "kala")], "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") == 1, "bb").otherwise("aa"))
    assert language.identify(long, Scratch(spark, "t-long")).count() == 4
    assert toxicity.toxicity(long, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), Scratch(spark, "t-long")).count() == 4


def test_ftrl_against_scalar_loops():
    rng = random.Random(4)
    fast, alpha, beta, l1, l2 = toxicity.FtrlProximal(50, 0.5, 1.0, 0.3, 0.1), 0.5, 1.0, 0.3, 0.1
    z, n = [0.0] * 51, [0.0] * 51

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(300):
        places, label = sorted(rng.sample(range(50), rng.randrange(1, 12))), rng.randrange(2)
        fast.learn(np.array(places, dtype=np.int32), label)
        own = [*places, 50]
        before = {i: weight(i) for i in own}
        g = 1 / (1 + math.exp(-sum(before.values()))) - label
        for i in own:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * before[i]
            n[i] += g * g
    assert np.allclose(fast.weights(np.arange(51)), [weight(i) for i in range(51)])


def test_language(spark, none):
    rng = random.Random(1)
    words = {"aa": ["kala", "talo", "yksi", "kaksi"], "bb": ["the", "with", "thorn", "whale"], "cc": ["żółw", "łąka", "świt", "jest"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 60))), lang) for k, lang in enumerate(sorted(words) * 120)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !!", "bb"), (903, "the whale", None), (None, "the with", "bb")]
    got = by_id(language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)), Scratch(spark, "t-lang")))
    held = [(d, lang) for d, t, lang in rows if d is not None and d < 900 and zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(got[d].lang_pred == lang for d, lang in held) >= 0.97 * len(held)
    assert all(got[d].held_out for d, _ in held)
    assert [got[d].lang_pred for d in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].held_out is False
    untrained = language.identify(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string"), Scratch(spark, "t-lang"))
    assert untrained.first().lang_pred == "und"
    assert language.identify(none, Scratch(spark, "t-lang")).count() == 0


def test_toxicity(spark, none):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        body = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randrange(5, 40))]
        if bad:
            body.insert(rng.randrange(len(body)), rng.choice(["nasty", "awful"]))
        rows.append((k, " ".join(body)))
        labels.append((k, 1, int(bad)))
    rows += [(900, None), (901, ""), (None, "nasty")]
    labels += [(None, 1, 1), (5, None, None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity(docs, marks, Scratch(spark, "t-tox")))
    held = [(d, y) for d, _, y in labels[:600] if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(got[d].predicted == y for d, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[900].score == got[901].score and got[900].predicted == 0
    assert toxicity.toxicity(docs, marks.limit(0), Scratch(spark, "t-tox")).filter("predicted = 1").count() == 0
    assert toxicity.toxicity(none, marks, Scratch(spark, "t-tox")).count() == 0
    assert json.dumps(toxicity.FtrlProximal(8).weights(np.arange(9)).tolist()) == json.dumps([0.0] * 9)
