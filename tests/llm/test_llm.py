"""The operators of arbora.llm against brute force, hand-made cases and held-out accuracy."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import common, decontaminate, exact_dedup, html_extract, licences, ngram_join, quality, suffix_dedup, token_counts, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Writes rows of documents as a Parquet table, since row ids need a table that reads the same twice."""

    def put(texts, ids=None):
        path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
        rows = [(i, t, "en", "src0", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return put


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " \t\n", "a", "A b", "x" * 5000, "é ü ß", "same text here", "same text here", "Same\tText here"]


def test_exact_dedup(spark, store):
    texts = [*ODD, "a b", "ab", " ab ", "a  b  "]
    docs = store(texts).withColumn("h", F.lit("clash")).withColumn("row", F.lit("clash")).withColumn("norm", F.lit(1))
    got = {r.id: r for r in exact_dedup.exact_groups(docs).collect()}
    norm = ["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r") for t in texts]
    for i, x in enumerate(norm):
        group = [j for j, y in enumerate(norm) if x == y]
        keep = min(group, key=lambda j: (-len(texts[j] or ""), j))
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(group), i == keep)
        assert got[i].text_sha256 == hashlib.sha256(x.encode()).hexdigest()
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(norm))


def test_exact_dedup_of_repeated_rows_and_empty_tables(spark, store):
    docs = store(["t u", "t u", "t u"], ids=[7, 7, 7])
    assert sorted(r.kept for r in exact_dedup.exact_groups(docs).collect()) == [False, False, True]
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_exact_dedup_survives_hash_collisions(spark, store, monkeypatch):
    md5 = F.md5
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: md5(F.substring(c, 1, 1)))
    try:
        texts = ["ab", "ac", "a b", "b", "a c"]
        got = {r.id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(store(texts)).collect()}
    finally:
        monkeypatch.undo()
    assert got == {0: (2, 2), 2: (2, 2), 1: (4, 2), 4: (4, 2), 3: (3, 1)}


def near_copies(rng):
    texts = list(ODD)
    for n in (3, 4, 5, 9, 20, 60, 150, 400):
        for _ in range(3):
            base = words(rng, n).split()
            texts.append(" ".join(base))
            for _ in range(6):
                w = list(base)
                for _ in range(rng.randrange(0, max(2, n // 25) + 1)):
                    w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
                if rng.random() < 0.4:
                    w = w[: max(1, len(w) - rng.randrange(0, 1 + n // 6))]
                texts.append(" ".join(w))
    passage = words(rng, 30)
    texts += [passage + " " + words(rng, rng.randrange(1, 14)) for _ in range(25)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "width", "num"), [(1, 4, 85), (2, 5, 80)])
def test_jaccard_join_is_exact(spark, store, seed, width, num):
    texts = near_copies(random.Random(seed))
    docs = store(texts).withColumn("key", F.lit("clash")).withColumn("set_id", F.lit("clash"))
    got = sorted((r.id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, width=width, num=num).collect())
    want = sorted(ngram_join.brute_force(list(enumerate(texts)), width, num))
    assert got == want
    kept = {r.doc_id for r in ngram_join.one_of_each(docs, width=width, num=num).collect()}
    assert kept == {i for i, n, c in want if i == c or not n}


def test_jaccard_join_tells_structured_words_apart(spark, store):
    # words that polynomial hashes modulo 2**64 cannot tell apart
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = "".join("ba"[bin(i).count("1") % 2] for i in range(4096))
    texts = [one, other, one, f"{one} {other}", f"{other} {one}", f"x {one} y z", f"x {other} y z"]
    got = sorted((r.id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(store(texts)).collect())
    assert got == sorted(ngram_join.brute_force(list(enumerate(texts))))


def test_jaccard_join_survives_clashing_ids(spark, store, monkeypatch):
    monkeypatch.setattr(ngram_join, "_set_id", lambda h: int(h[0] & np.uint64(1)))
    texts = near_copies(random.Random(9))[:60]
    got = sorted((r.id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(store(texts)).collect())
    assert got == sorted(ngram_join.brute_force(list(enumerate(texts))))


def test_row_numbers_hold_for_unsteady_input(spark, store):
    docs = store(["a b c d e", "x", "a b c d e", None]).repartition(3, F.rand())
    assert {r.id: r.keep_id for r in exact_dedup.exact_groups(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 3}
    assert {r.doc_id for r in ngram_join.one_of_each(docs).collect()} == {0, 1, 3}
    assert common.settled(store(["a"])).count() == 1


def test_jaccard_join_of_an_empty_table(spark, store):
    assert ngram_join.jaccard_components(store(["a"]).limit(0)).count() == 0


def test_published_segments_meet():
    rng = np.random.default_rng(3)
    for num in (80, 85, 95):
        t = ngram_join.Threshold(num)
        for _ in range(300):
            n = int(rng.integers(1, 300))
            a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 1 << 64, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
            if not len(b):
                continue
            both = len(np.intersect1d(a, b))
            if 100 * both >= num * (len(a) + len(b) - both):
                assert np.intersect1d(ngram_join._published(a, t), ngram_join._published(b, t)).size


def repeated(rng):
    shared = ["".join(rng.choice("abcdefé ") for _ in range(n)) for n in (120, 150, 260, 420, 90)]
    texts = [None, "", "short", "ab" * 400, "q" * 700, shared[3], shared[3]]
    for _ in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else words(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 6))]
        texts.append("".join(parts))
    return texts + texts[10:14]


@pytest.mark.parametrize("length", [400, 101, 60])
def test_suffix_dedup(spark, store, length):
    rng = random.Random(length)
    shared = words(rng, length)[: 9 * length // 10]  # shorter than what is cut out
    texts = [*repeated(rng), *[f"{words(rng, 20)} {shared} {words(rng, 20)}" for _ in range(5)]]
    docs = store(texts).withColumn("row", F.lit("clash")).withColumn("runs", F.lit("clash"))
    want = sorted(suffix_dedup.brute_force(list(enumerate(texts)), length, words=6))
    assert any(x[5] and not x[2] for x in want)
    for hot in (suffix_dedup.HOT, 3):
        rows = suffix_dedup.cut(docs, length=length, hot=hot, words=6).collect()
        got = sorted((r.id, r.n_bytes, sum(s.b - s.a for s in r.runs or []), len(r.runs or []), hashlib.sha256(r.kept).hexdigest(), len(r.passages)) for r in rows)
        assert got == want
    assert suffix_dedup.cut(docs.limit(0), length=length).count() == 0


def test_decontamination(spark, store):
    rng = random.Random(5)
    bench = [(1, words(rng, 30)), (2, "One, two THREE."), (3, None), (4, "..."), (10, words(rng, 10)), (11, "alone")]
    bench.append((12, bench[0][1]))
    texts = [*ODD, words(rng, 50) + " " + bench[0][1], bench[0][1] + " " + bench[0][1], "x one two-three y", bench[4][1][:-3], bench[4][1].upper(), "alone", "one two four", " ".join(bench[0][1].split()[5:20])]
    b = spark.createDataFrame(bench, "item_id long, text string")
    docs = store(texts).withColumn("items", F.lit("clash"))
    for block in (200_000, 8):
        found = decontaminate.contamination(docs, b, block_windows=block)
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in found.collect())
        assert got == sorted(decontaminate.brute_force(list(enumerate(texts)), bench))
    clean = decontaminate.contamination(docs, b.limit(0)).collect()
    assert len(clean) == len(texts) and not any(r.contaminated for r in clean)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav>
<div class="cookie-notice">We use cookies, a long notice with very many words so that it looks like text.</div>
<article><h1>A &amp; B</h1><p>One <b>bold</b>er   text,
with white space &#233; and enough words to count as the content of this page, surely.<p>Short.
<div class="ad">buy now</div><form><input><label>mail</label></form><p>Last one, again with a good number of words in it.</article>
<section id="comments"><p>A reader's comment that goes on and on and on, with more words than one would like.</p></section>
<footer>&copy; x</footer><script>var t = "<p>no</p>";</script></body></html>"""


def test_html_extraction(spark):
    want = "A & B One bolder text, with white space é and enough words to count as the content of this page, surely. Short. Last one, again with a good number of words in it."
    assert html_extract.main_text(PAGE) == want
    assert html_extract.main_text(PAGE.replace("article>", "div>")) == want
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<html><body></body>") == ""
    assert html_extract.main_text("<p>unclosed &am") == "unclosed &am"
    pages = spark.createDataFrame([(1, None, None), (1, "u", PAGE), (1, "u", PAGE)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r.text, r.n_chars) for r in html_extract.extracted(pages).collect()) == sorted([("", 0), (want, len(want)), (want, len(want))])


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "with-menu", "page-header-fixed", "form-page", "social-science", "related-work", "sidebar", "content header"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_html_layout_classes_do_not_hide_the_article(name, inner):
    body = "<h1>Title</h1><p>One paragraph with quite a few words in it, as articles have.</p><p>Short.</p><p>And a last one, which has many words too, so that it counts.</p>"
    page = f'<html><body><div class="menu-list">Home News</div><div class="{name}"><{inner}>{body}</{inner}></div><div id="footer">c</div></body></html>'
    want = "Title One paragraph with quite a few words in it, as articles have. Short. And a last one, which has many words too, so that it counts."
    if inner == "div" and name in ("sidebar", "content header"):  # nothing says that this one is the article
        want = ""
    assert html_extract.main_text(page).removeprefix("c").strip() == want


@pytest.mark.parametrize("name", ["cookie-notice", "ad-box", "site-footer", "comments-list", "sidebar", "nav_bar"])
def test_html_named_parts_are_left_out(name):
    text = "Words of the article, which is long enough to be one, and goes on for a while."
    assert html_extract.main_text(f'<body><article><p>{text}</p><div class="x {name}">a b c d e f g h i j k l m n</div><p>{text}</p></article></body>') == f"{text} {text}"


def test_html_of_any_depth_takes_linear_time():
    import time

    began = time.perf_counter()
    text = "some text of the page that is long enough"
    for page in ("<div>" * 50_000 + f"<p>{text}", "<b>" * 50_000 + f"{text}" + "</i>" * 50_000, "<p>" * 50_000 + text, f"<div><p>{text}</p>" * 20_000):
        assert html_extract.main_text(page).startswith(text)
    assert time.perf_counter() - began < 30


def test_html_of_an_empty_table(spark):
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_smoothing_and_threshold():
    assert html_extract.smoothed([3.0] * 9) == pytest.approx([3.0] * 9)
    assert 1 < html_extract.threshold([0, 1, 1, 9, 10]) < 9


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/71?x#y", "https://a.b.example.com/en/8", "http://com/en/", "http://notexample.com/en/7", "http://x.com?/en/", "http://x.com#f", "ftp://h.net/de/9/a://b", "http://example.net/de/8", "http://a.org/es/", "http://a.org/ES/", "http://a.com/en/\n7"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(4, urls[4])], "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(df, rules).collect() if r.rule)
    want = sorted((i, *judge(u)) for i, u in [*enumerate(urls), (4, urls[4])] if judge(u)[2])
    assert got == want
    rest = sorted((r.page_id, r.host, r.path, r.verdict) for r in url_filter.url_verdicts(df, rules).collect() if not r.rule)
    assert rest == sorted((i, *judge(u)[:2], "allow") for i, u in enumerate(urls) if not judge(u)[2])
    assert url_filter.url_verdicts(df, rules.limit(0)).filter("rule is null").count() == len(urls) + 1


def test_licences(spark, store):
    mit = next(x for name, x in licences.TEMPLATES if name == "MIT" and x.startswith("Permission") and "WARRANTY" in x)
    gpl = next(x for name, x in licences.TEMPLATES if name == "GPL-3.0-or-later")
    prose = words(random.Random(4), 300)
    cases = [
        ("x\nLicensed under the Apache License, Version 2.0.\ny", "Apache-2.0", 1.0),
        ("released UNDER the mit license", "MIT", 1.0),
        ("Released under the license.\nLicensed under CC BY-NC 4.0", "CC-BY-NC-4.0", 1.0),
        ("foo bar baz", None, None),
        (f"{prose} {mit} {prose}", "MIT", 1.0),
        (prose + "\n# " + gpl.replace(" ", "\n# ", 12) + "\n" + prose, "GPL-3.0-or-later", 1.0),
        (f"{prose} licensed under the apache license, version 2.0, as {prose}", "Apache-2.0", 1.0),
        (mit.replace("Software", "Program"), "MIT", None),
        ("the software " * 30_000, None, None),
    ]
    texts = [*ODD, *[c[0] for c in cases]]
    docs = store(texts).withColumn("size", F.lit("clash")).withColumn("licence", F.lit("clash")).withColumn("row", F.lit("clash"))
    known = spark.createDataFrame(licences.TEMPLATES, "licence string, notice string")
    got = {r.doc_id: (r.licence, r.dice, r.n_matches) for r in licences.scanned(docs, known).collect()}
    n = len(ODD)
    assert len(got) == len(texts) and all(got[i] == (None, None, 0) for i in range(n))
    for i, (_, licence, dice) in enumerate(cases):
        assert got[n + i][0] == licence and (dice is None or got[n + i][1] == dice), i
    assert licences.scanned(docs, known.limit(0)).filter("licence is null").count() == len(texts)
    assert licences.scanned(docs.limit(0), known).count() == 0
    assert licences.scanned(store(["Released under the MIT License."] * 3, ids=[1, 1, 1]), known).filter("licence = 'MIT'").count() == 3


def test_token_counts(spark, store):
    import re

    vocab = token_counts.Vocabulary(token_counts.VOCABULARY)
    texts = [*ODD, "The quick brown fox's 1234 jumps!!  over\n\nit", "naïve Straße 東京 ✓", "antidisestablishmentarianism", "a" * 300 + " " * 700 + "é" * 400, "same text here"]
    for cache in (500_000, 5):
        docs = store(texts).withColumn("n_tokens", F.lit("clash")).withColumn("id", F.lit("clash"))
        got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.counted(docs, cache=cache).collect()}
        for i, t in enumerate(texts):
            parts = re.findall(token_counts.PATTERN, (t or "").encode())
            assert b"".join(parts) == (t or "").encode()
            assert got[i] == (len(parts), sum(token_counts.brute_force(vocab, p) for p in parts))
    assert token_counts.counted(store(["a"]).limit(0)).count() == 0
    assert [r.n_tokens for r in token_counts.counted(store(["x y", "x y"], ids=[3, 3])).collect()] == [2, 2]


def test_token_counts_of_a_long_pretoken_in_bounded_memory():
    import tracemalloc

    vocab = token_counts.Vocabulary(token_counts.VOCABULARY)
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh") for _ in range(200_000)).encode()
    tracemalloc.start()
    found = token_counts.trie_counts(vocab, [long, long[:3000], b"abc"])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 5_000_000
    assert found[long[:3000]] == token_counts.brute_force(vocab, long[:3000]) and found[b"abc"] == token_counts.brute_force(vocab, b"abc")


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit, held = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    found = quality.judged(docs, quality.trusted_labels(fit)).join(held.withColumnRenamed("doc_id", "id"), "id")
    by = {r.quality: r.kept for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert by[1] >= 0.97 and by[0] <= 0.4


def test_kneser_ney_is_a_distribution(spark, store):
    docs = store([*ODD, "the cat sat on the mat. " * 5, "THE 99 bottles?!"])
    model = quality.kneser_ney(docs)
    assert np.exp(model.astype(float)).reshape(-1, quality.SYMBOLS).sum(axis=1) == pytest.approx(1.0, abs=1e-4)
    assert quality.kneser_ney(docs.limit(0)) is None
    found = quality.judged(docs, docs.select(F.col("doc_id").alias("id")).limit(0)).collect()
    assert len(found) == docs.count() and all(r.kept for r in found)
    assert len(quality.symbols(np.frombuffer("aé東✓ Z".encode(), np.uint8))) == 6


def test_pipeline_keeps_clean_documents(spark, tmp_path_factory):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"file://{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        # the last stage gives rates and drops those of 0; see test_mixing.py
        assert left <= ids and (len(left) >= 0.7 * len(ids) or name == "mixing"), name
        ids = left
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {"rate", "copies"} <= set(docs.columns)
