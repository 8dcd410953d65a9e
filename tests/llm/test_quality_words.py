"""The word model of the quality classifier: junk made of real words."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import quality


@pytest.mark.parametrize("join", [" ", ""])
def test_real_words_in_a_strange_order_are_rejected(spark, tmp_path, join):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in "aeiou"] if join else [chr(0x4E00 + i) for i in range(60)]
    follows = {w: rng.sample(words, 3) for w in words}

    def prose(n):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice(follows[out[-1]]))
        return out

    texts = [join.join(prose(150)) for _ in range(260)]
    for _ in range(20):
        shuffled = prose(150)
        rng.shuffle(shuffled)
        texts.append(join.join(shuffled))
    path = f"file://{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    rows = quality.judged(docs, docs.filter("doc_id < 200").select(F.col("doc_id").alias("id"))).collect()
    kept = {r.id: r.kept for r in rows}
    assert sorted(kept) == list(range(280)) and len(rows) == 280
    assert np.mean([kept[i] for i in range(200, 260)]) >= 0.95
    assert not any(kept[i] for i in range(260, 280))


def _discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    if not all(n):
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) for k in (1, 2, 3)]


def test_perplexity_equals_brute_force_kneser_ney(spark, tmp_path):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "bdfgk" for b in "aeiou"]
    texts = [" ".join(rng.choices(words, weights=range(1, 26), k=rng.randrange(1, 40))) for _ in range(200)]
    judged = [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(20)]
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts + judged)], "doc_id long, text string, lang string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path).withColumn("row", F.monotonically_increasing_id())
    got = {r.id: r.entropy for r in quality.perplexities(docs, docs.filter(f"doc_id < {len(texts)}")).collect()}
    # words seen twice have ids, others share one; every text begins with a start
    seen = {}
    for t in texts:
        for w in t.split():
            seen[w] = seen.get(w, 0) + 1
    known = {w for w, n in seen.items() if n > 1}
    assert all(w in known for t in texts + judged for w in t.split())
    pairs = {}
    for t in texts:
        for v, w in zip(["<s>", *t.split()], t.split()):
            pairs[v, w] = pairs.get((v, w), 0) + 1
    d, before = _discounts(pairs.values()), {}
    for _, w in pairs:
        before[w] = before.get(w, 0) + 1
    e = _discounts(before.values())
    cut = {w: e[min(n, 3) - 1] for w, n in before.items()}
    lower = lambda w: (before.get(w, 0) - cut.get(w, 0) + sum(cut.values()) / (quality.WORDS + 1)) / sum(before.values())

    def p(v, w):
        of = [c for (x, _), c in pairs.items() if x == v]
        if not of:
            return lower(w)
        c = pairs.get((v, w), 0)
        return (c - (d[min(c, 3) - 1] if c else 0)) / sum(of) + sum(d[min(x, 3) - 1] for x in of) / sum(of) * lower(w)

    for i, t in enumerate(texts + judged):
        want = -np.mean([np.log(p(v, w)) for v, w in zip(["<s>", *t.split()], t.split())])
        assert got[i] == pytest.approx(want, abs=1e-5)


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b"]), round(rng.uniform(-2, 9), 4)) for _ in range(501)]
    df = spark.createDataFrame([*rows, ("a", None)], "lang string, entropy double").repartition(7)
    got = {r.lang: (r.known, r.entropy) for r in quality.quantiles(df, {"entropy": F.col("entropy")}, 0.995).collect()}
    for lang in ("a", "b", None):
        values = sorted(v for x, v in rows if lang in (x, None))
        assert got[lang][0] == len(values)
        assert 0 <= got[lang][1] - values[int(np.ceil(len(values) * 0.995)) - 1] + 1e-9 <= 1.01e-4


def test_quality_of_odd_rows(spark, tmp_path):
    texts = [None, "", " \t\n", "a", "word " * 30_000, "x" * 200_000, "東京 は", "same text", "same text"]
    path = f"file://{tmp_path}/d"
    rows = [(i if i != 3 else None, t, None if i == 4 else "en", i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, row int").withColumn("entropy", F.lit("clash")).withColumn("_row", F.lit(1)).repartition(2).write.parquet(path)
    docs = spark.read.parquet(path)
    trusted = docs.filter("row in (4, 6, 7)").select(F.col("doc_id").alias("id"))
    found = quality.judged(docs, trusted).collect()
    assert len(found) == len(texts)
    assert all(r.kept and r.perplexity is None for r in found if r.n in (0, 3) and r.id in (0, 1, 2))
    kept = quality.passing(docs, trusted)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)
    assert quality.judged(docs.limit(0), trusted).count() == 0
    assert quality.passing(docs.limit(0), trusted.limit(0)).count() == 0
