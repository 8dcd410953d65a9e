"""The limit of the quality classifier is the quantile itself."""

from pyspark.sql import functions as F

from arbora.llm import quality


def test_limit_is_the_quantile_of_the_trusted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("doc_id", "id")
    fit = labels.filter("id % 3 <> 0").filter("quality = 1").select("id")
    rows = quality.judged(docs, fit).join(labels, "id").select("id", "lang", "quality", "surprise", "surprise_limit", "kept").toPandas()
    held = rows[rows.id % 3 == 0]
    good, poor = (held[held.quality == q].kept.mean() for q in (1, 0))
    print("kept of held-out good, poor:", good, poor, len(held[held.quality == 1]), len(held[held.quality == 0]))
    assert quality.SLACK == 1.0
    assert good >= 0.95 and poor <= 0.2
    known = rows[(rows.id % 3 != 0) & (rows.quality == 1)]
    assert known.surprise.max() >= known.surprise_limit.max()


def test_quantiles_are_exact_on_the_grid(spark):
    import math
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", ""]), rng.gauss(0, 0.02) if i % 7 else None, rng.choice([-1.0, 0.25])) for i in range(400)]
    df = spark.createDataFrame(rows, "lang string, x double, y double").repartition(7)
    for q in (0.5, 0.995, 1.0):
        got = {r.lang: (r.x, r.y, r.known) for r in quality.quantiles(df, {"x": F.col("x"), "y": F.col("y")}, q).collect()}
        assert set(got) == {"a", "b", "", None}
        for lang, found in got.items():
            for k in (1, 2):
                v = sorted(math.ceil(r[k] * quality.GRID) for r in rows if r[0] == (lang if lang is not None else r[0]) and r[k] is not None)
                assert found[k - 1] == next(x for i, x in enumerate(v) if i + 1 >= len(v) * q) / quality.GRID
            assert found[2] == sum(r[0] == lang or lang is None for r in rows)
    assert quality.quantiles(df.limit(0), {"x": F.col("x")}, 0.5).count() == 0
