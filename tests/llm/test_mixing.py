"""Mixing against a dense solver, held-out labels and hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import mixing

SF = "/root/testdata"


def dense(p, w, t, steps=200_000):
    """Totals of the accelerated projected gradient on all rates, without any of the operator's code."""
    d = 1 / np.maximum(t, mixing.LEAST) ** 2
    a = p * w[:, None]
    slope = np.linalg.eigvalsh(np.sqrt(d)[:, None] * (a.T @ p) * np.sqrt(d)).max()
    r, z, k = np.ones(len(w)), np.ones(len(w)), 1.0
    for _ in range(steps):
        new = np.maximum(0, z - p @ (d * (a.T @ z - t)) / slope)
        after = (1 + np.sqrt(1 + 4 * k * k)) / 2
        z, r, k = new + (k - 1) / after * (new - r), new, after
    return a.T @ r


def members(spark, rows):
    return spark.createDataFrame([(int(n), *map(float, p)) for n, *p in rows], "tokens long, p0 double, p1 double, p2 double").repartition(3)


@pytest.mark.parametrize("targets", [(0.90, 0.05, 0.05), (0.2, 0.6, 0.2), (0.02, 0.08, 0.9), (0.0, 1.0, 0.0)])
@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_rates_are_those_of_a_dense_solver(spark, targets, spread):
    rng = np.random.default_rng(int(100 * spread))
    p = rng.dirichlet(np.array([8, 1, 1]) * spread, 150)
    n = rng.integers(1, 500, 150)
    t = np.array(targets)
    w = n / n.sum()
    fit = mixing.rates(members(spark, np.column_stack([n, p])), list(targets))
    want = dense(p, w, t)
    assert fit.converged
    assert fit.objective == pytest.approx(mixing.objective(want, t), abs=2e-4)
    assert fit.objective <= mixing.objective(p.T @ w, t) + 1e-9
    assert fit.totals == pytest.approx(want, abs=5e-3)
    found = members(spark, np.column_stack([n, p])).withColumn("r", fit.rate).toPandas()
    assert (found.r >= 0).all()
    assert [(found.tokens * found.r * found[f"p{k}"]).sum() / n.sum() for k in range(3)] == pytest.approx(fit.totals, abs=1e-6)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing_meets_its_targets(spark, sf):
    docs = spark.read.parquet(f"{SF}/{sf}/documents.parquet").withColumn("tokens", F.lit("clash")).withColumn("p0", F.lit("clash"))
    labels = spark.read.parquet(f"{SF}/{sf}/labels.parquet")
    found, domains = mixing.mixed(docs, mixing.label_domains(labels))
    rows = found.toPandas()
    p = rows[[f"p_{d}" for d in domains]].to_numpy()
    assert len(rows) == docs.count() and (rows.rate >= 0).all() and p.sum(axis=1) == pytest.approx(1.0)
    t = np.array([mixing.TARGETS[d] for d in domains])
    w = (rows.tokens / rows.tokens.sum()).to_numpy()
    totals = p.T @ (w * rows.rate.to_numpy())
    assert mixing.objective(totals, t) <= mixing.objective(dense(p, w, t, 20_000), t) + 1e-4
    assert abs((rows.copies - rows.rate).mean()) < 0.1


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/sf0.01/documents.parquet")
    labels = mixing.label_domains(spark.read.parquet(f"{SF}/sf0.01/labels.parquet"))
    found, domains = mixing.mixed(docs, labels.filter("id % 3 <> 0"))
    rows = found.toPandas().merge(labels.filter("id % 3 = 0").toPandas(), on="id")
    p = rows[[f"p_{d}" for d in domains]].to_numpy()
    guess = np.array(domains)[p.argmax(axis=1)]
    recall = {d: (guess[rows.domain == d] == d).mean() for d in domains}
    assert recall["clean"] >= 0.95 and recall["poor"] >= 0.7 and recall["toxic"] >= 0.4
    n = rows.tokens.to_numpy()
    for k, d in enumerate(domains):
        assert (n * p[:, k]).sum() / n.sum() == pytest.approx(n[rows.domain == d].sum() / n.sum(), abs=0.06)


def test_mixing_of_odd_rows(spark, tmp_path):
    texts = ["a b c", "a b c", None, "", " \t", "x " * 30_000, "y" * 200_000, "a b c"]
    rows = [(i % 6 if i != 6 else None, t, "kept") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, rate string").withColumn("row", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("copies", F.lit(3)).repartition(2).write.parquet(f"file://{tmp_path}/d")
    docs = spark.read.parquet(f"file://{tmp_path}/d")
    labels = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") == 0, "clean").when(F.col("doc_id") == 5, "poor").alias("domain"))
    found = mixing.weighted(docs, labels)
    assert sorted(found.columns) == sorted(["doc_id", "text", "row", "_row", "rate", "copies"])
    got = mixing.mixed(docs, labels)[0].toPandas()
    assert len(got) == len(texts) and got.rate.notna().all()
    same = got[got.id.isin([0, 1])].merge(docs.filter("text = 'a b c'").select(F.col("doc_id").alias("id")).toPandas(), on="id")
    assert same.rate.nunique() == 1
    assert found.filter("row <> 1 or _row <> 2").count() == 0


def test_mixing_without_rows_or_labels(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = docs.select(F.col("doc_id").alias("id"), F.lit("clean").alias("domain")).limit(0)
    found = mixing.mixed(docs, none)[0].toPandas()
    assert len(found) == 2 and found[["p_clean", "p_poor", "p_toxic"]].to_numpy() == pytest.approx(1 / 3)
    assert mixing.mixed(docs.limit(0), none)[0].count() == 0
    assert mixing.weighted(docs.limit(0), none).columns == ["doc_id", "text", "rate", "copies"]
