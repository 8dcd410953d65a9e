"""The pipeline's stages, and operators without a test of their own for it, on odd rows."""

import pytest
from pyspark.sql import functions as F

from arbora.llm import decontaminate, exact_dedup, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('odd')}/documents.parquet"
    texts = [None, None, "", "a b c", "a b c", "a  b c", "word " * 20_000, "z" * 100_000, "one two three four five six seven"]
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else "en", None, i) for i, t in enumerate(texts)]
    clashing = [F.lit("kept").alias(c) for c in ("_row", "_hit_row", "_rejected_row", "_dropped_row", "row", "id", "rate", "n", "words")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *clashing).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def test_stages_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    docs = odd
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        after = spark.read.parquet(f"file://{tmp_path}/{name}")
        if i + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == odd.columns
        else:
            assert set(after.columns) == {*odd.columns, "copies"}
            after = after.withColumn("rate", F.lit("kept"))
        clashing = [c for c in after.columns if c in ("_row", "_hit_row", "_rejected_row", "_dropped_row", "row", "id", "n", "words")]
        assert after.filter(" or ".join(f"`{c}` <> 'kept'" for c in clashing)).count() == 0
        if name == "exact_dedup":
            assert after.count() < before and after.filter("coalesce(text, '') = ''").count() == 1
        docs = after.withColumn("rate", F.lit("kept"))
    assert docs.count() >= 1


def test_stages_on_an_empty_table(spark, odd, tmp_path):
    import corpus_pipeline

    docs = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.count() == 0


def test_null_ids(spark, odd):
    got = {r.row: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(odd.select("doc_id", "text").filter("replace(text, ' ', '') = 'abc'")).collect()}
    assert sorted(got.values(), key=str) == [(5, 3)] * 3  # the most code points
    bench = spark.createDataFrame([(None, "one two three four five six seven"), (1, "nothing")], "item_id long, text string")
    hit = [r for r in decontaminate.contamination(odd, bench).collect() if r.contaminated]
    assert [(r.doc_id, r["items"]) for r in hit] == [(8, [""])]


def test_empty_documents_and_pages(spark, odd):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(odd.limit(0), bench).count() == 0
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
