"""Readers, file lists, sinks, command line and streaming."""

import gzip

import pytest

from pyspark.sql import functions as F

from arbora import __main__ as cli
from arbora.operators import features, model, ranking
from arbora.plans.params import ForestParams
from arbora.sources import readers, sinks
from arbora.streaming import scoring

ARFF = """% comment
@relation test
@attribute 'a b' numeric
@ATTRIBUTE c real
@attribute cls {no, 'yes', maybe}

@data
1.5, 2, no
-0.0,?,yes
% another comment
3,4,maybe
"""


def test_arff_plain_and_gzip(spark, tmp_path):
    (tmp_path / "x.arff").write_text(ARFF)
    with gzip.open(tmp_path / "x.arff.gz", "wt") as f:
        f.write(ARFF)
    for name in ("x.arff", "x.arff.gz"):
        df = readers.read_dataset(spark, f"file://{tmp_path}/{name}")
        assert df.columns == ["a b", "c", "cls"]
        assert sorted(tuple(r) for r in df.select("a b", F.coalesce("c", F.lit(-1.0)), "cls").collect()) == [(-0.0, -1.0, 1), (1.5, 2.0, 0), (3.0, 4.0, 2)]
    assert features.attribute_kinds(df.schema, "cls") == {"numeric": 2, "nominal": 0}


def test_instances_default_to_the_last_column(spark):
    df = spark.createDataFrame([(1, -0.0, 1), (2, 5.0, 0)], "a int, b double, y int")
    frame = features.instances(df, instance_id="a")
    assert sorted((r.instance_id, str(list(r.features)), r.label, r.weight) for r in frame.collect()) == [(1, "[0.0]", 1, 1.0), (2, "[5.0]", 0, 1.0)]


def test_matching_files(spark, tmp_path):
    for name in ("a.csv", "b.csv", "c.txt", "sub"):
        (tmp_path / name).write_text("x,y\n1,2\n") if name != "sub" else (tmp_path / name).mkdir()
    found = readers.matching_files(spark, f"file://{tmp_path}", ".csv")
    assert [f.rsplit("/", 1)[1] for f in found] == ["a.csv", "b.csv"]
    assert readers.matching_files(spark, f"file://{tmp_path}/a.csv", ".csv") == [f"file://{tmp_path}/a.csv"]
    (tmp_path / "list").write_text("one\ntwo.csv\n\n")
    assert readers.matching_files(spark, f"file://{tmp_path}/list", ".csv") == ["one.csv", "two.csv"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "d string, v double").orderBy("d")
    sinks.write_csv(df, f"file://{tmp_path}/out", "\t")
    assert spark.read.csv(f"file://{tmp_path}/out", sep="\t", header=True).count() == 2
    assert sinks.tab_separated(df) == "d\tv\na\t1.5\nb\t"


def test_fit_and_score_from_the_command_line(spark, tmp_path, capsys):
    spark.range(60).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), (F.col("id") % 7 > 3).cast("int").alias("y")).write.parquet(f"file://{tmp_path}/d")
    assert cli.main(["fit", f"file://{tmp_path}/d", f"file://{tmp_path}/m", "-I", "3", "-depth", "2", "-criterion", "gini"]) == 0
    assert "3 trees" in capsys.readouterr().out
    assert cli.main(["score", f"file://{tmp_path}/d", f"file://{tmp_path}/m", f"file://{tmp_path}/s"]) == 0
    scored = spark.read.parquet(f"file://{tmp_path}/s")
    assert scored.filter("prediction = label").count() >= 55
    assert cli.main([]) == 2


def test_nominal_classes_of_csv_files(spark, tmp_path, capsys):
    (tmp_path / "d").mkdir()
    lines = ["a,b,y"] + [f"{i % 7},{i % 3},{'yes' if i % 7 > 3 else 'no'}" for i in range(60)] + ["1,1,"]
    (tmp_path / "d" / "x.csv").write_text("\n".join(lines) + "\n")
    path = f"file://{tmp_path}/d/x.csv"
    assert cli.main(["fit", path, f"file://{tmp_path}/m", "-I", "3", "-depth", "2", "-O", "-import", "-criterion", "gini"]) == 0
    said = capsys.readouterr().out
    assert "Out-of-bag error: not measured" not in said and "Importance of a:" in said
    assert cli.main(["score", path, f"file://{tmp_path}/m", f"file://{tmp_path}/s"]) == 0
    scored = spark.read.parquet(f"file://{tmp_path}/s")
    assert {r["class"] for r in scored.collect()} == {"no", "yes"} and scored.filter("prediction = label").count() >= 55
    assert cli.main(["bench", f"file://{tmp_path}/d", ".csv", f"file://{tmp_path}/r", "-I", "2", "-depth", "1", "-runs", "2", "-folds", "2", "-noRanges"]) == 0
    assert "speed_up" in capsys.readouterr().out
    assert spark.read.csv(f"file://{tmp_path}/r", header=True).count() == 4
    assert cli.main(["cite"]) == 0 and "Random Forests" in capsys.readouterr().out
    with pytest.raises(TypeError, match="not a number"):
        features.instances(spark.createDataFrame([(1.0, "yes")], "x double, y string"))


def test_stream_scoring_equals_batch(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("instance_id"), F.array((F.col("id") % 5).cast("float"), (F.col("id") % 2).cast("float")).alias("features"), (F.col("id") % 5 > 2).cast("int").alias("label"), F.lit(1.0).alias("weight"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    rows.write.parquet(f"file://{tmp_path}/in")
    fitted, _ = model.fit(rows.drop("ts"), ForestParams(trees=2, max_depth=2, criterion="gini"))
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    q = scoring.scored_stream(stream, fitted).writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = sorted((r.instance_id, r.prediction) for r in fitted.classify(rows).collect())
    assert sorted((r.instance_id, r.prediction) for r in spark.table("scored").collect()) == want
    w = scoring.windowed_votes(scoring.scored_stream(stream, fitted), "ts", "10 minutes", "1 minute").writeStream.format("memory").queryName("windowed").outputMode("complete").start()
    w.processAllAvailable()
    w.stop()
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == 40


def test_folds_are_stratified(spark):
    frame = spark.range(100).select(F.col("id").alias("instance_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    counts = ranking.stratified_folds(frame, 5, 1).groupBy("fold", "label").count().collect()
    assert {(r.label, r["count"]) for r in counts} == {(0, 15), (1, 5)}


def test_registry_is_complete_without_the_optional_parts():
    import __spark_entry__ as entry
    from arbora.plans import catalog

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
