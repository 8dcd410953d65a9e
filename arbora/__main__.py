"""python -m arbora fit DATA MODEL [options] | score DATA MODEL OUT | bench PLACE SUFFIX OUT [options]

fit: DATA (Parquet, CSV or ARFF) with the class in its last column, options as
in params.from_options. score: adds distribution and prediction. bench:
repeated cross-validation of both criteria over all files of a folder or list,
AUC, accuracy and seconds a run, as CSV.
"""

from __future__ import annotations

import sys
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators import evaluate, features, model
from arbora.plans.lineage import cut
from arbora.plans.params import ForestParams, from_options
from arbora.sources import readers, sinks

#: The publication of the method.
CITATION = {"type": "article", "author": "Leo Breiman", "title": "Random Forests", "journal": "Machine Learning", "volume": "45", "number": "1", "pages": "5-32", "year": "2001"}


def load(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """The instance table of a data set, the names of its attributes, and those of nominal classes."""
    data, classes = features.index_labels(readers.read_dataset(spark, path))
    return features.instances(data.filter(F.col(data.columns[-1]).isNotNull())), data.columns[:-1], classes


def benchmark(spark: SparkSession, paths: list[str], params: list[ForestParams], folds: int = 10, runs: int = 10) -> DataFrame:
    """(dataset, run, criterion, auc, pct_correct, seconds), one row a run; gini only for data sets of two classes."""
    rows = []
    for path in paths:
        frame, names, _ = load(spark, path)
        frame = cut(model.indexed(frame)[0])
        classes = max(2, int(frame.agg(F.max("label")).first()[0] or 0) + 1)
        for p in params:
            if p.criterion == "gini" and classes > 2:
                continue
            for run in range(runs):
                began = time.perf_counter()
                scored = cut(evaluate.cross_validated(frame, lambda f, p=p: model.fit(f, p, names)[0], folds, p.seed + run))
                took = time.perf_counter() - began
                auc = evaluate.weighted_auc(scored, classes).first()[0]
                right = evaluate.accuracy(scored.withColumn("prediction", model.argmax(F.col("distribution")))).first()[0]
                rows.append((path, run, p.criterion, auc, right, took))
    return spark.createDataFrame(rows, "dataset string, run int, criterion string, auc double, pct_correct double, seconds double")


def compared(results: DataFrame, folds: int) -> DataFrame:
    """(dataset, measure, mean_a, mean_b, difference, t, p_value, speed_up) of the entropy (a) and gini (b) forests."""
    rows = []
    for r in results.select("dataset").distinct().orderBy("dataset").collect():  # a row a data set
        of = results.filter(F.col("dataset") == r.dataset)
        by_run = of.groupBy("run").pivot("criterion", ["entropy", "gini"]).agg(F.first("auc").alias("auc"), F.first("pct_correct").alias("pct_correct"), F.first("seconds").alias("seconds")).cache()
        for measure in ("auc", "pct_correct"):
            pairs = by_run.select(F.col(f"entropy_{measure}").alias("a"), F.col(f"gini_{measure}").alias("b"), F.col("entropy_seconds").alias("s"), F.col("gini_seconds").alias("u")).filter("a is not null and b is not null")
            test = evaluate.paired_t(pairs, folds).first()
            means = pairs.agg(F.avg("a"), F.avg("b"), F.try_divide(F.sum("s"), F.sum("u"))).first()
            p = evaluate.t_p_value(test.t, test.n - 1) if test.t is not None else None
            rows.append((r.dataset, measure, means[0], means[1], test.mean_diff, test.t, p, means[2]))
    return results.sparkSession.createDataFrame(rows, "dataset string, measure string, mean_a double, mean_b double, difference double, t double, p_value double, speed_up double")


def main(args: list[str]) -> int:
    if not args or args[0] not in ("fit", "score", "bench", "cite"):
        print(__doc__)
        return 2
    if args[0] == "cite":
        print("\n".join(f"{k}: {v}" for k, v in CITATION.items()))
        return 0
    spark = SparkSession.builder.appName("arbora").getOrCreate()
    if args[0] == "fit":
        frame, names, classes = load(spark, args[1])
        fitted, _ = model.fit(frame, from_options(args[3:]), names)
        fitted.class_names = classes
        fitted.save(args[2])
        print(fitted.describe())
    elif args[0] == "score":
        frame, _, _ = load(spark, args[1])
        fitted = model.ForestModel.load(spark, args[2])
        scored = fitted.classify(frame)
        if fitted.class_names:
            scored = scored.withColumn("class", F.get(F.array(*map(F.lit, fitted.class_names)), F.col("prediction")))
        scored.write.mode("overwrite").parquet(args[3])
    else:
        options = list(args[4:])
        counts = {"-runs": 10, "-folds": 10}
        for name in counts:
            if name in options:
                at = options.index(name)
                counts[name] = int(options[at + 1])
                del options[at : at + 2]
        base = from_options(options)
        results = benchmark(spark, readers.matching_files(spark, args[1], args[2]), [replace(base, criterion=c) for c in ("entropy", "gini")], counts["-folds"], counts["-runs"])
        sinks.write_csv(results, args[3])
        for c in ("entropy", "gini"):
            print(f"{c}\n{sinks.tab_separated(evaluate.run_means(results.filter(F.col('criterion') == c)))}")
        print(sinks.tab_separated(compared(results, counts["-folds"])))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
