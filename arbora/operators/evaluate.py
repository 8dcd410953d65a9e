"""Out-of-bag votes and errors, importances and interactions, AUC, cross-validation, paired test.

Votes are taken from a table of scores (tree, instance_id, probs), joined with
bags and feature subsets as ordinary relations.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.vectors import argmax
from arbora.operators.model import tree_votes, vote_sum
from arbora.plans.lineage import cut
from arbora.operators.ranking import scrambled_values, stratified_folds, sums_before


#: Most pairs of a tree and an attribute that are broadcast.
BROADCAST_SIDES = 500_000


def tree_scores(frame: DataFrame, nodes: DataFrame, classes: int, vector: str = "features") -> DataFrame:
    """(tree, instance_id, probs)."""
    voted = tree_votes(frame.select("instance_id", vector), nodes, vector, classes)
    return voted.select("instance_id", F.explode("votes").alias("v")).select(F.col("v.tree").alias("tree"), "instance_id", F.col("v.probs").alias("probs"))


def _voted(frame: DataFrame, scores: DataFrame, classes: int) -> DataFrame:
    """(instance_id, label, weight, vote): every row votes; without a score it votes class 0."""
    sums = scores.groupBy("instance_id").agg(*[F.sum(F.get("probs", F.lit(k))).alias(f"s{k}") for k in range(classes)])
    joined = frame.select("instance_id", "label", "weight").join(sums, "instance_id", "left")
    vector = F.array(*[F.coalesce(f"s{k}", F.lit(0.0)) for k in range(classes)])
    return joined.select("instance_id", "label", "weight", argmax(vector).alias("vote"))


def oob_votes(frame: DataFrame, scores: DataFrame, bag: DataFrame, classes: int) -> DataFrame:
    outside = scores.join(bag.select("tree", "instance_id"), ["tree", "instance_id"], "left_anti")
    return _voted(frame, outside, classes)


def error(votes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., error): weight of the rows with a wrong vote over all weight."""
    wrong = F.sum(F.when(F.col("vote") != F.col("label"), F.col("weight")).otherwise(0.0))
    return votes.groupBy(*(by or [])).agg(F.try_divide(wrong, F.sum("weight")).alias("error"))


def oob_error(frame: DataFrame, scores: DataFrame, bag: DataFrame, classes: int) -> DataFrame:
    return error(oob_votes(frame, scores, bag, classes))


def _movable(frame: DataFrame, bag: DataFrame, attributes: int, seed: int) -> DataFrame:
    """(instance_id, label, weight, features, moved, inside): each attribute's scrambled values, and the trees whose bags hold the row; written."""
    inside = bag.groupBy("instance_id").agg(F.collect_set("tree").alias("inside"))  # a tree a bag
    rows = frame.select("instance_id", "label", "weight", "features").join(scrambled_values(frame, attributes, seed), "instance_id")
    return cut(rows.join(inside, "instance_id", "left").withColumn("inside", F.coalesce("inside", F.array().cast("array<int>"))))


def _moved_error(rows: DataFrame, nodes: DataFrame, classes: int, by: list[str]) -> DataFrame:
    """(by.., error) out of bag, with the attributes that the columns `by` name scrambled. Rows of _movable, not shuffled."""

    def value(x, i):
        moved = F.lit(False)
        for c in by:
            moved = moved | (F.col(c) == i)
        return F.when(moved, F.get("moved", i)).otherwise(x)

    voted = tree_votes(rows.withColumn("features", F.transform("features", value)).drop("moved"), nodes, "features", classes)
    outside = F.filter("votes", lambda v: ~F.array_contains("inside", v["tree"]))
    return error(voted.select(*by, "label", "weight", argmax(vote_sum(outside, classes)).alias("vote")), by)


def _base_and_single(rows: DataFrame, nodes: DataFrame, classes: int, attributes: int) -> tuple[DataFrame, DataFrame]:
    """One row (base), and (attr, importance); written."""
    base = cut(_moved_error(rows, nodes, classes, []).withColumnRenamed("error", "base"))
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(attributes - 1))).alias("attr"))
    changed = _moved_error(each, nodes, classes, ["attr"])
    return base, cut(changed.join(F.broadcast(base)).select("attr", (F.col("error") - F.col("base")).alias("importance")))


def permutation_importance(frame: DataFrame, nodes: DataFrame, bag: DataFrame, classes: int, attributes: int, seed: int) -> DataFrame:
    """(attr, importance): out-of-bag error with a scrambled column less the error without.

    All columns are scrambled by one sort, and all attributes are scored in one
    pass: a row is repeated for each of them within its task.
    """
    return _base_and_single(_movable(frame, bag, attributes, seed), nodes, classes, attributes)[1]


def _pairs(attributes: int) -> Column:
    """Explodes to structs (attr_i, attr_j) of all pairs of two attributes or more."""
    after = lambda i: F.transform(F.sequence(i + 1, F.lit(attributes - 1)), lambda j: F.struct(i.alias("attr_i"), j.alias("attr_j")))
    return F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(attributes - 2)), after)))


def permutation_interaction(frame: DataFrame, nodes: DataFrame, bag: DataFrame, classes: int, attributes: int, seed: int) -> DataFrame:
    """(attr_i, attr_j, interaction): joint loss of two scrambled columns less their single losses."""
    rows = _movable(frame, bag, attributes, seed)
    base, single = _base_and_single(rows, nodes, classes, attributes)
    found = _moved_error(rows.select("*", _pairs(attributes).alias("p")).select("*", "p.*").drop("p"), nodes, classes, ["attr_i", "attr_j"])
    one = lambda c, x: single.select(F.col("attr").alias(c), F.col("importance").alias(x))
    return found.join(F.broadcast(base)).join(one("attr_i", "x"), "attr_i").join(one("attr_j", "y"), "attr_j").select("attr_i", "attr_j", (F.col("error") - F.col("base") - F.col("x") - F.col("y")).alias("interaction"))


def _known_votes(frame: DataFrame, scores: DataFrame, bag: DataFrame, subset: DataFrame, attributes: int) -> DataFrame:
    """(label, weight, votes): a row's out-of-bag votes as structs (probs, knows), knows telling by attribute whether the tree has it."""
    outside = scores.join(bag.select("tree", "instance_id"), ["tree", "instance_id"], "left_anti")
    has = lambda attrs: F.transform(F.sequence(F.lit(0), F.lit(attributes - 1)), lambda a: F.array_contains(attrs, a))
    known = cut(subset.groupBy("tree").agg(F.collect_set(F.col("attr").cast("int")).alias("attrs")).select("tree", has(F.col("attrs")).alias("knows")))
    nothing = F.array_repeat(F.lit(False), attributes)
    small = known.count() * attributes <= BROADCAST_SIDES
    if not small:
        outside = outside.join(known, "tree", "left")
    parts = ["tree", "probs"] if small else ["tree", "probs", "knows"]
    votes = outside.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("votes"))  # a vote a tree
    kind = "array<struct<tree:int,probs:array<double>" + ("" if small else ",knows:array<boolean>") + ">>"
    rows = frame.select("instance_id", "label", "weight").join(votes, "instance_id", "left").withColumn("votes", F.coalesce(F.col("votes").cast(kind), F.array().cast(kind)))
    if small:
        rows = rows.join(F.broadcast(known.agg(F.map_from_entries(F.collect_list(F.struct("tree", "knows"))).alias("of"))))  # one row of a checked size
    knows = lambda v: F.coalesce(F.try_element_at("of", v["tree"]) if small else v["knows"], nothing)
    return cut(rows.select("label", "weight", F.transform("votes", lambda v: F.struct(v["probs"].alias("probs"), knows(v).alias("knows"))).alias("votes")))


def _error_of(votes: Column, classes: int) -> Column:
    """Aggregate: the error of some of each row's votes; null where no row has any of them."""
    wrong = F.sum(F.when(argmax(vote_sum(votes, classes)) != F.col("label"), F.col("weight")).otherwise(0.0))
    return F.when(F.sum(F.size(votes)) > 0, F.try_divide(wrong, F.sum("weight")))


def dropout_importance(frame: DataFrame, scores: DataFrame, bag: DataFrame, subset: DataFrame, classes: int, attributes: int) -> DataFrame:
    """(attr, importance): error of the trees without an attribute less that of the trees with it."""
    rows = _known_votes(frame, scores, bag, subset, attributes).select("*", F.explode(F.sequence(F.lit(0), F.lit(attributes - 1))).alias("attr"))
    e = lambda has: _error_of(F.filter("votes", lambda v: F.get(v["knows"], F.col("attr")) == has), classes)
    return rows.groupBy("attr").agg((e(False) - e(True)).alias("importance"))


def dropout_interaction(frame: DataFrame, scores: DataFrame, bag: DataFrame, subset: DataFrame, classes: int, attributes: int) -> DataFrame:
    """(attr_i, attr_j, interaction): trees by whether they know both, one or none of two attributes."""
    rows = _known_votes(frame, scores, bag, subset, attributes).select("*", _pairs(attributes).alias("p")).select("label", "weight", "votes", "p.*")
    e = lambda i, j: _error_of(F.filter("votes", lambda v: (F.get(v["knows"], F.col("attr_i")) == i) & (F.get(v["knows"], F.col("attr_j")) == j)), classes)
    errors = rows.groupBy("attr_i", "attr_j").agg(e(False, False).alias("e00"), e(True, True).alias("e11"), e(True, False).alias("e10"), e(False, True).alias("e01"))
    return errors.select("attr_i", "attr_j", F.expr("(e00 - e11) - (e00 - e10) - (e00 - e01)").alias("interaction"))


def attribute_ranking(importances: DataFrame) -> DataFrame:
    """(rank, attr, importance), the most important first; one row an attribute."""
    w = Window.orderBy(F.desc("importance"), "attr")
    return importances.select(F.row_number().over(w).alias("rank"), "attr", "importance")


def auc(frame: DataFrame, score: str | Column, positive: Column) -> DataFrame:
    """One row (auc): the chance that a positive row scores above a negative one, ties counting half.

    Scores are counted first, so that the running sum orders distinct scores.
    """
    score = F.col(score) if isinstance(score, str) else score
    counts = frame.select(score.alias("score"), positive.cast("bigint").alias("pos")).groupBy("score").agg(F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("n"))
    pairs = sums_before(counts, [], "score", "n", "below")
    won = F.sum(F.col("p") * F.col("below") + F.col("p") * F.col("n") / 2.0)
    return pairs.agg(F.try_divide(won, (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def weighted_auc(scored: DataFrame, classes: int) -> DataFrame:
    """One row (auc): one-vs-rest AUCs weighted by class priors; classes without an AUC are left out.

    scored: label, weight, distribution (array by class).
    """
    rows = scored.select("label", "weight", F.posexplode("distribution").alias("cls", "score"))
    counts = rows.groupBy("cls", "score").agg(F.sum(F.when(F.col("label") == F.col("cls"), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") != F.col("cls"), 1).otherwise(0)).alias("n"))
    won = F.sum(F.col("p") * F.col("below") + F.col("p") * F.col("n") / 2.0)
    each = sums_before(counts, ["cls"], "score", "n", "below").groupBy("cls").agg(F.try_divide(won, (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))
    priors = scored.groupBy(F.col("label").alias("cls")).agg(F.sum("weight").alias("prior"))
    known = each.join(priors, "cls").filter("auc is not null")
    return known.agg(F.try_divide(F.sum(F.col("auc") * F.col("prior")), F.sum("prior")).alias("auc"))


def accuracy(predicted: DataFrame) -> DataFrame:
    """One row (pct_correct)."""
    return predicted.agg((100 * F.avg((F.col("prediction") == F.col("label")).cast("double"))).alias("pct_correct"))


def cross_validated(frame: DataFrame, train: Callable[[DataFrame], object], folds: int, seed: int, runs: int = 1) -> DataFrame:
    """(run, instance_id, label, weight, fold, distribution) of repeated stratified k-fold cross-validation.

    train(frame) gives a model with distribution(frame); it is called once a fold.
    """
    found = None
    for run in range(runs):
        folded = frame.join(stratified_folds(frame, folds, seed + run).select("instance_id", "fold"), "instance_id")
        for k in range(folds):
            model = train(folded.filter(F.col("fold") != k).drop("fold"))
            scored = model.distribution(folded.filter(F.col("fold") == k)).select(F.lit(run).alias("run"), "instance_id", "label", "weight", "fold", "distribution")
            found = scored if found is None else found.unionByName(scored)
    return found


def run_means(results: DataFrame) -> DataFrame:
    """(dataset, measure means) over runs: results has dataset, run and numeric measures."""
    measures = [c for c, t in results.dtypes if c not in ("dataset", "run") and t in ("double", "float", "int", "bigint")]
    return results.groupBy("dataset").agg(*[F.avg(c).alias(c) for c in measures])


def paired_t(pairs: DataFrame, folds: int) -> DataFrame:
    """One row (n, mean_diff, var_diff, t): corrected paired t statistic of columns a and b, one row a run."""
    d = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("a") - F.col("b")).alias("mean_diff"), F.coalesce(F.var_samp(F.col("a") - F.col("b")), F.lit(0.0)).alias("var_diff"))
    spread = (F.lit(1.0) / F.col("n") + F.lit(1.0 / (folds - 1))) * F.col("var_diff")
    return d.withColumn("t", F.try_divide(F.col("mean_diff"), F.sqrt(spread)))


def t_p_value(t: float, df: int) -> float:
    """Two-sided p-value of Student's t by the regularised incomplete beta function."""
    if df < 1 or math.isnan(t):
        return math.nan
    return _beta(df / (df + t * t), df / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            f *= c * d
    return front * f
