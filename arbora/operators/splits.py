"""Split search: value histograms, prefix-sum scans, best splits.

Rows: (tree, node, instance_id, attr, value, label, w). The histogram sums the
class weights of equal values first (partial aggregation before the shuffle),
so that the scans order distinct values and not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import criteria
from arbora.plans.lineage import cut
from arbora.plans.params import MIN_GAIN

KEYS = ["tree", "node", "attr"]


def class_columns(classes: int, prefix: str = "c") -> list[str]:
    return [f"{prefix}{k}" for k in range(classes)]


def class_sums(classes: int) -> list[Column]:
    return [F.sum(F.when(F.col("label") == k, F.col("w")).otherwise(0.0)).alias(f"c{k}") for k in range(classes)]


def value_histogram(rows: DataFrame, classes: int) -> DataFrame:
    """(tree, node, attr, value, c0.., first_label, last_label): the labels of the least and the greatest id of a value."""
    ends = [F.min(F.struct("instance_id", "label"))["label"].alias("first_label"), F.max(F.struct("instance_id", "label"))["label"].alias("last_label")]
    return rows.groupBy(*KEYS, "value").agg(*class_sums(classes), *ends)


def _scored(scanned: DataFrame, classes: int, criterion: str, class_change: bool) -> DataFrame:
    left = [F.col(f"l{k}") for k in range(classes)]
    whole = [F.col(f"t{k}") for k in range(classes)]
    right = [w - x for w, x in zip(whole, left, strict=True)]
    conditional, prior = (criteria.entropy_conditional, criteria.entropy_prior) if criterion == "entropy" else (criteria.gini_conditional, criteria.gini_prior)
    found = scanned.filter(F.col("next_value").isNotNull())
    if class_change:
        found = found.filter("last_label <> next_label")
    return found.select(*KEYS, criteria.midpoint(F.col("value"), F.col("next_value")).alias("split"), conditional([left, right]).alias("score"), prior(whole).alias("prior"))


def split_scan(histogram: DataFrame, classes: int, criterion: str = "gini", class_change: bool = False) -> DataFrame:
    """All candidates (tree, node, attr, split, score, prior): running class sums up to each boundary of values."""
    w = Window.partitionBy(*KEYS).orderBy("value")
    running, whole = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*KEYS)
    scanned = histogram.select(
        "*",
        *[F.sum(f"c{k}").over(running).alias(f"l{k}") for k in range(classes)],
        *[F.sum(f"c{k}").over(whole).alias(f"t{k}") for k in range(classes)],
        F.lead("value").over(w).alias("next_value"),
        F.lead("first_label").over(w).alias("next_label"),
    )
    return _scored(scanned, classes, criterion, class_change)


def split_scan_ranged(histogram: DataFrame, classes: int, criterion: str = "gini", class_change: bool = False) -> DataFrame:
    """split_scan for columns of very many distinct values: no task sorts a whole column.

    The histogram is range-partitioned by (tree, node, attr, value); each part
    is scanned on its own, and the sums of the parts before it, one row for
    each part and column, are added.
    """
    ordered = cut(histogram.repartitionByRange(*KEYS, "value").withColumn("part", F.spark_partition_id()))
    sums = [F.sum(f"c{k}").alias(f"c{k}") for k in range(classes)]
    parts = ordered.groupBy(*KEYS, "part").agg(*sums, F.min(F.struct("value", "first_label")).alias("first"))
    w = Window.partitionBy(*KEYS).orderBy("part")
    running, whole = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*KEYS)
    parts = parts.select(
        *KEYS,
        "part",
        *[(F.sum(f"c{k}").over(running) - F.col(f"c{k}")).alias(f"b{k}") for k in range(classes)],
        *[F.sum(f"c{k}").over(whole).alias(f"t{k}") for k in range(classes)],
        F.lead("first").over(w).alias("after"),
    )
    own = Window.partitionBy(*KEYS, "part").orderBy("value")
    local = ordered.select(
        "*",
        *[F.sum(f"c{k}").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"o{k}") for k in range(classes)],
        F.lead("value").over(own).alias("lead_value"),
        F.lead("first_label").over(own).alias("lead_label"),
    )
    scanned = local.join(parts, [*KEYS, "part"]).select(
        *KEYS,
        "value",
        "last_label",
        *[(F.col(f"b{k}") + F.col(f"o{k}")).alias(f"l{k}") for k in range(classes)],
        *[f"t{k}" for k in range(classes)],
        F.coalesce("lead_value", "after.value").alias("next_value"),
        F.when(F.col("lead_value").isNotNull(), F.col("lead_label")).otherwise(F.col("after.first_label")).alias("next_label"),
    )
    return _scored(scanned, classes, criterion, class_change)


def best_per_attribute(candidates: DataFrame) -> DataFrame:
    """(tree, node, attr, split, score, prior, gain): the least score, then the lowest split."""
    best = F.min(F.struct("score", "split", "prior")).alias("b")
    return candidates.groupBy(*KEYS).agg(best).select(*KEYS, "b.split", "b.score", "b.prior", (F.col("b.prior") - F.col("b.score")).alias("gain"))


def best_at_node(best: DataFrame, order: DataFrame, k: int) -> DataFrame:
    """(tree, node, attr, split, gain): of the first k attributes the greatest sensible gain (lowest rank of equals), else the first sensible one after them."""
    w = Window.partitionBy("tree", "node").orderBy(F.when(F.col("rank") <= k, 0).otherwise(1), F.when(F.col("rank") <= k, -F.col("gain")), "rank")
    sensible = best.join(order, KEYS).filter(F.col("gain") > MIN_GAIN)
    return sensible.withColumn("r", F.row_number().over(w)).filter("r = 1").select("tree", "node", "attr", "split", "gain")
