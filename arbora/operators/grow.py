"""Tree induction, all trees of a forest at once and level by level.

The frontier is a table (tree, node, instance_id, features, label, w). Each
level is one round of histogram, scan, choice and routing. The children of node
i are 2i and 2i+1 down to depth HEAP_DEPTH; deeper nodes, whose numbers a long
could not hold, are numbered level by level from 2**62 on. The table is
checkpointed once a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators import splits as S
from arbora.operators.ranking import node_attr_order
from arbora.plans.lineage import cut
from arbora.plans.params import ResolvedParams

#: Most splits of a level that are broadcast for routing (about 40 bytes each).
BROADCAST_SPLITS = 200_000
#: Deepest nodes with the numbers of a heap.
HEAP_DEPTH = 61

NODE_COLUMNS = ["tree", "node", "depth", "attr", "split", "left", "right", "n_rows", "probs"]


def frontier(frame: DataFrame, bag: DataFrame) -> DataFrame:
    """The rows of all bags at their roots."""
    return frame.join(bag, "instance_id").select(F.col("tree").cast("int"), F.lit(1).cast("bigint").alias("node"), "instance_id", "features", "label", (F.col("n_draws") * F.col("weight")).alias("w"))


def node_stats(rows: DataFrame, classes: int) -> DataFrame:
    return rows.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n_rows"), *S.class_sums(classes))


def leaf_vector(classes: int):
    """Class weights over the number of distinct rows: heavy leaves vote heavily."""
    return F.array(*[F.col(f"c{k}") / F.col("n_rows") for k in range(classes)]).alias("probs")


def _pure(classes: int, criterion: str):
    present = [F.col(f"c{k}") >= 1e-5 if criterion == "gini" else F.col(f"c{k}") > 0 for k in range(classes)]
    return sum((p.cast("int") for p in present), F.lit(0)) <= 1


def choose_splits(rows: DataFrame, active: DataFrame, r: ResolvedParams, classes: int, attributes: int, subset: DataFrame | None = None, ranged: bool | None = None) -> DataFrame:
    """(tree, node, attr, split, gain) of the active nodes that have a sensible split; written.

    The first k attributes of each node are scanned first, and the others only
    for the nodes that these leave without a split.
    """
    p = r.params
    order = node_attr_order(active, attributes, p.seed)
    if subset is not None:
        from pyspark.sql import Window

        order = order.join(subset, ["tree", "attr"], "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("tree", "node").orderBy("rank")))
    found = None
    for early in (True, False):
        wanted = order.filter(F.col("rank") <= r.features if early else F.col("rank") > r.features)
        if not early:
            wanted = wanted.join(found.select("tree", "node"), ["tree", "node"], "left_anti")
        # each row keeps only the attributes its node looks at
        looks = wanted.groupBy("tree", "node").agg(F.collect_list("attr").alias("attrs"))
        some = rows.join(F.broadcast(looks) if looks_fit(active) else looks, ["tree", "node"])
        long = some.select("tree", "node", "instance_id", "label", "w", "features", F.explode("attrs").alias("attr")).withColumn("value", F.element_at("features", F.col("attr") + 1)).drop("features")
        histogram = S.value_histogram(long, classes)
        scan = S.split_scan_ranged if ranged else S.split_scan
        best = S.best_per_attribute(scan(histogram, classes, p.criterion, p.criterion == "gini" and p.class_change))
        chosen = cut(S.best_at_node(best, order, r.features))
        found = chosen if found is None else found.unionByName(chosen)
        if not early or r.features >= attributes or active.count() == found.count():
            return found
    return found


def looks_fit(active: DataFrame) -> bool:
    return active.count() <= BROADCAST_SPLITS // 10


def _children(chosen: DataFrame, depth: int, before: int) -> DataFrame:
    """(tree, node, a, split, left, right) of a level's splits; before: nodes numbered from 2**62 on so far."""
    left = F.col("node") * 2
    if depth >= HEAP_DEPTH:
        from pyspark.sql import Window

        # a row a split: no more than there are nodes in the level
        left = (F.row_number().over(Window.partitionBy("tree").orderBy("node")) - 1).cast("bigint") * 2 + F.lit((1 << 62) + before)
    return chosen.select("tree", "node", F.col("attr").alias("a"), "split", left.alias("left")).withColumn("right", F.col("left") + 1)


def grow(frame: DataFrame, bag: DataFrame, r: ResolvedParams, classes: int, attributes: int, subset: DataFrame | None = None, levels: int | None = None, ranged: bool | None = None) -> DataFrame:
    """The node table of a forest over frame (instance table) and bag (tree, instance_id, n_draws)."""
    p = r.params
    limit = p.max_depth or 10_000
    if levels is not None:
        limit = min(limit, levels)
    rows = cut(frontier(frame, bag))
    ranged = p.ranged if ranged is None else ranged
    out, deep = None, 0
    for depth in range(limit + 1):
        stats = cut(node_stats(rows, classes))
        active = stats.filter((F.col("n_rows") >= 2) & ~_pure(classes, p.criterion)) if depth < limit else stats.limit(0)
        chosen = choose_splits(rows, active, r, classes, attributes, subset, ranged) if depth < limit and active.limit(1).count() else None
        level = stats.withColumn("depth", F.lit(depth))
        if chosen is not None:
            to = _children(chosen, depth, deep)
            level = level.join(to, ["tree", "node"], "left")
        else:
            level = level.select("*", F.lit(None).cast("int").alias("a"), F.lit(None).cast("double").alias("split"), *[F.lit(None).cast("bigint").alias(c) for c in ("left", "right")])
        inner = F.col("a").isNotNull()
        nodes = level.select(
            "tree", "node", "depth", F.coalesce("a", F.lit(-1)).alias("attr"), "split",
            "left", "right", "n_rows", F.when(~inner, leaf_vector(classes)).alias("probs"),
        )
        out = nodes if out is None else out.unionByName(nodes)
        n = chosen.count() if chosen is not None else 0
        if not n:
            break
        deep += 2 * n if depth >= HEAP_DEPTH else 0
        moved = rows.join(F.broadcast(to) if n <= BROADCAST_SPLITS else to, ["tree", "node"])
        goes = F.when(F.element_at("features", F.col("a") + 1).cast("double") < F.col("split"), F.col("left")).otherwise(F.col("right"))
        rows = cut(moved.select("tree", goes.alias("node"), "instance_id", "features", "label", "w"))
    return cut(out)
