"""A fitted forest: node table, scoring, flat form, persistence, description."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.vectors import added, argmax, classified, normalised
from arbora.operators import bagging, features as feats
from arbora.operators.grow import NODE_COLUMNS, grow
from arbora.plans.params import ForestParams, resolve

#: Most nodes that are packed into one broadcast row; larger forests are scored in chunks of whole trees.
PACKED_NODES = 200_000

_PACKED = "array<struct<tree:int,attr:array<int>,split:array<double>,left:array<int>,right:array<int>,probs:array<array<double>>>>"


def tree_sizes(nodes: DataFrame) -> DataFrame:
    """(tree, n_nodes, n_splits, n_leaves, max_depth)."""
    return nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("attr") >= 0).alias("n_splits"), F.count_if(F.col("attr") < 0).alias("n_leaves"), F.max("depth").alias("max_depth"))


def packed(nodes: DataFrame) -> DataFrame:
    """One row: the trees as arrays over slots; slot 0 is the root."""
    from pyspark.sql import Window

    slots = nodes.withColumn("slot", F.row_number().over(Window.partitionBy("tree").orderBy("node")) - 1)
    child = slots.select("tree", F.col("node").alias("child"), F.col("slot").alias("child_slot"))
    linked = slots
    for side in ("left", "right"):
        linked = linked.join(child.select("tree", F.col("child").alias(side), F.col("child_slot").alias(f"{side}_slot")), ["tree", side], "left")
    entry = F.struct("slot", "attr", "split", F.col("left_slot").alias("left"), F.col("right_slot").alias("right"), "probs")
    trees = linked.groupBy("tree").agg(F.array_sort(F.collect_list(entry)).alias("n"))
    tree = F.struct("tree", F.col("n.attr").alias("attr"), F.col("n.split").alias("split"), F.col("n.left").alias("left"), F.col("n.right").alias("right"), F.col("n.probs").alias("probs"))
    return trees.agg(F.array_sort(F.collect_list(tree)).cast(_PACKED).alias("forest"))


def leaf_slot(tree: Column, x: Column, depth: int) -> Column:
    """Slot of the leaf that the vector x reaches: value < split goes left; null and NaN go right."""
    if not depth:
        return F.lit(0)

    def step(n, _):
        attr = F.get(tree["attr"], n)
        return F.when(attr < 0, n).when(F.get(x, attr) < F.get(tree["split"], n), F.get(tree["left"], n)).otherwise(F.get(tree["right"], n))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def tree_chunks(nodes: DataFrame, limit: int) -> tuple[list[tuple[list[int], int]], list[int], int]:
    """(chunks of trees with limit nodes at most and their depths, trees that are larger, the greatest depth)."""
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth")).orderBy("tree").collect()  # a row a tree
    chunks: list[tuple[list[int], int]] = []
    room, large = 0, []
    for r in sizes:
        if r.n > limit:
            large.append(r.tree)
        elif chunks and r.n <= room:
            chunks[-1] = (chunks[-1][0] + [r.tree], max(chunks[-1][1], r.depth))
            room -= r.n
        else:
            chunks.append(([r.tree], r.depth))
            room = limit - r.n
    return chunks, large, max((r.depth for r in sizes), default=0)


def tree_votes(frame: DataFrame, nodes: DataFrame, vector: str, classes: int, limit: int | None = None) -> DataFrame:
    """frame and votes: array of (tree, probs), the leaf vector of each tree.

    Trees are packed in chunks of at most `limit` nodes, each broadcast as one
    row and scored by an expression, so that rows are never shuffled. Only a
    tree that is larger on its own is walked by equi-joins, one a level.
    """
    limit = PACKED_NODES if limit is None else limit
    chunks, large, deepest = tree_chunks(nodes, limit)
    whole = len(chunks) == 1 and not large
    out = frame.withColumn("votes", F.array().cast("array<struct<tree:int,probs:array<double>>>"))

    def chunk_votes(depth: int) -> Column:
        return F.transform("forest", lambda t: F.struct(t["tree"].alias("tree"), F.get(t["probs"], leaf_slot(t, F.col(vector), depth)).alias("probs")))

    for trees, depth in chunks:
        forest = F.broadcast(packed(nodes if whole else nodes.filter(F.col("tree").isin(trees))))  # one row of a checked size
        out = out.join(forest).withColumn("votes", chunk_votes(depth) if whole else F.concat("votes", chunk_votes(depth))).drop("forest")
    if not large:
        return out if whole else out.withColumn("votes", F.array_sort("votes"))
    rows = out.withColumn("_row", F.monotonically_increasing_id())
    at = rows.select("_row", vector, F.explode(F.array(*map(F.lit, large))).alias("tree")).withColumn("node", F.lit(1).cast("bigint"))
    table = nodes.filter(F.col("tree").isin(large)).select("tree", "node", "attr", "split", "left", "right", "probs")
    for _ in range(deepest):
        goes = F.when(F.col("attr") < 0, F.col("node")).when(F.get(F.col(vector), F.col("attr")) < F.col("split"), F.col("left")).otherwise(F.col("right"))
        at = at.join(table.drop("probs"), ["tree", "node"]).select("_row", vector, "tree", goes.alias("node"))
    more = at.join(table, ["tree", "node"]).groupBy("_row").agg(F.collect_list(F.struct("tree", "probs")).alias("_more"))  # a vote a tree
    return rows.join(more, "_row").withColumn("votes", F.array_sort(F.concat("votes", "_more"))).drop("_row", "_more")


def vote_sum(votes: Column, classes: int) -> Column:
    return F.aggregate(votes, F.array(*[F.lit(0.0)] * classes), lambda acc, v: added(acc, v["probs"]))


def flat_score(votes: Column, ratio: bool = True) -> Column:
    """Mean over trees of p1 / (p0 + p1), or of p1: not the forest's distribution."""
    one = lambda v: F.coalesce(F.try_divide(v["probs"][1], v["probs"][0] + v["probs"][1]), F.lit(0.0)) if ratio else v["probs"][1]
    return F.try_divide(F.aggregate(votes, F.lit(0.0), lambda acc, v: acc + one(v)), F.size(votes).cast("double"))


def flat_form(nodes: DataFrame, ratio: bool = True) -> DataFrame:
    """(tree, slot, attr, split, left, right, score): roots hold slots 0 .. T-1, inner nodes follow; a negative child is leaf -child, counted from 1.

    A tree that is a single leaf has a root without attribute (-1) whose left child is its leaf.
    """
    from pyspark.sql import Window

    inner = nodes.filter("attr >= 0 or node = 1")
    rank = F.row_number().over(Window.orderBy(F.when(F.col("node") == 1, 0).otherwise(1), "tree", "node")) - 1  # model-sized, not data-sized
    slots = inner.select("tree", "node", rank.alias("slot"))
    leaf_no = F.row_number().over(Window.orderBy("tree", "node"))
    p0, p1 = F.col("probs")[0], F.col("probs")[1]
    score = F.coalesce(F.try_divide(p1, p0 + p1), F.lit(0.0)) if ratio else p1
    leaves = nodes.filter("attr < 0").select("tree", "node", leaf_no.alias("leaf"), score.alias("score"))
    target = slots.select("tree", "node", F.col("slot").alias("target")).filter("node > 1").unionByName(leaves.select("tree", "node", (-F.col("leaf")).alias("target")))
    side = lambda c: target.select("tree", F.col("node").alias(c), F.col("target").alias(f"{c}_to"))
    own = leaves.filter("node = 1").select("tree", F.col("leaf").alias("own_leaf"), F.col("score").alias("own_score"))
    flat = inner.join(slots, ["tree", "node"]).join(side("left"), ["tree", "left"], "left").join(side("right"), ["tree", "right"], "left").join(own, "tree", "left")
    body = flat.select("tree", "slot", "attr", "split", F.when(F.col("attr") < 0, -F.col("own_leaf")).otherwise(F.col("left_to")).alias("left"), F.when(F.col("attr") < 0, -F.col("own_leaf")).otherwise(F.col("right_to")).alias("right"), F.lit(None).cast("double").alias("score"))
    tips = leaves.select("tree", (-F.col("leaf")).alias("slot"), F.lit(-1).alias("attr"), F.lit(None).cast("double").alias("split"), F.lit(None).cast("int").alias("left"), F.lit(None).cast("int").alias("right"), "score")
    return body.unionByName(tips)


def flat_metadata(nodes: DataFrame) -> DataFrame:
    """(n_trees, max_depth, n_classes): a single-leaf tree counts as depth 1."""
    return nodes.agg(F.count_distinct("tree").alias("n_trees"), F.greatest(F.max("depth"), F.lit(1)).alias("max_depth"), F.lit(2).alias("n_classes"))


@dataclass
class ForestModel:
    """Nodes, names and measures of a fitted forest; fallback: class shares where there were no attributes."""

    nodes: DataFrame
    params: ForestParams
    classes: int
    names: list[str] = field(default_factory=list)
    rows: int = 0
    fallback: list[float] | None = None
    measures: dict[str, float] = field(default_factory=dict)
    class_names: list[str] = field(default_factory=list)

    def distribution(self, frame: DataFrame, vector: str = "features") -> DataFrame:
        """frame and distribution: the votes summed over the trees, then normalised."""
        if self.fallback is not None:
            return frame.withColumn("distribution", F.array(*map(F.lit, self.fallback)))
        voted = tree_votes(frame, self.nodes, vector, self.classes)
        return voted.withColumn("distribution", normalised(vote_sum(F.col("votes"), self.classes))).drop("votes")

    def classify(self, frame: DataFrame, vector: str = "features") -> DataFrame:
        return self.distribution(frame, vector).withColumn("prediction", classified(F.col("distribution")))

    def flat_predict(self, frame: DataFrame, vector: str = "features", ratio: bool = True) -> DataFrame:
        return tree_votes(frame, self.nodes, vector, self.classes).withColumn("score", flat_score(F.col("votes"), ratio)).drop("votes")

    def measure(self, name: str) -> float:
        return self.measures.get(name, math.nan)

    def describe(self) -> str:
        oob = self.measure("out_of_bag_error")
        k = resolve(self.params, len(self.names) + 1).features if self.names else 0
        lines = [f"Random forest of {self.params.trees} trees ({self.params.criterion}), {self.classes} classes, {len(self.names)} attributes, each node considering {k}."]
        lines.append(f"Maximum depth: {self.params.max_depth or 'unlimited'}.")
        lines.append(f"Out-of-bag error: {100 * oob:.4f} %" if not math.isnan(oob) else "Out-of-bag error: not measured")
        for kind, title in (("importance", "Importance"), ("dropout_importance", "Dropout importance"), ("interaction", "Interaction"), ("dropout_interaction", "Dropout interaction")):
            found = {name.removeprefix(f"{kind}:"): v for name, v in self.measures.items() if name.startswith(f"{kind}:")}
            lines += [f"{title} of {name}: {100 * v:.4f} %" for name, v in sorted(found.items(), key=lambda x: (-x[1], x[0]))]
        return "\n".join(lines)

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"params": asdict(self.params), "classes": self.classes, "names": self.names, "rows": self.rows, "fallback": self.fallback, "measures": self.measures, "class_names": self.class_names}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        return ForestModel(spark.read.parquet(f"{path}/nodes"), ForestParams(**meta["params"]), meta["classes"], meta["names"], meta["rows"], meta["fallback"], meta["measures"], meta["class_names"])


def indexed(frame: DataFrame) -> tuple[DataFrame, int]:
    """frame with dense ids 0 .. n-1 (kept if they are so already), and n."""
    from arbora.operators.ranking import global_rank

    n, low, high, distinct = frame.agg(F.count(F.lit(1)), F.min("instance_id"), F.max("instance_id"), F.count_distinct("instance_id")).first()
    if n and (low, high) == (0, n - 1) and distinct == n:
        return frame, n
    if distinct != n:
        raise ValueError("instance_id must be unique")
    return global_rank(frame, ["instance_id"], "_rank").withColumn("instance_id", F.col("_rank") - 1).drop("_rank"), n


def fit(frame: DataFrame, params: ForestParams | None = None, names: list[str] | None = None) -> tuple[ForestModel, DataFrame]:
    """A forest over an instance table, and its bag (tree, instance_id, n_draws)."""
    from arbora.plans.lineage import cut

    params = params or ForestParams()
    frame, classes = feats.validated(frame, params.criterion)
    frame, n = indexed(frame)
    spark = frame.sparkSession
    attributes = (frame.agg(F.max(F.size("features"))).first()[0] or 0) if n else 0
    empty = spark.createDataFrame([], "tree int, node long, depth int, attr int, split double, left long, right long, n_rows long, probs array<double>").select(*NODE_COLUMNS)
    if not n or not attributes:
        shares = {r.label: r.prior for r in feats.class_priors(frame).collect()}  # one row a class
        return ForestModel(empty, params, classes, names or [], n, [float(shares.get(k) or 0.0) for k in range(classes)]), spark.createDataFrame([], "tree int, instance_id long, n_draws long")
    r = resolve(params, attributes + 1)
    bag = cut(bagging.bootstrap(spark, n, r.trees, params.seed, params.bag_percent))
    subset = bagging.tree_attributes(spark, r.trees, attributes, r.tree_features, params.seed) if r.tree_features < attributes else None
    nodes = grow(frame, bag, r, classes, attributes, subset)
    model = ForestModel(nodes, params, classes, names or [f"a{i}" for i in range(attributes)], n)
    model.measures.update(_measured(frame, model, bag, subset, r.trees, attributes))
    return model, bag


def _measured(frame: DataFrame, model: ForestModel, bag: DataFrame, subset: DataFrame | None, trees: int, attributes: int) -> dict[str, float]:
    """The measures that the parameters ask for, by name; those without a value are left out."""
    from arbora.operators import evaluate
    from arbora.plans.lineage import cut

    params, names, nodes, classes = model.params, model.names, model.nodes, model.classes
    found: dict[str, float | None] = {}
    if not (params.out_of_bag or params.importances or params.dropout_importances or params.interactions or params.dropout_interactions):
        return {}
    scores = cut(evaluate.tree_scores(frame, nodes, classes))
    if params.out_of_bag or params.importances:
        found["out_of_bag_error"] = evaluate.oob_error(frame, scores, bag, classes).first().error
    if params.importances:
        found |= {f"importance:{names[r.attr]}": r.importance for r in evaluate.permutation_importance(frame, nodes, bag, classes, attributes, params.seed).collect()}
    if params.interactions and attributes > 1:
        found |= {f"interaction:{names[r.attr_i]}:{names[r.attr_j]}": r.interaction for r in evaluate.permutation_interaction(frame, nodes, bag, classes, attributes, params.seed).collect()}
    if subset is None:
        subset = bagging.tree_attributes(frame.sparkSession, trees, attributes, attributes, params.seed)
    if params.dropout_importances:
        found |= {f"dropout_importance:{names[r.attr]}": r.importance for r in evaluate.dropout_importance(frame, scores, bag, subset, classes, attributes).collect()}
    if params.dropout_interactions and attributes > 1:
        found |= {f"dropout_interaction:{names[r.attr_i]}:{names[r.attr_j]}": r.interaction for r in evaluate.dropout_interaction(frame, scores, bag, subset, classes, attributes).collect()}
    return {k: v for k, v in found.items() if v is not None}


__all__ = ["ForestModel", "argmax", "fit", "flat_form", "flat_metadata", "flat_score", "leaf_slot", "packed", "tree_sizes", "tree_votes", "vote_sum"]
