"""Orders: stable argsort, global ranks without a single-task sort, permutations, folds, argmax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.hashing import hashed
from arbora.plans.lineage import cut


def global_rank(df: DataFrame, order: list[Column | str], out: str = "rank") -> DataFrame:
    """df with the 1-based position of each row in a total order.

    A range partitioning sorts in parallel; the positions within partitions
    are then shifted by the sizes of those before, one number a partition.
    """
    ordered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ordered.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + at + 1).drop("_at", "_part", "_before")


def rank_within(df: DataFrame, key: str, order: list[Column | str], out: str = "rank") -> DataFrame:
    """df with the 1-based position of each row among those of its key; few keys, and no task sorts a whole one."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col(key).alias("_key"), (F.sum("_n").over(Window.orderBy(key)) - F.col("_n")).alias("_others"))  # a row a key
    ranked = global_rank(df, [key, *order], out)
    return ranked.join(F.broadcast(before), F.col(key).eqNullSafe(F.col("_key"))).withColumn(out, F.col(out) - F.col("_others")).drop("_key", "_others")


def sums_before(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """df with the sum of a value over the rows of the same keys that come before: by ranges of the order, with carried sums."""
    ordered = cut(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    parts = ordered.groupBy(*keys, "_part").agg(F.sum(value).alias("_own"))
    across = Window.partitionBy(*keys).orderBy("_part") if keys else Window.orderBy("_part")  # a row a key and range
    parts = parts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_of"), (F.sum("_own").over(across) - F.col("_own")).alias("_carried"))
    within = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = ordered.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return local.join(parts, same).withColumn(out, F.col(out) + F.col("_carried")).drop("_part", "_of", "_carried", *[f"_{k}" for k in keys])


def argsort(long: DataFrame) -> DataFrame:
    """(instance_id, attr, value, rank): stable positions by value within each attribute."""
    return rank_within(long.select("instance_id", "attr", "value"), "attr", ["value", "instance_id"]).select("instance_id", "attr", "value", "rank")


def permutation(n: int, seed: int, spark) -> DataFrame:
    """(i, position): an unbiased permutation of 0 .. n-1 by hashes."""
    ids = spark.range(n).select(F.col("id").alias("i"))
    return global_rank(ids.withColumn("h", hashed("perm", seed, F.col("i"))), ["h", "i"], "position").select("i", (F.col("position") - 1).alias("position"))


def slots_of(frame: DataFrame) -> DataFrame:
    """(instance_id, slot): the rows in the order of their ids; written, to be used for several permutations."""
    return cut(global_rank(frame.select("instance_id"), ["instance_id"], "slot"))


def scrambled(frame: DataFrame, attr: int, seed: int, slots: DataFrame | None = None) -> DataFrame:
    """frame with the values of one attribute permuted among its rows. slots: slots_of(frame), if known."""
    ids = frame.select("instance_id", F.element_at("features", attr + 1).alias("v"), hashed("scramble", seed, attr, F.col("instance_id")).alias("h"))
    slots = slots_of(frame) if slots is None else slots
    source = global_rank(ids, ["h", "instance_id"], "slot").select("slot", F.col("v").alias("new_value"))
    moved = slots.join(source, "slot").select("instance_id", "new_value")
    value = F.transform("features", lambda x, i: F.when(i == attr, F.col("new_value")).otherwise(x))
    return frame.join(moved, "instance_id").withColumn("features", value).drop("new_value")


def scrambled_values(frame: DataFrame, attributes: int, seed: int) -> DataFrame:
    """(instance_id, moved): the value that `scrambled` puts into the row for each attribute; one sort serves all of them."""
    each = F.explode(F.sequence(F.lit(0), F.lit(attributes - 1))).alias("attr")
    long = frame.select("instance_id", "features", each).select("instance_id", "attr", F.get("features", F.col("attr")).alias("v"))
    drawn = long.withColumn("h", hashed("scramble", seed, F.col("attr"), F.col("instance_id")))
    source = rank_within(drawn, "attr", ["h", "instance_id"], "slot").select("attr", "slot", "v")
    moved = source.join(slots_of(frame), "slot").groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("attr", "v"))).alias("m"))  # a value an attribute
    return moved.select("instance_id", F.col("m.v").alias("moved"))


def stratified_folds(frame: DataFrame, folds: int, seed: int) -> DataFrame:
    """(instance_id, label, fold): rows dealt out in hash order within each class."""
    rows = frame.select("instance_id", "label", hashed("fold", seed, F.col("instance_id")).alias("_h"))
    return rank_within(rows, "label", ["_h", "instance_id"], "_place").select("instance_id", "label", ((F.col("_place") - 1) % folds).cast("int").alias("fold"))


def node_attr_order(nodes: DataFrame, attributes: int, seed: int) -> DataFrame:
    """(tree, node, attr, rank): the order in which a node examines the attributes."""
    attrs = F.explode(F.sequence(F.lit(0), F.lit(attributes - 1))).alias("attr")
    w = Window.partitionBy("tree", "node").orderBy(hashed("attr", seed, F.col("tree"), F.col("node"), F.col("attr")), "attr")
    return nodes.select("tree", "node", attrs).withColumn("rank", F.row_number().over(w))
