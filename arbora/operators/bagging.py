"""Bootstrap bags, out-of-bag rows and per-tree feature subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions.hashing import hashed


def bag_size(rows: int, percent: int) -> int:
    return rows * percent // 100


def bootstrap(spark: SparkSession, rows: int, trees: int, seed: int, percent: int = 100) -> DataFrame:
    """(tree, instance_id, n_draws): draws with replacement from ids 0 .. rows-1, exactly bag_size a tree."""
    size = bag_size(rows, percent)
    draws = spark.range(trees * size).select(F.floor(F.col("id") / size).cast("int").alias("tree"), (F.col("id") % size).alias("draw"))
    drawn = draws.select("tree", (hashed("bag", seed, F.col("tree"), F.col("draw")) % rows).alias("instance_id"))
    return drawn.groupBy("tree", "instance_id").agg(F.count(F.lit(1)).alias("n_draws"))


def bag_summary(bag: DataFrame) -> DataFrame:
    return bag.groupBy("tree").agg(F.sum("n_draws").alias("n_draws"), F.count(F.lit(1)).alias("n_distinct"))


def out_of_bag(frame: DataFrame, bag: DataFrame, trees: int) -> DataFrame:
    """(tree, instance_id) of the rows that a tree's bag lacks."""
    every = frame.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "instance_id")
    return every.join(bag.select("tree", "instance_id"), ["tree", "instance_id"], "left_anti")


def tree_attributes(spark: SparkSession, trees: int, attributes: int, subset: int, seed: int) -> DataFrame:
    """(tree, attr): each tree's random feature subset."""
    pairs = spark.range(trees * attributes).select(F.floor(F.col("id") / attributes).cast("int").alias("tree"), (F.col("id") % attributes).cast("int").alias("attr"))
    w = Window.partitionBy("tree").orderBy(hashed("subset", seed, F.col("tree"), F.col("attr")), "attr")
    return pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= subset).select("tree", "attr")
