"""Instance tables made from the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators.features import instances

ATTRIBUTES = 4
NAMES = ["totalprice", "month", "day", "priority"]

_PRICE = "o_totalprice"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_frame(spark: SparkSession, sf_dir: str, classes: int = 2) -> DataFrame:
    """Orders: price, month, day, priority; class P or not, or F, O, P."""
    o = read(spark, sf_dir, "orders")
    label = (F.col("o_orderstatus") == "P").cast("int") if classes == 2 else F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2)
    columns = [F.col(_PRICE), F.month("o_orderdate"), F.dayofmonth("o_orderdate"), F.substring("o_orderpriority", 1, 1).cast("float")]
    return instances(o, columns, label, None, "o_orderkey")


def events_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: value, hour, day, user; class purchase or not."""
    e = read(spark, sf_dir, "events")
    return instances(e, [F.col("value"), F.hour("ts"), F.dayofmonth("ts"), F.col("user_id")], (F.col("event_type") == "purchase").cast("int"), None, "event_id")


def vectors_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings: 64 attributes, 10 classes."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("instance_id"), F.col("embedding").cast("array<float>").alias("features"), "label", F.lit(1.0).alias("weight"))


def price_is_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with un-narrowed features, as scoring takes them."""
    o = read(spark, sf_dir, "orders")
    frame = orders_frame(spark, sf_dir)
    raw = o.select(F.col("o_orderkey").alias("instance_id"), F.array(F.col(_PRICE).cast("double"), F.month("o_orderdate").cast("double"), F.dayofmonth("o_orderdate").cast("double"), F.substring("o_orderpriority", 1, 1).cast("double")).alias("raw"))
    return frame.join(raw, "instance_id")


ORDERS_SQL = """SELECT o_orderkey AS instance_id,
  [CAST(o_totalprice AS FLOAT), CAST(month(o_orderdate) AS FLOAT), CAST(day(o_orderdate) AS FLOAT), CAST(substr(o_orderpriority, 1, 1) AS FLOAT)] AS features,
  [CAST(o_totalprice AS DOUBLE), CAST(month(o_orderdate) AS DOUBLE), CAST(day(o_orderdate) AS DOUBLE), CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)] AS raw,
  CAST(o_orderstatus = 'P' AS INTEGER) AS label, 1.0::DOUBLE AS weight FROM orders"""
ORDERS3_SQL = ORDERS_SQL.replace("CAST(o_orderstatus = 'P' AS INTEGER)", "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END")
EVENTS_SQL = """SELECT event_id AS instance_id,
  [CAST(value AS FLOAT), CAST(hour(ts) AS FLOAT), CAST(day(ts) AS FLOAT), CAST(user_id AS FLOAT)] AS features,
  CAST(event_type = 'purchase' AS INTEGER) AS label, 1.0::DOUBLE AS weight FROM events"""

#: A small forest over the orders table: (tree, node, depth, attr, split, left, right, n_rows, p0, p1).
FIXED = [
    (0, 1, 0, 0, 150000.5, 2, 3, 10, None, None),
    (0, 2, 1, -1, None, None, None, 6, 0.5, 0.25),
    (0, 3, 1, 1, 6.5, 6, 7, 4, None, None),
    (0, 6, 2, -1, None, None, None, 3, 0.125, 0.75),
    (0, 7, 2, -1, None, None, None, 1, 2.0, 0.5),
    (1, 1, 0, -1, None, None, None, 9, 0.75, 0.5),
    (2, 1, 0, 2, 15.5, 2, 3, 12, None, None),
    (2, 2, 1, 3, 2.5, 4, 5, 7, None, None),
    (2, 3, 1, -1, None, None, None, 5, 0.25, 1.5),
    (2, 4, 2, -1, None, None, None, 4, 1.0, 0.0),
    (2, 5, 2, -1, None, None, None, 3, 0.375, 0.625),
]
#: Attributes that each fixed tree knows.
FIXED_SUBSET = [(0, 0), (0, 1), (1, 2), (2, 2), (2, 3)]


def fixed_nodes(spark: SparkSession) -> DataFrame:
    rows = [(*r[:8], None if r[8] is None else [r[8], r[9]]) for r in FIXED]
    return spark.createDataFrame(rows, "tree int, node long, depth int, attr int, split double, left long, right long, n_rows long, probs array<double>")


def fixed_subset(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXED_SUBSET, "tree int, attr int")


def _value(x) -> str:
    return "NULL" if x is None else repr(x)


FIXED_SQL = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_value(x) for x in r) + ")" for r in FIXED) + ") v(tree, node, depth, attr, split, lft, rgt, n_rows, p0, p1)"
FIXED_SUBSET_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({t}, {a})" for t, a in FIXED_SUBSET) + ") v(tree, attr)"
