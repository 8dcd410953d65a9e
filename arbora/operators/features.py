"""The instance table, its checks and its long form.

An instance table has instance_id (unique), features (array<float>), label
(0-based class) and weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def instances(df: DataFrame, features: list[str | Column] | None = None, label: str | Column | None = None, weight: str | Column | None = None, instance_id: str | Column | None = None) -> DataFrame:
    """The instance table of df. Without a label the last column is the class; negative zeros become zeros."""
    label = label if label is not None else df.columns[-1]
    if features is None:
        used = {str(x) for x in (label, weight, instance_id) if isinstance(x, str)}
        features = [c for c in df.columns if c not in used]
    col = lambda c: F.col(c) if isinstance(c, str) else c
    check_types(df.select(*[col(f).alias(f"{i}" if not isinstance(f, str) else f) for i, f in enumerate(features)]).schema)
    if not isinstance(kind := df.select(col(label)).schema[0].dataType, T.NumericType | T.BooleanType):
        raise TypeError(f"the class is not a number: {kind.simpleString()}; index_labels gives nominal classes one")
    return df.select(
        (col(instance_id) if instance_id is not None else F.monotonically_increasing_id()).cast("bigint").alias("instance_id"),
        F.array(*[(col(f).cast("float") + F.lit(0.0).cast("float")).cast("float") for f in features]).alias("features"),
        col(label).cast("int").alias("label"),
        (col(weight).cast("double") if weight is not None else F.lit(1.0)).alias("weight"),
    )


def index_labels(df: DataFrame, label: str | None = None) -> tuple[DataFrame, list[str]]:
    """df with a nominal (text or yes/no) class column as its 0-based index in sorted order, and the names; numeric classes stay."""
    label = label or df.columns[-1]
    if not isinstance(df.schema[label].dataType, T.StringType | T.BooleanType):
        return df, []
    text = F.col(label).cast("string")
    names = sorted(r[0] for r in df.select(text.alias("c")).distinct().filter("c is not null").collect())  # a row a class
    place = F.nullif(F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), text), F.lit(0)) - 1
    return df.withColumn(label, place.cast("int")), names


def check_types(schema: T.StructType) -> None:
    """Only numeric attributes are supported."""
    for found in schema.fields:
        if not isinstance(found.dataType, T.NumericType | T.BooleanType):
            raise TypeError(f"attribute {found.name} is not numeric: {found.dataType.simpleString()}")


def attribute_kinds(schema: T.StructType, label: str) -> dict[str, int]:
    """Numeric and other attributes, the class aside."""
    numeric = [isinstance(f.dataType, T.NumericType) for f in schema.fields if f.name != label]
    return {"numeric": sum(numeric), "nominal": len(numeric) - sum(numeric)}


def validation(frame: DataFrame) -> DataFrame:
    """One row: rows, rows without a label, missing values, classes, least and greatest label."""
    missing = F.exists("features", lambda x: x.isNull() | F.isnan(x))
    return frame.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("label").isNull()).alias("n_null_label"),
        F.count_if(missing).alias("n_missing"),
        F.count_distinct("label").alias("n_classes"),
        F.min("label").alias("min_label"),
        F.max("label").alias("max_label"),
    )


def validated(frame: DataFrame, criterion: str) -> tuple[DataFrame, int]:
    """frame without rows that lack a label, and its number of classes; raises where it can't be learned."""
    found = validation(frame).first()
    if found.n_missing:
        raise ValueError(f"{found.n_missing} rows have missing values, which are not supported")
    if found.min_label is not None and found.min_label < 0:
        raise ValueError("labels must be 0 or more")
    classes = (found.max_label if found.max_label is not None else 0) + 1
    if criterion == "gini" and classes > 2:
        raise ValueError("the gini criterion needs two classes")
    return frame.filter(F.col("label").isNotNull()), max(2, classes)


def long_form(frame: DataFrame) -> DataFrame:
    """(instance_id, attr, value, label, weight): a row for each instance and attribute."""
    return frame.select("instance_id", F.posexplode("features").alias("attr", "value"), "label", "weight")


def class_histogram(frame: DataFrame) -> DataFrame:
    return frame.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("weight").alias("weight"))


def class_priors(frame: DataFrame) -> DataFrame:
    """Share of the weight of each class."""
    sums = class_histogram(frame)
    whole = sums.agg(F.sum("weight").alias("whole"))  # one row
    return sums.join(F.broadcast(whole)).select("label", F.try_divide(F.col("weight"), F.col("whole")).alias("prior"))


def majority_fallback(frame: DataFrame) -> DataFrame:
    """The one-row model of a table without attributes: the most weighty class (first of equals) and its share."""
    return class_priors(frame).orderBy(F.desc("prior"), "label").limit(1)
