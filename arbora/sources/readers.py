"""Data set readers: Parquet, CSV and ARFF (plain or gzip), and file lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ATTRIBUTE = re.compile(r"^@attribute\s+('(?:[^'\\]|\\.)*'|\"[^\"]*\"|\S+)\s+(.+)$", re.I)


def arff_schema(header: list[str]) -> list[tuple[str, str, list[str]]]:
    """(name, kind, values) of the attributes in an ARFF header."""
    out = []
    for line in header:
        m = _ATTRIBUTE.match(line.strip())
        if m:
            name, kind = m[1].strip("'\""), m[2].strip()
            if kind.startswith("{"):
                out.append((name, "nominal", [v.strip().strip("'\"") for v in kind.strip("{} ").split(",")]))
            else:
                out.append((name, "numeric" if kind.split()[0].lower() in ("numeric", "real", "integer") else "string", []))
    return out


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """An ARFF file through Spark's text and CSV readers; nominal values become their index, ? becomes null.

    Only the header, up to @data, is read on the driver.
    """
    text = spark.read.text(path)
    header = []
    for row in text.select("value").toLocalIterator():
        if row.value.strip().lower().startswith("@data"):
            break
        header.append(row.value)
    names = arff_schema(header)
    rows = text.filter(~F.ltrim("value").startswith("%") & ~F.ltrim("value").startswith("@") & (F.trim("value") != "")).select("value")
    parts = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))), {"nullValue": "?", "quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    parsed = rows.select(parts.alias("r"))
    out = []
    for i, (name, kind, values) in enumerate(names):
        c = F.col(f"r.c{i}")
        if kind == "nominal":
            c = F.nullif(F.array_position(F.array(*map(F.lit, values)), c), F.lit(0)).cast("int") - 1
        elif kind == "numeric":
            c = c.cast("double")
        out.append(c.alias(name))
    return parsed.select(*out)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A data set by the suffix of its path; the last column is the class unless the caller says otherwise."""
    plain = path.removesuffix(".gz")
    if plain.endswith(".arff"):
        return read_arff(spark, path)
    if plain.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    if plain.endswith(".json"):
        return spark.read.json(path)
    return spark.read.parquet(path)


def matching_files(spark: SparkSession, place: str, suffix: str) -> list[str]:
    """Files of a folder with a suffix (not of its subfolders), a single file, or the files that a list file names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(path).isDirectory():
        names = [s.getPath().toString() for s in fs.listStatus(path) if s.isFile()]
        return sorted(n for n in names if n.endswith(suffix))
    if place.endswith(suffix):
        return [place]
    lines = [r.value.strip() for r in spark.read.text(place).collect()]  # a list that a person wrote
    return [x if x.endswith(suffix) else x + suffix for x in lines if x]
