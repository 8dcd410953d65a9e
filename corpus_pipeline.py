"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller
writes it as Parquet and rereads it as the next stage's docs. All but the last
return the columns of documents; the last adds rate and copies.

Defined cases, for all stages: further columns, whatever their names, go
through unchanged (but for rate and copies, which the last stage sets); rows
with a null id or text are kept by the quality and decontamination stages,
null texts are copies of each other for the exact stage and of nothing for the
near stage, and the last stage gives them a rate without letting them count in
the totals; repeated rows are copies; an empty table gives an empty table with
the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import decontaminate, exact_dedup, mixing, ngram_join, quality
from arbora.llm.common import settled, table, without, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity classifier doesn't reject."""
    return quality.passing(docs, quality.trusted_labels(table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity of 0.8 or more)."""
    return ngram_join.one_of_each(docs, width=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    docs = settled(docs)
    hit = decontaminate.hits(docs, table(spark, sf_dir, "benchmark")).filter(F.size("items") > 0).select("row")
    return without(docs, written(hit, "contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rates that meet the target weights."""
    return mixing.weighted(docs, mixing.label_domains(table(spark, sf_dir, "labels")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs


#: The perplexity and mixing stages cannot be expressed in SQL.
ORACLE_SQL = None
