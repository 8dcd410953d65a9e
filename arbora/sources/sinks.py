"""Result sinks: tab-separated text and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(results: DataFrame, path: str, sep: str = ",") -> None:
    results.write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)


def tab_separated(results: DataFrame, most: int = 1000) -> str:
    """A small result table (`most` rows at the utmost) as text."""
    rows = results.limit(most).collect()
    return "\n".join(["\t".join(results.columns), *("\t".join("" if v is None else str(v) for v in r) for r in rows)])
