"""Scoring of streams: a fitted forest is an expression, so the batch plan runs on a stream unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.model import ForestModel


def scored_stream(stream: DataFrame, model: ForestModel, vector: str = "features") -> DataFrame:
    """stream with distribution and prediction; stateless, for any output mode."""
    return model.classify(stream, vector)


def windowed_votes(scored: DataFrame, time_col: str, width: str, delay: str) -> DataFrame:
    """(window, prediction, n): predictions by event-time window, late rows accepted up to delay."""
    return scored.withWatermark(time_col, delay).groupBy(F.window(time_col, width), "prediction").agg(F.count(F.lit(1)).alias("n"))
