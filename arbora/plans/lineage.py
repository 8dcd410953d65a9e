"""Cutting the lineage of iterative plans through the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed: stored in spark.checkpoint.dir.

    Where that is unset, a session on one machine (local master) uses a
    temporary folder; a cluster must name one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(found or f"{tempfile.gettempdir()}/checkpoints")
    return df.checkpoint()
