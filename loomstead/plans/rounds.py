"""Rounds of fixpoint operators: what a round leaves is written to the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only where all run on this machine, as in tests."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomstead-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
