"""Cutting lineage in the shared folder that the cluster names."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder of spark.checkpoint.dir; a temporary one only where none is set and all runs on one machine."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + os.path.join(tempfile.gettempdir(), f"tessera-checkpoints-{os.getuid()}"))
    return df.checkpoint()
