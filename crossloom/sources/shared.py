"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Used only by local sessions that name no checkpoint folder.
LOCAL = "file:///tmp/checkpoints"


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, as the session's spark.checkpoint.dir names it. Without one, only a local session has a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return f"{(named or LOCAL).rstrip('/')}/{what}-{uuid.uuid4().hex}"
