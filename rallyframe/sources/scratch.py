"""A folder for files between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, which all executors share; only where driver and executors are one process and the
    session names none is a folder made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: files between steps need a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
