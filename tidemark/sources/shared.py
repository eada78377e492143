"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new path in ``spark.checkpoint.dir``; only a local master may go without one and gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix=f"spark-{tag}-")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
