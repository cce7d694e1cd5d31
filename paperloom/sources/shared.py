"""Folders that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, on one machine only, below the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/paperloom-checkpoints"
    return f"{base}/run-{uuid.uuid4().hex}"
