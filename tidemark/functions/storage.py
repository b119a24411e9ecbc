"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names.

    Where it is unset, a temporary folder will do only if everything runs in this process.
    """
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        home = at.get() if at.isDefined() else None
    if not home:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        home = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{home.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written as Parquet in the shared folder and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
