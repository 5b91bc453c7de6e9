"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="docsense-staging-")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode, where one machine is all, a folder of our own if it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = _own_dir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table and read back: later steps see one fixed outcome, and a lost executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/docsense/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
