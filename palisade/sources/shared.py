"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session that names none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="palisade-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:/") else f"file://{found}"


def new_folder(spark: SparkSession, tag: str) -> str:
    """The URI of a folder there that nobody else uses."""
    return f"{shared_dir(spark)}/palisade-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a table there, for what is read more than once: made once, and safe from lost executors."""
    folder = new_folder(df.sparkSession, tag)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
