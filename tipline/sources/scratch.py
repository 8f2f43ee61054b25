"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where nothing is named, a local session gets one of its own (tests); on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tipline-')}")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_dir(spark: SparkSession, kind: str) -> str:
    """A name for a new folder there."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Written as Parquet and read back: lineage ends there, and what depends on the place of rows in partitions stays as it is."""
    path = new_dir(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
