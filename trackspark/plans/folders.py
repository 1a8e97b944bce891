"""Where intermediate files go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set a temporary folder becomes the latter, but only if all runs in this one process.
    """
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if conf:
        return conf
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="trackspark-"))
    return sc.getCheckpointDir()


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, for what is needed several times."""
    folder = work_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
