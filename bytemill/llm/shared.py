"""Tables kept in the folder that driver and executors share, named by spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's own place in the shared folder; it may be deleted when the application has ended.

    Where spark.checkpoint.dir is unset a local master gets a temporary folder, which goes when Python ends, and a cluster an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(made := tempfile.mkdtemp(prefix="bytemill-"))
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = sc.getCheckpointDir()
    return f"{found.rstrip('/')}/bytemill-{sc.applicationId}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet to the shared folder: cuts the lineage and survives lost executors."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
