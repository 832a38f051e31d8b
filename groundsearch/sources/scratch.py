"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where that is unset a new one is set on a single machine; a cluster refuses."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='groundsearch-')}")
        found = sc._jsc.sc().getCheckpointDir().get()
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as a Parquet table in the shared folder and read back: it is computed once, and what follows plans over a plain scan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
