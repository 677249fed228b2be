"""Files that all executors see: where results are cut from their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a temporary one only where executors are threads of the driver."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not told and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    told = told or tempfile.mkdtemp(prefix="lectern-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(told)
    return f"{told.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in files that outlive any executor."""
    scratch(df.sparkSession, "cut")
    return df.checkpoint(eager=True)
