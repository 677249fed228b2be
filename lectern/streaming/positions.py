"""Reading positions as a stream: the latest place, and the furthest that never goes back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def merge(known: DataFrame | None, batch: DataFrame) -> DataFrame:
    """(key, updated, latest, furthest) after a batch of (key, updated, at)."""
    new = batch.groupBy("key").agg(F.max("updated").alias("updated"), F.max_by("at", "updated").alias("latest"), F.max("at").alias("furthest"))
    if known is None:
        return new
    both = known.unionByName(new)
    return both.groupBy("key").agg(F.max("updated").alias("updated"), F.max_by("latest", "updated").alias("latest"), F.max("furthest").alias("furthest"))


def track(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the table at ``path`` up to date; each batch writes a new version, so a repeated batch changes nothing."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        known = read_version(spark, path, n - 1) if n else None
        merge(known, df).write.mode("overwrite").parquet(f"{path}/v={n}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_version(spark: SparkSession, path: str, n: int) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/v={n}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
