"""Checks of generated text against its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import nearest

# Fixed value: the least similarity of a kept sentence to a source sentence.
LEAST = 0.45
NAMES = r"\b(\p{Lu}\p{L}+(?:\s+\p{Lu}\p{L}+)*)\b"


def verify(sentences: DataFrame, references: DataFrame, least: float = LEAST) -> DataFrame:
    """(id, best, kept): each sentence's (id, vec) largest cosine to a reference; 0 where none can be compared."""
    best = nearest(references, sentences.select(F.col("id").alias("query_id"), F.col("vec").alias("q_vec")), 1).groupBy("query_id").agg(F.max("score").alias("best"))
    rows = sentences.select("id").join(best, F.col("id") == F.col("query_id"), "left")
    return rows.select("id", F.coalesce("best", F.lit(0.0)).alias("best")).withColumn("kept", F.col("best") >= least)


def ungrounded_names(summary: Column, source: Column) -> Column:
    """Capitalised names of which no word of three letters or more is in the source."""
    low = F.lower(source)
    names = F.array_distinct(F.regexp_extract_all(summary, F.lit(NAMES), F.lit(1)))
    return F.filter(names, lambda n: ~F.exists(F.filter(F.split(F.lower(n), r"[^\p{L}]+"), lambda w: F.length(w) >= 3), lambda w: F.contains(low, w)))
