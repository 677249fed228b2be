"""A bounded sample of labelled documents, for fitting."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import decoded, fold_of


def sampled_features(docs: DataFrame, labels: DataFrame, label: str, featurise: Callable, value_type: str, sample_rows: int, folds: int = 5, held_fold: int = 0):
    """[(label, features)] of at most ``sample_rows`` ids whose crc32 fold isn't held out.

    The ids are the first by a hash, so the sample is the same each time and blind to order. Only
    the sampled ids are broadcast. A repeated id counts once. ``featurise``: text -> list.
    """
    of = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    of = of.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_fold))
    of = of.groupBy("doc_id").agg(F.max("label").alias("label"))
    of = of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(F.broadcast(of), "doc_id")

    def run(batches):
        for b in batches:
            out = [featurise(t) for t in decoded(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32() if value_type == "int" else pa.float64()))], ["doc_id", "label", "x"])

    rows = texts.select("doc_id", "label", "text").mapInArrow(run, f"doc_id long, label int, x array<{value_type}>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("r")).select("doc_id", "r.label", "r.x").toArrow().sort_by("doc_id")
    return rows.column("label").to_numpy(), rows.column("x").combine_chunks()
