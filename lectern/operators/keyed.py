"""Writes by key as whole-table expressions, and small scans by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key isn't in the new ones, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones whose key isn't there."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def update(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Old rows with the columns' new values where there are any that aren't null."""
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return old.join(fresh, keys, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*old.columns)


def replace_groups(old: DataFrame, new: DataFrame, group: str, groups: DataFrame) -> DataFrame:
    """All rows of the named groups give way to the new ones."""
    return old.join(groups.select(group).distinct(), group, "left_anti").unionByName(new)


def dangling(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return rows.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def with_status(rows: DataFrame, column: str, statuses: list[str]) -> DataFrame:
    """Rows with one of the statuses; none for an empty list."""
    return rows.where(F.col(column).isin(statuses)) if statuses else rows.where(F.lit(False))


def numbered(rows: DataFrame, key: str, order: list, name: str = "place") -> DataFrame:
    """``name`` from 1 in the key's order, for keys of which a few may hold most rows: no one task sorts a key.

    Rows are dealt into ranges by key and order, and numbered in each range from the sizes of the ranges before it. The ranges are
    checkpointed, as sizes and numbers must come from the same ones. The order should tell rows apart.
    """
    ranged = cut(rows.repartitionByRange(key, *order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p", key).agg(F.count("*").alias("_n"))  # a row per range and key
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("_p").alias("_q"), F.col(key).alias("_key"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    told = ranged.join(base, (F.col("_p") == F.col("_q")) & F.col(key).eqNullSafe(F.col("_key")))
    line = F.row_number().over(Window.partitionBy("_p", key).orderBy(*order))
    return told.withColumn(name, F.col("_base") + line).select(*rows.columns, name)


def stride_sample(rows: DataFrame, order: str, most: int) -> DataFrame:
    """Every n-th row in order, n = max(1, rows div most).

    Row numbers come from ranges: rows are sorted by range partition and numbered by partition sizes, so that no one task gets all.
    The ranges are checkpointed, as sizes and numbers must come from the same ones.
    """
    ranged = cut(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["_n"] for r in ranged.groupBy("_p").agg(F.count("*").alias("_n")).collect()}  # a row per partition
    total, base, so_far = sum(sizes.values()), [], 0
    for p in sorted(sizes):
        base.append((p, so_far))
        so_far += sizes[p]
    if not total:
        return rows.limit(0)
    starts = rows.sparkSession.createDataFrame(base, "_p int, _base long")
    n = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1 + F.col("_base")
    return ranged.join(F.broadcast(starts), "_p").withColumn("_n", n).where(F.col("_n") % max(1, total // most) == 0).select(*rows.columns)


def strict_greatest(a: Column, b: Column) -> Column:
    """Null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def positions(rows: DataFrame, key: str, at: str, order: Column) -> DataFrame:
    """(key, latest, furthest): the last row's place and the largest."""
    return rows.groupBy(key).agg(F.max_by(F.col(at), order).alias("latest"), F.max(at).alias("furthest"))


def histogram(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys, kind, n, share): rows of each kind, and their share of the key's."""
    n = rows.groupBy(*keys, kind).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def same_as(rows: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(doc_id, existing_id): the smallest id of the same text; ``rows``: doc_id and keys that equal texts share, ``texts``: doc_id, text.

    Texts meet only where keys repeat, and there one copy of each text and key is kept.
    """
    first = rows.groupBy(*keys).agg(F.min("doc_id").alias("existing_id"), F.count("*").alias("_n"))
    told = rows.join(first, keys).select("doc_id", "existing_id", "_n")
    alone = told.where("_n = 1").select("doc_id", "existing_id")
    shared = told.where("_n > 1").join(texts, "doc_id")
    group = shared.groupBy("existing_id", F.xxhash64("text").alias("_x"), F.crc32(F.col("text").cast("binary")).alias("_c"))  # equal digests, yet unlike texts, part here
    apart = group.agg(F.min("doc_id").alias("_first"))
    same = shared.join(apart, (shared["existing_id"] == apart["existing_id"]) & (F.xxhash64(shared["text"]) == apart["_x"]) & (F.crc32(shared["text"].cast("binary")) == apart["_c"]))
    return alone.unionByName(same.select(shared["doc_id"], F.col("_first").alias("existing_id")))
