"""Repeated items in lists, numbered or in a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rewrite import trim_ws

# A list line, and the fewest words of an item that can be a repeat.
ITEM = r"^\s*(\d+[.)]|[-*•])\s+(.+)$"
LEAST_WORDS = 3


def dedup_items(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) without list lines that repeat an item of their run; a blank or other line ends a run."""
    l = rows.select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n", "line"))
    body = F.regexp_extract("line", ITEM, 2)
    bare = trim_ws(F.regexp_replace(trim_ws(F.lower(body)), r"[.,;:!?]+$", ""))
    order = Window.partitionBy("key").orderBy("n")
    l = l.withColumns({"item": F.when(F.col("line").rlike(ITEM), bare), "run": F.sum(F.when(F.col("line").rlike(ITEM), 0).otherwise(1)).over(order)})
    long = F.size(F.split("item", r"\s+")) >= LEAST_WORDS
    nth = F.row_number().over(Window.partitionBy("key", "run", "item").orderBy("n"))
    kept = l.withColumn("nth", nth).where(F.col("item").isNull() | ~long | (F.col("nth") == 1))
    return kept.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("a")).select("key", F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("text"))


def dedup_inline(t: Column) -> Column:
    """Sentences with two commas or more, without parts of three words or more that came before in them."""
    parts = F.regexp_extract_all(t, F.lit(r"[^.!?]*[.!?]+\s*|[^.!?]+$"), F.lit(0))
    bare = lambda x: trim_ws(F.regexp_replace(F.lower(x), r"[.!?]+\s*$", ""))

    def one(s: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            again = (F.size(F.split(bare(p), r"\s+")) >= LEAST_WORDS) & F.exists(acc, lambda a: bare(a) == bare(p))
            return F.when(again, acc).otherwise(F.concat(acc, F.array(p)))

        kept = F.aggregate(F.split(s, ","), F.array().cast("array<string>"), step)
        return F.when(F.regexp_count(s, F.lit(",")) >= 2, F.array_join(kept, ",")).otherwise(s)

    return F.array_join(F.transform(parts, one), "")
