"""Neighbour windows around hits, stitching of overlapping texts, and selection under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rewrite import bind


def islands(hits: DataFrame, radius: int = 2) -> DataFrame:
    """Merged windows (doc_id, lo, hi, best) of hits (doc_id, idx, relevance): windows that touch are one; the best hit owns it."""
    w = hits.withColumns({"lo": F.greatest(F.col("idx") - radius, F.lit(0)), "hi": F.col("idx") + radius})
    line = Window.partitionBy("doc_id").orderBy("lo", "idx")
    reach = F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1))
    runs = w.withColumn("_new", F.when(F.col("lo") <= reach + 1, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("_new").over(line))
    best = F.max(F.struct(F.col("relevance"), (-F.col("idx")).alias("first"))).alias("b")
    return runs.groupBy("doc_id", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), best).select("doc_id", "lo", "hi", (-F.col("b.first")).alias("best"), F.col("b.relevance").alias("relevance"))


def stitch(texts: Column, most: int = 250) -> Column:
    """Ordered texts as one: the longest suffix of what there is that begins the next text isn't repeated."""

    def add(acc: Column, x: Column) -> Column:
        tail = acc["tail"]
        sizes = F.sequence(F.least(F.lit(most), F.length(tail), F.length(x)), F.lit(0), F.lit(-1))
        fit = F.coalesce(F.get(F.filter(sizes, lambda n: F.right(tail, n) == F.left(x, n)), 0), F.lit(0))
        fresh = F.when((tail == "") | (x == ""), x).otherwise(bind(fit, lambda n: F.when(n > 0, F.substring(x, n + 1, F.length(x))).otherwise(F.concat(F.lit(" "), x))))
        return bind(fresh, lambda new: F.struct(F.concat(acc["out"], F.array(new)).alias("out"), F.right(F.concat(tail, new), F.lit(most)).alias("tail")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("tail"))
    return F.aggregate(texts, start, add, lambda acc: F.array_join(acc["out"], ""))


def budget_stop(rows: DataFrame, group: str, order: list, cost: str, budget: int) -> DataFrame:
    """The prefix of each group that fits: the first row that doesn't ends it."""
    line = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(line)).where(F.col("spent") <= budget)


def _walk(items: Column, budget: int, keep_first: bool) -> Column:
    empty = F.filter(items, lambda x: F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["spent"] + x["cost"] <= budget
        if keep_first:
            fits = fits | (F.size(acc["kept"]) == 0)
        return F.struct((acc["spent"] + F.when(fits, x["cost"]).otherwise(0)).alias("spent"), F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(items, F.struct(F.lit(0).cast("long").alias("spent"), empty.alias("kept")), step, lambda acc: acc["kept"])


def budget_skip(rows: DataFrame, group: str, order: str, cost: str, budget: int, newest_first: bool = False, keep_first: bool = False) -> DataFrame:
    """(group, order): rows taken in order, leaving out what doesn't fit but trying on; ``keep_first`` takes the first whatever it costs."""
    item = F.struct(F.col(order).alias("at"), F.col(cost).cast("long").alias("cost"))
    items = F.sort_array(F.collect_list(item), asc=not newest_first)
    per = rows.groupBy(group).agg(items.alias("items"))
    return per.select(group, F.explode(_walk(F.col("items"), budget, keep_first)).alias("k")).select(group, F.col("k.at").alias(order), "k.cost")
