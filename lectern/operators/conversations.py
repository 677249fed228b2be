"""Conversation memory: latest turns, pairing, tiers, recall, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sentences kept of a pair by its age, and clip lengths of the plain summary.
TIERS = [4, 2]
QUESTION_CHARS, ANSWER_CHARS = 120, 200


def latest(turns: DataFrame, n: int, roles: list[str] | None = None) -> DataFrame:
    """The newest n turns of each conversation; ``place`` counts them oldest first."""
    t = turns.where(F.col("role").isin(roles)) if roles else turns
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    t = t.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= n)
    return t.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))


def pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, user_turn, assistant_turn): an assistant turn pairs with the user turn just before it among those two roles."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.where(F.col("role").isin("user", "assistant")).withColumns({"was": F.lag("role").over(order), "was_turn": F.lag("turn").over(order)})
    return t.where("role = 'assistant' and was = 'user'").select("conv_id", F.col("was_turn").alias("user_turn"), F.col("turn").alias("assistant_turn"))


def tiers(paired: DataFrame) -> DataFrame:
    """``sentences``: how many a pair's summary keeps, by newest first."""
    age = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("assistant_turn").desc()))
    kept = F.when(age == 1, TIERS[0]).when(age == 2, TIERS[1]).otherwise(1)
    return paired.withColumn("sentences", kept)


def fallback_summary(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Q: "), F.substring(question, 1, QUESTION_CHARS), F.lit(" A: "), F.substring(answer, 1, ANSWER_CHARS))


def stats(turns: DataFrame) -> DataFrame:
    """Turns of each conversation, by role."""
    by = {f"n_{r}": F.count_if(F.col("role") == r) for r in ("user", "assistant", "system")}
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), *[c.alias(n) for n, c in by.items()], F.max("turn").alias("last_turn"))


def without_recent(turns: DataFrame, n: int) -> DataFrame:
    """Turns older than the newest n."""
    recent = latest(turns, n).select("conv_id", "turn")
    return turns.join(recent, ["conv_id", "turn"], "left_anti")


def needs_summary(turns: DataFrame, keep: int = 6, slack: int = 2) -> DataFrame:
    """(conv_id, covers): conversations with more than keep + slack turns, and the turn a summary would reach."""
    per = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("turn")).alias("t"))
    return per.where(F.col("n") > keep + slack).select("conv_id", F.get(F.col("t"), (F.col("n") - keep - 1).cast("int")).alias("covers"))


def as_of(rows: DataFrame, anchors: DataFrame, by: str, at: str) -> DataFrame:
    """Each row with ``anchor``: the largest anchor at or before it in its group; null offsets get none.

    One window over the union of both, so nothing is joined by range.
    """
    both = rows.withColumn("_anchor", F.lit(False)).unionByName(anchors.select(by, at).withColumn("_anchor", F.lit(True)), allowMissingColumns=True)
    line = Window.partitionBy(by).orderBy(F.col(at).asc_nulls_first(), F.col("_anchor").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = F.last(F.when(F.col("_anchor"), F.col(at)), ignorenulls=True).over(line)
    return both.withColumn("anchor", F.when(F.col(at).isNotNull(), near)).where("not _anchor").drop("_anchor")


def cited(turns: DataFrame, most: int = 3, floor: float = 0.020) -> DataFrame:
    """(conv_id, turn, offset, relevance): the best sources an assistant turn's JSON lists, once per offset."""
    schema = "array<struct<offset:bigint,relevance:double>>"
    each = turns.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.from_json("chunks", schema)).alias("c")).select("conv_id", "turn", "c.offset", "c.relevance")
    once = each.where(F.col("relevance") >= floor).groupBy("conv_id", "turn", "offset").agg(F.max("relevance").alias("relevance"))
    order = Window.partitionBy("conv_id", "turn").orderBy(F.col("relevance").desc(), "offset")
    return once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
