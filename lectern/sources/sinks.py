"""Exports: a document's notes and conversation as Markdown, vectors as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.conversations import as_of
from ..operators.keyed import stride_sample


def conversation_markdown(turns: DataFrame) -> DataFrame:
    """(conv_id, markdown): a heading and a block per turn, in order."""
    who = F.when(F.col("role") == "user", "**You:** ").when(F.col("role") == "assistant", "**Answer:** ").otherwise("**Note:** ")
    block = F.struct("turn", F.concat(who, F.trim(F.coalesce("text", F.lit("")))).alias("b"))
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("t"))
    return per.select("conv_id", F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("t", lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("markdown"))


def annotations_markdown(docs: DataFrame, notes: DataFrame, turns: DataFrame) -> DataFrame:
    """(doc_id, markdown) from (doc_id, title), (doc_id, kind, start, body, quote) and (doc_id, offset, role, text).

    Bookmarks first, then notes by offset, each followed by the turns whose nearest preceding note it is.
    """
    near = as_of(turns, notes.select("doc_id", F.col("start").alias("offset")).distinct(), "doc_id", "offset")
    n = notes.select("doc_id", F.struct((F.col("kind") != "bookmark").alias("later"), F.col("start").alias("at"), F.lit(0).alias("sub"), F.concat(F.lit("## "), F.initcap("kind"), F.lit("\n\n> "), F.coalesce("quote", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("b")).alias("x"))
    t = near.select("doc_id", F.struct(F.lit(True).alias("later"), F.coalesce("anchor", F.lit(0)).cast("long").alias("at"), F.lit(1).alias("sub"), F.concat(F.lit("**"), F.col("role"), F.lit(":** "), F.col("text")).alias("b")).alias("x"))
    n = n.withColumn("x", F.struct("x.later", F.col("x.at").cast("long").alias("at"), "x.sub", "x.b"))
    body = n.unionByName(t).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n\n").alias("body"))
    return docs.join(body, "doc_id", "left").select("doc_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("markdown"))


def write_text(rows: DataFrame, column: str, path: str) -> None:
    rows.select(column).write.mode("overwrite").text(path, lineSep="\n\f\n")


def write_vectors(vectors: DataFrame, path: str, most: int = 1000) -> None:
    """A stride sample of (id, vec), rounded to four places, as JSON lines."""
    v = stride_sample(vectors, "id", most)
    v.withColumn("vec", F.transform("vec", lambda x: F.round(x, 4))).write.mode("overwrite").json(path)
