"""What goes to a model: located chunks, reading positions, sections under budgets, checks of where an answer comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from .keyed import numbered

# Sections of a prompt with their shares of tokens, and the tail shown of what was read.
SECTIONS = {"system": 200, "history": 400, "passages": 1800, "recalled": 300, "question": 200}
TAIL_CHARS, SENTENCE_CHARS = 320, 25


def located(chunks: DataFrame, offsets: DataFrame) -> DataFrame:
    """Chunks (doc_id, idx, start_sequence, start_intra) with ``at``: their place in the document's plain text."""
    o = offsets.select("doc_id", F.col("sequence").alias("start_sequence"), F.col("start").alias("unit_start"))
    return chunks.join(o, ["doc_id", "start_sequence"], "left").withColumn("at", F.col("unit_start") + F.col("start_intra")).drop("unit_start")


def first_sentence_of_hits(hits: DataFrame, sentences: DataFrame) -> DataFrame:
    """One hit per unit (its best), with the unit's first sentence. hits: (doc_id, sequence, score); sentences: (doc_id, sequence, ordinal)."""
    first = sentences.groupBy("doc_id", "sequence").agg(F.min("ordinal").alias("ordinal"))
    best = hits.groupBy("doc_id", "sequence").agg(F.max("score").alias("score"))
    return best.join(first, ["doc_id", "sequence"])


def position_block(plain: Column, furthest: Column) -> Column:
    """(percent, tail) of a text read up to an offset."""
    n = F.length(plain)
    at = F.least(F.greatest(furthest, F.lit(0)), n)
    return F.struct(F.when(n > 0, F.round(100 * at / n).cast("int")).otherwise(0).alias("percent"), F.substring(plain, F.greatest(at - TAIL_CHARS, F.lit(0)) + 1, F.least(at, F.lit(TAIL_CHARS))).alias("tail"))


def spoilers(sentences: DataFrame, hits: DataFrame, furthest: DataFrame) -> DataFrame:
    """(answer_id, n, first, spoils): where the earliest of a sentence's hits lies, and whether that is past what was read.

    sentences: (answer_id, n, text), short ones left out; hits: (answer_id, n, doc_id, at); furthest: (doc_id, furthest).
    """
    s = sentences.where(F.length("text") >= SENTENCE_CHARS).select("answer_id", "n")
    first = hits.groupBy("answer_id", "n", "doc_id").agg(F.min("at").alias("first"))
    j = s.join(first, ["answer_id", "n"]).join(furthest, "doc_id", "left")
    return j.select("answer_id", "n", "first", (F.col("first") > F.coalesce("furthest", F.lit(0))).alias("spoils"))


def assemble(rows: DataFrame, budgets: dict[str, int] = SECTIONS) -> DataFrame:
    """(prompt_id, section, kept, dropped, tokens): items (prompt_id, section, n, text) in order while they fit; what doesn't fit is passed over."""
    budget = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]), F.col("section")), F.lit(0))
    item = F.struct("n", token_estimate(F.col("text")).alias("cost"))
    per = rows.groupBy("prompt_id", "section").agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("budget", budget)
    start = F.struct(F.lit(0).alias("kept"), F.lit(0).alias("tokens"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["tokens"] + x["cost"] <= F.col("budget")
        return F.struct((acc["kept"] + fits.cast("int")).alias("kept"), (acc["tokens"] + F.when(fits, x["cost"]).otherwise(0)).alias("tokens"))

    out = per.withColumn("r", F.aggregate("items", start, step))
    return out.select("prompt_id", "section", "r.kept", (F.size("items") - F.col("r.kept")).alias("dropped"), "r.tokens")


def work_order(jobs: DataFrame) -> DataFrame:
    """``place`` in a queue of (doc_id, lane, added): embedding before trees, then by arrival; a document's repeated job once.

    Places count within a lane.
    """
    once = jobs.groupBy("doc_id", "lane").agg(F.min("added").alias("added")).withColumn("lane_no", F.when(F.col("lane") == "embed", 0).otherwise(1))
    return numbered(once, "lane", ["added", "doc_id"])


def look_ahead(segments: DataFrame, at: int, most: int = 50) -> DataFrame:
    """The next ``most`` segments of each document from a place that have words to speak."""
    order = Window.partitionBy("doc_id").orderBy("n")
    s = segments.where((F.col("n") >= at) & F.col("text").rlike(r"[\p{L}\p{N}]"))
    return s.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
