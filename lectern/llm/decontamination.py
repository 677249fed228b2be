"""Benchmark decontamination by a prefix-filtered join, in DataFrame functions only.

An item's windows are its runs of ``window`` words (a shorter item is one window). A window
holds shingles of three words; a text that contains the window contains each of them. Shingles are
ordered by how often they occur in the documents, and the necessary prefix for full containment is
a window's rarest one. Rolling shingles of the documents are joined to these prefixes; a pair
whose window would begin before or end after the document is dropped by position and length, and the
rest are verified word by word. Documents are neither shuffled nor copied by the join: windows
are broadcast in blocks of bounded size, and each document row carries its own words.

Nulls: a null text has no words; a null item id marks words but counts as no item; a null doc id
stays null. Repeated rows and ties: one result each. Empty tables: documents without hits, or no rows. Very
short items: windows of one or two words. Very long texts: read whole, in one row. Other columns are ignored by
``contamination`` and kept by ``clean``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path
from .words import gram, rolling_grams, words

#: Windows broadcast at a time.
BLOCK_WINDOWS = 500_000


def windows_of(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item_id, win, len, off, k, gram): a row per distinct window of an item and shingle in it."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.lit(window), F.size("w"))
    starts = items.select("item_id", "w", size.alias("len"), F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("s"))
    wins = starts.select("item_id", F.slice("w", F.col("s") + 1, F.col("len")).alias("win"), "len").distinct()
    k = F.least(F.lit(shingle), F.col("len"))
    offs = wins.select("*", k.alias("k"), F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("off"))
    of = reduce(lambda c, n: F.when(F.col("k") == n, gram(F.col("win"), F.col("off"), n)).otherwise(c), range(1, shingle + 1), F.lit(None).cast("long"))
    return offs.withColumn("gram", of)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, keys: list[Column] | None = None) -> DataFrame:
    """(uid, key columns, n_words, item_id, start, len): a row per occurrence of a window, and one without for each document."""
    keys = [F.col("doc_id")] if keys is None else keys
    grams = cut(windows_of(benchmark, window, shingle))
    sizes = sorted(r.k for r in grams.select("k").distinct().collect()) or [shingle]
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), *keys, words(F.col("text")).alias("words"))
    blocks = max(1, -(-grams.select("item_id", "win").distinct().count() // BLOCK_WINDOWS))
    if blocks > 1:  # rows are numbered once, whatever the table comes from
        path = fresh_path(docs.sparkSession, "decontamination")
        texts.write.parquet(path)
        texts = docs.sparkSession.read.parquet(path)

    def block(df: DataFrame, b: int) -> DataFrame:
        return df if blocks == 1 else df.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b)

    found = []
    for b in range(blocks):
        mine = block(grams, b)
        seen = rolling_grams(texts.select("words"), sizes).select("gram")
        often = seen.join(F.broadcast(mine.select("gram").distinct()), "gram").groupBy("gram").agg(F.count("*").alias("n"))
        often = F.broadcast(cut(often))  # a row per shingle of the block at most
        rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "off", "k")
        prefix = mine.join(often, "gram", "left").groupBy("item_id", "win", "len").agg(F.min(rarity).alias("p"))
        prefix = prefix.select("item_id", "win", "len", F.col("p.gram").alias("p_gram"), F.col("p.k").alias("p_k"), F.col("p.off").alias("off"))
        at = rolling_grams(texts, sizes)
        start = F.col("pos") - F.col("off")
        fits = (start >= 0) & (start + F.col("len") <= F.size("words"))
        same = (F.col("gram") == F.col("p_gram")) & fits & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win"))
        joined = at.join(F.broadcast(prefix), same, "left")
        first = (F.coalesce("pos", F.lit(0)) == 0) & (F.col("k") == sizes[0]) if b == 0 else F.lit(False)
        kept = joined.where(F.col("win").isNotNull() | first)
        found.append(kept.select("uid", *[c for c in texts.columns if c not in ("uid", "words")], F.size("words").cast("long").alias("n_words"), "item_id", F.when(F.col("win").isNotNull(), start).alias("start"), "len"))
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, keys: list[Column] | None = None) -> DataFrame:
    """Per document: key columns, n_words, n_hit, n_items, items (ids as strings, sorted)."""
    found = hits(docs, benchmark, window, shingle, keys)
    names = [c for c in found.columns if c not in ("uid", "n_words", "item_id", "start", "len")]
    before = Window.partitionBy("uid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    covered = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    rows = found.withColumn("covered", F.when(F.col("start").isNotNull(), covered).otherwise(0))
    per = rows.groupBy("uid", *names, "n_words").agg(F.sum("covered").cast("long").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return per.select(*names, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window of an item; columns as they were."""
    body = F.xxhash64("text")
    marked = contamination(docs, benchmark, keys=[F.col("doc_id").alias("_id"), body.alias("_body")]).where("n_hit > 0").select("_id", "_body").distinct()
    return docs.join(marked, docs["doc_id"].eqNullSafe(marked["_id"]) & (body == marked["_body"]), "left_anti")
