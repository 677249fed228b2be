"""A library's own tables: contents entries, images, notes, corrections, turns, and writes that touch several of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rewrite import trim_ws
from . import keyed
from .units import fill_pages

# How turns are recalled, the share of a page that may be stripped, and when an image is furniture.
RECALL_K, RECALL_LEXICAL, RECALL_TURNS = 60.0, 25, 4
MOST_STRIPPED = 0.30
FURNITURE_PAGES = 6
PAGE_LABEL = r"(?i)\bpage\b\s*(\d+)"


def in_order(rows: DataFrame, key: str, order: list) -> DataFrame:
    """``place`` of each row in its key's order, from 1: the order of a scan, as a column."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def contents_of(toc: DataFrame) -> DataFrame:
    """Contents entries (doc_id, play_order, title, offset) by play order."""
    return in_order(toc, "doc_id", ["play_order", "offset", "title"])


def images_of(images: DataFrame) -> DataFrame:
    """Images (doc_id, image_id, ordinal) in the order they came in."""
    return in_order(images, "doc_id", ["ordinal", "image_id"])


def notes_of(notes: DataFrame) -> DataFrame:
    """Notes (doc_id, note_id, created, ...), the newest first."""
    return in_order(notes, "doc_id", [F.col("created").desc(), "note_id"])


def add_notes(notes: DataFrame, new: DataFrame, plain: DataFrame) -> DataFrame:
    """Notes and new ones (note_id, doc_id, kind, start, end, body, created), which get the text they mark and what is around it.

    ``plain``: (doc_id, plain_text). A note of a document without text marks nothing.
    """
    a = T.anchor(F.col("plain_text"), F.col("start"), F.col("end"))
    told = new.join(plain, "doc_id", "left").withColumn("_a", F.when(F.col("plain_text").isNotNull(), a))
    told = told.select(*new.columns, F.col("_a.text").alias("anchor_text"), F.col("_a.before").alias("context_before"), F.col("_a.after").alias("context_after"))
    return notes.unionByName(told, allowMissingColumns=True)


def edit_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes with the bodies and times of ``changes`` (note_id, body, updated): a body may become null."""
    c = changes.select("note_id", F.col("body").alias("_body"), F.col("updated").alias("_updated"), F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))
    return notes.join(c, "note_id", "left").withColumns({"body": F.when(hit, F.col("_body")).otherwise(F.col("body")), "updated": F.when(hit, F.col("_updated")).otherwise(F.col("updated"))}).select(*notes.columns)


def put_images(images: DataFrame, new: DataFrame) -> DataFrame:
    """Images by id: a new one takes the place of the old."""
    return keyed.upsert(images, new, ["image_id"])


def add_turns(turns: DataFrame, new: DataFrame) -> DataFrame:
    """Turns and new ones, which follow the last of their conversation."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    order = Window.partitionBy("conv_id").orderBy("n")
    told = new.join(last, "conv_id", "left").withColumn("turn", F.coalesce("_last", F.lit(-1)) + F.row_number().over(order))
    return turns.unionByName(told.select(*[F.col(c).cast(turns.schema[c].dataType).alias(c) for c in turns.columns]))


def clear_turns(turns: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns that are left, (conv_id, removed) for each conversation cleared, 0 for one that has none)."""
    ids = gone.select("conv_id").distinct()
    removed = ids.join(turns, "conv_id", "left").groupBy("conv_id").agg(F.count("turn").alias("removed"))
    return turns.join(ids, "conv_id", "left_anti"), removed


def tried_corrections(corrections: DataFrame) -> DataFrame:
    """(doc_id, originals): what has been tried of each document, accepted or not, sorted."""
    return corrections.groupBy("doc_id").agg(F.array_sort(F.collect_set("original")).alias("originals"))


def corrections_of(corrections: DataFrame) -> DataFrame:
    """(doc_id, original, corrected) of the corrections that change something, once each."""
    return corrections.where(F.col("corrected").isNotNull() & (F.col("corrected") != F.col("original"))).groupBy("doc_id", "original").agg(F.min("corrected").alias("corrected"))


def apply_structure(toc: DataFrame, units: DataFrame, docs: DataFrame, new_toc: DataFrame, promotions: DataFrame, skips: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(toc, units, docs) after a document's structure was detected anew.

    The contents of documents in ``skips`` (doc_id, skip_seq, skip_offset, skip_source) give way to ``new_toc``, once per title and offset;
    units in ``promotions`` (doc_id, sequence, level, title_length) become headings of a higher revision; documents take their new skips.
    """
    once = keyed.first_of(new_toc, ["doc_id", "title", "offset"], ["play_order"])
    toc = keyed.replace_groups(toc, once.select(*toc.columns), "doc_id", skips)
    p = promotions.select("doc_id", "sequence", F.col("level").alias("_level"), F.col("title_length").alias("_length"))
    hit = F.col("_level").isNotNull()
    units = units.join(p, ["doc_id", "sequence"], "left").withColumns({
        "kind": F.when(hit, "heading").otherwise(F.col("kind")), "level": F.coalesce("_level", "level"), "title_length": F.coalesce("_length", "title_length"),
        "revision": F.col("revision") + hit.cast("int"), "source_tier": F.when(hit, "redetect_structure").otherwise(F.col("source_tier")),
    }).select(*units.columns)
    s = skips.select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("skip_seq", "skip_offset", "skip_source")], F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))
    docs = docs.join(s, "doc_id", "left").withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("skip_seq", "skip_offset", "skip_source")}).select(*docs.columns)
    return toc, units, docs


def replace_pages(units: DataFrame, pages: DataFrame) -> DataFrame:
    """Units (doc_id, sequence, kind, text, page) with those between a page's break and the next one replaced by the paragraphs of ``pages`` (doc_id, page, new_text)."""
    new = pages.join(units.where("kind = 'page_break'").select("doc_id", "page", F.col("sequence").alias("_break")), ["doc_id", "page"])
    gone = units.where("kind <> 'page_break'").join(new.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    parts = F.filter(F.transform(F.split("new_text", "\n\n"), trim_ws), lambda x: x != "")
    rows = new.select("doc_id", "page", "_break", F.posexplode(parts).alias("n", "text"))
    rows = rows.select("doc_id", (F.col("_break") + 1 + F.col("n")).alias("sequence"), F.lit("prose").alias("kind"), "text", "page")
    return keyed.delete(units, gone, ["doc_id", "sequence"]).select("doc_id", "sequence", "kind", "text", "page").unionByName(rows)


def pages_from_labels(toc: DataFrame) -> DataFrame:
    """Dense (doc_id, page, start) from entries whose titles say ``page N``; missing pages repeat the one before.

    A number that two entries give, or a page 0, ends what is known: later pages repeat what was known up to there.
    """
    n = F.regexp_extract("title", PAGE_LABEL, 1)
    rows = toc.where((F.col("offset") >= 0) & (n != "") & (F.length(n) <= 9)).select("doc_id", n.cast("long").alias("page"), "play_order", "offset")
    per = rows.groupBy("doc_id", "page").agg(F.min_by("offset", "play_order").alias("start"), F.count("*").alias("_n"))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.max(F.when((F.col("_n") > 1) | (F.col("page") < 1), 1).otherwise(0)).over(before)
    told = per.withColumn("start", F.when((F.coalesce(odd, F.lit(0)) == 0) & (F.col("page") >= 1), F.col("start"))).where("page >= 1")
    return fill_pages(told.select("doc_id", "page", "start"))


def strip_ranges(text: Column, ranges: Column) -> Column:
    """The text without the half-open ranges (lo, hi); as it is where they come to more than 30 % of it."""
    total = F.aggregate(ranges, F.lit(0), lambda a, r: a + (r["hi"] - r["lo"]).cast("int"))
    n = F.length(text)

    def step(acc: Column, r: Column) -> Column:
        lo = F.least(F.greatest(r["lo"], F.lit(0)), n).cast("int")
        hi = F.least(F.greatest(r["hi"].cast("int"), lo), n)
        piece = F.when(acc["at"] < lo, F.substring(text, acc["at"] + 1, lo - acc["at"])).otherwise("")
        return F.struct(hi.alias("at"), F.concat(acc["out"], piece).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    out = F.aggregate(F.array_sort(ranges), begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, n)))
    return F.when((F.size(ranges) == 0) | (total / F.greatest(n, F.lit(1)) > MOST_STRIPPED), text).otherwise(out)


def figures(draws: DataFrame) -> DataFrame:
    """Draws (doc_id, page, width, height) but those of a size that is on ``FURNITURE_PAGES`` pages of the document or more."""
    often = draws.groupBy("doc_id", "width", "height").agg(F.count_distinct("page").alias("_pages")).where(F.col("_pages") >= FURNITURE_PAGES)
    return draws.join(often.select("doc_id", "width", "height"), ["doc_id", "width", "height"], "left_anti").select(*draws.columns)


def recall(similar: DataFrame, lexical: DataFrame, turns: DataFrame, recent: int, most: int = RECALL_TURNS) -> DataFrame:
    """(conv_id, turn, rrf, sem_rank, lex_rank): older spoken turns that bear on a conversation's question, by both rankings.

    ``similar`` and ``lexical``: (conv_id, turn, score) of the turns each ranking may offer. The newest ``recent`` spoken turns, which a prompt shows
    anyway, take no part; lexical ranks count after they are left out of the best ``RECALL_LEXICAL``. Read by turn, the result is in order.
    """
    spoken = turns.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn").distinct()
    age = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    older = spoken.withColumn("_age", age).where(F.col("_age") > recent).drop("_age")
    best = Window.partitionBy("conv_id").orderBy(F.col("score").desc(), "turn")
    sem = similar.join(older, ["conv_id", "turn"], "left_semi").withColumn("sem_rank", F.row_number().over(best)).drop("score")
    first = lexical.join(spoken, ["conv_id", "turn"], "left_semi").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= RECALL_LEXICAL)
    lex = first.join(older, ["conv_id", "turn"], "left_semi").withColumn("lex_rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("_r"))).select("conv_id", "turn", "lex_rank")
    part = lambda c: F.coalesce(1 / (F.lit(RECALL_K) + F.col(c)), F.lit(0.0))
    both = sem.join(lex, ["conv_id", "turn"], "full_outer").withColumn("rrf", part("sem_rank") + part("lex_rank"))
    order = Window.partitionBy("conv_id").orderBy(F.round("rrf", 12).desc(), "turn")
    return both.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("conv_id", "turn", "rrf", "sem_rank", "lex_rank")


def mean_pooled(tokens: Column, dimension: int) -> Column:
    """The average of a text's token vectors, of which each counts up to ``dimension`` numbers; null for no tokens."""
    zero = F.array_repeat(F.lit(0.0), dimension)
    add = lambda acc, v: F.zip_with(acc, F.slice(v, 1, dimension), lambda x, y: x + F.coalesce(y.cast("double"), F.lit(0.0)))
    total = F.aggregate(tokens, zero, lambda acc, v: F.when(v.isNull(), acc).otherwise(add(acc, v)))
    return F.when(F.size(tokens) > 0, F.transform(total, lambda x: x / F.size(tokens)))


def swap_backend(vectors: DataFrame, target: str, embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, pointer): vectors (id, vec, backend) all of the target, and which one readers use now.

    ``embedded``: (id, vec) by the target, for rows of other backends or none. Readers change over only when no row is left behind.
    """
    new = embedded.select("id", F.col("vec").alias("_vec"))
    told = vectors.join(new, "id", "left")
    due = ~F.coalesce(F.col("backend") == target, F.lit(False))
    told = told.withColumns({"vec": F.when(due, F.coalesce("_vec", "vec")).otherwise(F.col("vec")), "backend": F.when(due & F.col("_vec").isNotNull(), target).otherwise(F.col("backend"))}).select(*vectors.columns)
    left = told.agg(F.count_if(~F.coalesce(F.col("backend") == target, F.lit(False))).alias("left"))
    return told, left.select(F.when(F.col("left") == 0, target).alias("backend"), "left")


def find_chunks(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, idx, needle, spans_units): chunks that hold a needle of their document's, whatever the case; ``words``: (doc_id, needle)."""
    hit = chunks.join(words, "doc_id").where(F.contains(F.lower("text"), F.lower("needle")))
    return hit.select("doc_id", "idx", "needle", (F.col("start_sequence") != F.col("end_sequence")).alias("spans_units"))


def promote(units: DataFrame, markers: DataFrame) -> DataFrame:
    """Units with offsets whose text is a contents title's become headings: an exact title before a prefix, then the nearest; the lowest level wins.

    ``markers``: (doc_id, title, at, level).
    """
    from .structure import nearest_heading

    near = nearest_heading(markers.select("doc_id", "title", "at").distinct(), units.where("kind in ('prose', 'heading')").select("doc_id", "sequence", "text", "start"))
    told = near.join(markers, ["doc_id", "title", "at"]).groupBy("doc_id", "sequence").agg(F.min(F.struct("level", F.length("title").alias("n"))).alias("_m"))
    hit = F.col("_m").isNotNull()
    return units.join(told, ["doc_id", "sequence"], "left").withColumn("level", F.when(hit, F.col("_m.level")).otherwise(F.lit(0))).withColumn("kind", F.when(hit, "heading").otherwise(F.col("kind"))).drop("_m")


