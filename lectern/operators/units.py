"""Ordered text units of documents and the algebra of their offsets.

``plain text`` is a document's prose units joined by two line feeds, so a unit's offset is the sum
of (length + 2) over the prose units before it. Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_prose
from ..functions.rewrite import trim_ws

STEP, JOINER = 10, 2
# What makes a paragraph a heading.
CHAPTER = r"^(?i:(?:CHAPTER|BOOK|PART|VOLUME|LETTER|ACT|SCENE|CANTO)\s+(?:\d{1,3}|[IVXLCDM]{1,7}))(?:[.\s:—–-].*)?$"
NAMED = r"^(?:Epilogue|Prologue|Preface|Foreword|Introduction)\.?$"
ROMAN_TITLE = r"^[IVXLCDM]{1,7}\.\s+\S.*$"
MARKER = r"(?i)CHAPTER\s+(?:\d|[IVXLCDM])"


def is_heading(t: Column) -> Column:
    chapter = (F.length(t) <= 120) & (t.rlike(CHAPTER) | t.rlike(NAMED))
    roman = (F.length(t) <= 80) & t.rlike(ROMAN_TITLE) & ~t.rlike(r"[.;!?]$")
    return (chapter | roman) & (F.regexp_count(t, F.lit(MARKER)) < 2)


def prose_units(docs: DataFrame, sep: str = "\n\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sequence, kind, text): a unit per non-empty part; headings are told by their shape."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), sep), trim_ws), lambda x: x != "")).alias("n", "text"))
    return parts.select("doc_id", ((F.col("n") + 1) * STEP).cast("long").alias("sequence"), F.when(is_heading(F.col("text")), "heading").otherwise("prose").alias("kind"), "text")


def page_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Units of texts whose pages are parted by form feeds: a page break before each page, then its paragraphs."""
    pages = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\f")).alias("page", "body"))
    parts = F.filter(F.transform(F.split("body", "\n\n"), trim_ws), lambda x: x != "")
    rows = F.concat(F.array(F.struct(F.lit("page_break").alias("kind"), F.lit("").alias("text"))), F.transform(parts, lambda x: F.struct(F.lit("prose").alias("kind"), x.alias("text"))))
    flat = pages.select("doc_id", "page", F.posexplode(rows).alias("n", "u"))
    order = Window.partitionBy("doc_id").orderBy("page", "n")
    return flat.select("doc_id", (F.row_number().over(order) * STEP).cast("long").alias("sequence"), "u.kind", "u.text", (F.col("page") + 1).cast("long").alias("page"))


def with_offsets(units: DataFrame) -> DataFrame:
    """``start`` and ``end`` of each prose unit in the plain text; of others, where the next would start."""
    own = F.when(is_prose(F.col("kind")), F.length("text") + JOINER).otherwise(0)
    before = Window.partitionBy("doc_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(own).over(before), F.lit(0)).cast("long")
    return units.withColumn("start", start).withColumn("end", F.when(is_prose(F.col("kind")), F.col("start") + F.length("text")).otherwise(F.col("start")).cast("long"))


def plain_text(units: DataFrame) -> DataFrame:
    """(doc_id, plain_text), derived for all documents in one grouped pass."""
    rows = units.where(is_prose(F.col("kind"))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "text"))).alias("u"))
    return rows.select("doc_id", F.array_join(F.transform("u", lambda x: x["text"]), "\n\n").alias("plain_text"))


def _beside(u: DataFrame, offsets: DataFrame, before: bool) -> DataFrame:
    """Offsets with ``near``: the last unit that starts at or before each, or the first that ends past it; one window over both, so nothing is joined by range."""
    at = F.col("start") if before else F.col("end") - 1
    marks = u.select("doc_id", at.alias("at"), F.struct("sequence", "start", "end").alias("u"))
    both = offsets.distinct().select("doc_id", F.col("offset").alias("at"), F.lit(None).cast(marks.schema["u"].dataType).alias("u"), F.lit(True).alias("asks")).unionByName(marks.withColumn("asks", F.lit(False)))
    side = "asks"  # units come before the offsets that are equal to theirs
    order = [F.col("at").asc_nulls_first(), F.col(side).asc()] if before else [F.col("at").desc_nulls_last(), F.col(side).asc()]
    line = Window.partitionBy("doc_id").orderBy(*order, F.col("u.sequence").asc() if before else F.col("u.sequence").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("near", F.last("u", ignorenulls=True).over(line)).where("asks").select("doc_id", F.col("at").alias("offset"), "near")


def unit_at(units: DataFrame, offsets: DataFrame) -> DataFrame:
    """(doc_id, offset, sequence): the unit that holds each offset; null in a gap; the text's end belongs to the last unit."""
    u = with_offsets(units.where(is_prose(F.col("kind")))).where("end > start")
    last = u.groupBy("doc_id").agg(F.max(F.struct("end", "sequence")).alias("last"))
    at = _beside(u, offsets, before=True).join(last, "doc_id", "left")
    held = F.when(F.col("offset") < F.col("near.end"), F.col("near.sequence"))
    return at.select("doc_id", "offset", F.coalesce(held, F.when(F.col("offset") == F.col("last.end"), F.col("last.sequence"))).alias("sequence"))


def first_unit_after(units: DataFrame, offsets: DataFrame) -> DataFrame:
    """(doc_id, offset, sequence): the first prose unit that ends past each offset."""
    u = with_offsets(units.where(is_prose(F.col("kind")))).where("end > start")
    return _beside(u, offsets, before=False).where("near is not null").select("doc_id", "offset", F.col("near.sequence").alias("sequence"))


def page_numbers(units: DataFrame) -> DataFrame:
    """``page_no``: page breaks so far."""
    so_far = Window.partitionBy("doc_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    return units.withColumn("page_no", F.sum((F.col("kind") == "page_break").cast("long")).over(so_far))


def page_starts(units: DataFrame) -> DataFrame:
    """(doc_id, page_no, start): where each page's first prose unit starts; a page without one takes the one before it."""
    u = with_offsets(page_numbers(units))
    own = u.groupBy("doc_id", "page_no").agg(F.min(F.when(is_prose(F.col("kind")), F.col("start"))).alias("own"))
    line = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("doc_id", "page_no", F.coalesce(F.last("own", ignorenulls=True).over(line), F.lit(0)).alias("start"))


def fill_pages(known: DataFrame) -> DataFrame:
    """Dense (doc_id, page, start) from sparse rows; missing pages repeat the one before."""
    ends = known.groupBy("doc_id").agg(F.max("page").alias("most"))
    every = ends.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))).alias("page"))
    line = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return every.join(known, ["doc_id", "page"], "left").withColumn("start", F.coalesce(F.last("start", ignorenulls=True).over(line), F.lit(0)))


def playback_window(units: DataFrame, refs: DataFrame) -> DataFrame:
    """Units from the document's skip sequence up to its end sequence; a null on either side doesn't bound."""
    u = units.join(refs, "doc_id", "left")
    return u.where((F.col("sequence") >= F.coalesce("skip_seq", "sequence")) & (F.col("sequence") < F.coalesce("end_seq", F.col("sequence") + 1))).select(*units.columns)


def without_front_matter(units: DataFrame, refs: DataFrame) -> DataFrame:
    """Prose before the skip or from the end goes; other kinds always stay."""
    u = units.join(refs, "doc_id", "left")
    inside = (F.col("sequence") >= F.coalesce("skip_seq", "sequence")) & (F.col("sequence") < F.coalesce("end_seq", F.col("sequence") + 1))
    return u.where(~is_prose(F.col("kind")) | inside).select(*units.columns)


def demote_relisted(units: DataFrame, least: int = 3) -> DataFrame:
    """Headings whose title comes again later become prose, where a document has ``least`` of them: a listing, not headings."""
    title = F.lower("text")
    same = Window.partitionBy("doc_id", "kind", title)
    again = (F.col("kind") == "heading") & (F.max("sequence").over(same) > F.col("sequence"))
    marked = units.withColumn("_again", again)
    many = F.sum(F.col("_again").cast("int")).over(Window.partitionBy("doc_id")) >= least
    return marked.withColumn("kind", F.when(F.col("_again") & many, "prose").otherwise(F.col("kind"))).drop("_again")


def replace_token(units: DataFrame, original: str, corrected: str) -> DataFrame:
    """Whole-word replacement in prose; ``changed`` marks the rows that need new sentences, ``times`` how often it was made.

    Where units have them, a changed one's ``revision`` rises by one and its ``source_tier`` is ``token_replace``.
    """
    quoted = r"\b" + "".join("\\" + c if not c.isalnum() else c for c in original) + r"\b"
    new = F.regexp_replace("text", quoted, corrected.replace("\\", "\\\\").replace("$", "\\$"))
    times = F.when(is_prose(F.col("kind")), F.regexp_count("text", F.lit(quoted))).otherwise(0)
    out = units.withColumn("times", times).withColumn("changed", F.col("times") > 0).withColumn("text", F.when(F.col("changed"), new).otherwise(F.col("text")))
    if "revision" in units.columns:
        out = out.withColumn("revision", F.col("revision") + F.col("changed").cast("int"))
    if "source_tier" in units.columns:
        out = out.withColumn("source_tier", F.when(F.col("changed"), "token_replace").otherwise(F.col("source_tier")))
    return out


def replace_token_everywhere(units: DataFrame, sentences: DataFrame, notes: DataFrame, original: str, corrected: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, sentences, notes): the token replaced in units, changed units cut into sentences anew, and the notes' marked texts follow.

    sentences: (doc_id, sequence, n, text); notes: with ``anchor_text``.
    """
    from ..functions.text import sentences as cut_sentences

    new = replace_token(units, original, corrected)
    due = new.where("changed").select("doc_id", "sequence", F.posexplode(cut_sentences(F.col("text"))).alias("n", "text"))
    kept = sentences.join(new.where("changed").select("doc_id", "sequence"), ["doc_id", "sequence"], "left_anti")
    as_unit = notes.withColumnRenamed("text", "_text") if "text" in notes.columns else notes
    marked = replace_token(as_unit.withColumn("text", F.col("anchor_text")).withColumn("_kind", F.col("kind")).withColumn("kind", F.lit("prose")), original, corrected)
    marked = marked.withColumn("anchor_text", F.col("text")).withColumn("kind", F.col("_kind")).drop("text", "times", "changed", "_kind")
    marked = marked.withColumnRenamed("_text", "text") if "text" in notes.columns else marked
    return new, kept.unionByName(due), marked.select(*notes.columns)


def skip_references(docs: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, skip_seq, end_seq) of documents (doc_id, skip_seq, end_seq); a reference to a unit that isn't there is null."""
    at = units.select("doc_id", "sequence")
    skip, end = (at.withColumnRenamed("sequence", c) for c in ("skip_seq", "end_seq"))
    told = docs.join(skip.withColumn("_skip", F.lit(True)), ["doc_id", "skip_seq"], "left").join(end.withColumn("_end", F.lit(True)), ["doc_id", "end_seq"], "left")
    return told.select("doc_id", F.when(F.col("_skip"), F.col("skip_seq")).alias("skip_seq"), F.when(F.col("_end"), F.col("end_seq")).alias("end_seq"))
