"""Detectors over lines, pages and titles: furniture, running headers, contents, licence bounds, headings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.predicates import is_long_caps, is_mixed_case
from ..functions.rewrite import bind, trim_ws

# Patterns by which a contents title is classified, in order.
BODY_TITLES = [
    r"^chapter\s+[ivxlcdm0-9]+", r"^letter\s+[ivxlcdm0-9]+", r"^book\s+[ivxlcdm0-9]+", r"^part\s+[ivxlcdm0-9]+", r"^volume\s+[ivxlcdm0-9]+",
    r"^canto\s+[ivxlcdm0-9]+", r"^act\s+[ivxlcdm0-9]+", r"^scene\s+[ivxlcdm0-9]+", r"^[ivxlcdm]+(?:\.|—|–|-|:|\s|$)", r"^\d+(?:\.|—|–|-|:|\s|$)",
    r"^(preface|foreword|introduction|prologue|epilogue|etymology|extracts|afterword|interlude|postscript)\b",
]
PUBLISHING_TITLES = [
    r"\btranscriber'?s?\s+note", r"\beditor'?s?\s+note", r"\bnote\s+(on|about)\s+the\s+text", r"\babout\s+(this|the)\s+(edition|text)",
    r"\bcolophon\b", r"\bimprint\b", r"\bpublisher'?s?\s+note", r"\bproject\s+gutenberg\s+(license|trademark)",
    r"^(back\s*cover|front\s*cover|the\s+cover)$", r"^(about\s+the\s+author|about\s+the\s+publisher)$",
    r"^(acknowledg(e)?ments?|dedication|copyright|colophon)\b", r"^(index|glossary|bibliography|works\s+cited|references)$",
    r"^table\s+of\s+contents$", r"^list\s+of\s+(figures|tables|illustrations|sidebars|abbreviations)$",
]
LICENSE_START = r"(?im)^\s*\*\s*\*\s*\*\s*START\s+OF\s+(?:THE\s+|THIS\s+)?PROJECT\s+GUTENBERG\s+(?:E-?BOOK|ETEXT|EBOOK\s*™?).*?\*\s*\*\s*\*\s*$"
LICENSE_END = r"(?im)^\s*\*\s*\*\s*\*\s*END\s+OF\s+(?:THE\s+|THIS\s+)?PROJECT\s+GUTENBERG\s+(?:E-?BOOK|ETEXT|EBOOK\s*™?).*?\*\s*\*\s*\*\s*$"
BYLINE_END = r"(?im)^\s*End\s+of\s+(?:the\s+|this\s+)?Project\s+Gutenberg(?:['’]s|\s*™)?\b.*$"
# Thresholds of the page check.
FEW_CHARS, CAPS_TOKENS, MIXED_TOKENS, LONG_WORDS, LONG_WORD_CHARS = 50, 3, 3, 9.0, 100
SEED_WEIGHTS = {"font": 0.30, "bold": 0.15, "caps": 0.15, "gap": 0.15, "indent": 0.15, "shape": 0.10}


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, text), lines from 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line", "text"))


def word_count(t: Column) -> Column:
    return F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))


def furniture(page_lines: DataFrame, band: int = 2, max_words: int = 8, least_pages: int = 6) -> DataFrame:
    """(group, page, line): margin lines to drop. ``page_lines``: (grp, page, line, text).

    Lone page numbers always go. A signature or number stamp on ``least_pages`` pages goes, but for the first
    line of a signature that is words alone. Short lines in the bands only.
    """
    edge = Window.partitionBy("grp", "page")
    l = page_lines.withColumns({"up": F.row_number().over(edge.orderBy("line")), "down": F.row_number().over(edge.orderBy(F.col("line").desc()))})
    l = l.where((F.col("up") <= band) | (F.col("down") <= band)).withColumns({"sig": T.page_signature(F.col("text")), "num": T.numeric_anchor(F.col("text")), "lone": T.is_lone_page_number(F.col("text"))})
    short = l.where(word_count(F.col("text")) <= max_words)
    keys = short.select("grp", "page", F.explode(F.array("sig", "num")).alias("key")).where("key is not null and key <> ''").distinct()
    often = keys.groupBy("grp", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages).select("grp", "key")
    by_sig = often.withColumnRenamed("key", "sig").withColumn("by_sig", F.lit(True))
    by_num = often.withColumnRenamed("key", "num").withColumn("by_num", F.lit(True))
    told = l.join(short.select("grp", "page", "line").withColumn("short", F.lit(True)), ["grp", "page", "line"], "left").join(by_sig, ["grp", "sig"], "left").join(by_num, ["grp", "num"], "left")
    hit = F.coalesce("short", F.lit(False)) & (F.coalesce("by_sig", F.lit(False)) | F.coalesce("by_num", F.lit(False)))
    title = F.coalesce("by_sig", F.lit(False)) & ~F.coalesce("by_num", F.lit(False)) & ~F.contains("sig", F.lit("#"))
    told = told.withColumns({"hit": hit & ~F.col("lone"), "title": title})
    # the first line of a title stays; it is looked for among titles alone, and by aggregation, so that no key is sorted
    first = told.where("hit and title").groupBy("grp", "sig").agg(F.min(F.struct("page", "line")).alias("first"))
    told = told.join(first, ["grp", "sig"], "left")
    stays = F.col("title") & (F.col("page") == F.col("first.page")) & (F.col("line") == F.col("first.line"))
    return told.where(F.col("lone") | (F.col("hit") & ~F.coalesce(stays, F.lit(False)))).select("grp", "page", "line")


def running_headers(candidates: DataFrame, least: int = 3, window: int = 5, neighbours: int = 2) -> DataFrame:
    """Candidates (grp, page, zone, form) that repeat, and on enough other pages nearby."""
    c = candidates.distinct()
    key = Window.partitionBy("grp", "zone", "form")
    near = F.count("*").over(key.orderBy("page").rangeBetween(-window, window)) - 1
    return c.withColumns({"times": F.count("*").over(key), "near": near}).where((F.col("times") >= least) & (F.col("near") >= neighbours)).select("grp", "page", "zone", "form")


def classify_title(t: Column) -> Column:
    """body, publishing, title or unknown."""
    s = trim_ws(t)
    low = F.lower(s)
    any_ = lambda ps: reduce(lambda a, p: a | low.rlike(p), ps, F.lit(False))
    letters, caps = F.regexp_count(s, F.lit(r"\p{L}")), F.regexp_count(s, F.lit(r"\p{Lu}"))
    block = (F.length(s) <= 80) & (letters > 0) & (caps >= 0.6 * letters)
    return F.when(s == "", "unknown").when(any_(BODY_TITLES), "body").when(any_(PUBLISHING_TITLES), "publishing").when(block | low.isin("contents", "table of contents"), "title").otherwise("unknown")


def page_flags(t: Column) -> Column:
    """(chars, words, caps, mixed, avg_word, mode) of a page's text: whether and how it should be read again."""

    def told(words: Column) -> Column:
        caps, mixed = F.size(F.filter(words, is_long_caps)), F.size(F.filter(words, is_mixed_case))
        avg = F.when(F.size(words) > 0, F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / F.size(words)).otherwise(0.0)
        return F.struct(F.size(words).alias("words"), caps.alias("caps"), mixed.alias("mixed"), avg.alias("avg_word"))

    def flags(x: Column) -> Column:
        n = F.length(t)
        fused = (x["caps"] >= CAPS_TOKENS) | (x["mixed"] >= MIXED_TOKENS) | ((n >= LONG_WORD_CHARS) & (x["avg_word"] > LONG_WORDS))
        mode = F.when(n < FEW_CHARS, "full").when(fused, "fusion").otherwise("none")
        return F.struct(n.alias("chars"), x["words"].alias("words"), x["caps"].alias("caps"), x["mixed"].alias("mixed"), x["avg_word"].alias("avg_word"), mode.alias("mode"))

    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    return bind(bind(words, told), flags)  # the text is split once


def merge_tiers(first: Column, second: Column, mode: Column) -> Column:
    """Which reading of a page to keep: never one that loses 30 % of the text; else by mode."""
    a, b = F.length(first), F.length(second)
    words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    better = F.when(b < 0.7 * a, F.lit(False)).when(mode == "full", (a < 50) & (b >= 500)).when(mode == "fusion", words(second) >= 1.25 * words(first)).otherwise(F.lit(False))
    return F.when(better, second).otherwise(first)


def license_bounds(t: Column) -> Column:
    """(begin, end): where content starts after the licence's first marker and stops before its last, as offsets; without markers the whole text.

    A line that ends the book without stars counts if it comes at most 3000 characters before the last marker, or, without
    that marker, in the last 15 % of the text. Markers in the wrong order count for nothing.
    """
    start = F.regexp_substr(t, F.lit(LICENSE_START))
    last = lambda p: F.try_element_at(F.regexp_extract_all(t, F.lit(p), F.lit(0)), F.lit(-1))
    place = lambda x: F.length(t) - F.instr(F.reverse(t), F.reverse(x)) + 1 - F.length(x)  # noqa: E731  the last one
    n = F.length(t)

    def ends(x: Column) -> Column:
        near = x["star"].isNull() & (x["line"] * 100 > n * 85) | (x["line"] < x["star"]) & (x["star"] - x["line"] <= 3000)
        return F.when(F.coalesce(near, F.lit(False)), x["line"]).otherwise(x["star"])

    pair = F.get(F.transform(F.array(F.struct(last(LICENSE_END).alias("s"), last(BYLINE_END).alias("l"))), lambda x: F.struct(place(x["s"]).alias("star"), place(x["l"]).alias("line"))), 0)

    def told(x: Column) -> Column:
        marker = F.instr(t, start) - 1 + F.length(start)
        wrong = F.coalesce(x <= marker, F.lit(False))
        begin = marker + F.length(F.regexp_extract(F.substring(t, marker + 1, n), r"(?U)^(\s*)", 1))
        before = F.substring(t, F.lit(1), x)
        end = F.length(F.regexp_replace(before, r"(?U)\s+$", ""))
        return F.struct(F.when(start.isNotNull() & ~wrong & (begin < n), begin).otherwise(0).alias("begin"), F.when(x.isNotNull() & ~wrong & (end > 0), end).otherwise(n).alias("end"))

    return bind(bind(pair, ends), told)


def dot_leader_runs(page_lines: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, first, last, n): runs of ``least`` or more consecutive dot-leader lines."""
    hit = page_lines.where(F.col("text").rlike(T.DOT_LEADER))
    order = Window.partitionBy("doc_id").orderBy("line")
    runs = hit.withColumn("run", F.col("line") - F.row_number().over(order))
    return runs.groupBy("doc_id", "run").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("run")


def strip_number_runs(page_lines: DataFrame, least: int = 3) -> DataFrame:
    """Lines that aren't in a run of ``least`` rows ending in a page number."""
    row = r"(?i)^\s*\S.*\S(?:[ \t]{2,}|\t)(\d{1,4}|[ivxlcdm]{1,8})[ \t]*$"
    order = Window.partitionBy("doc_id").orderBy("line")
    l = page_lines.withColumns({"is_row": F.col("text").rlike(row), "blank": trim_ws(F.col("text")) == ""})
    l = l.withColumn("run", F.sum(F.when(~F.col("is_row") & ~F.col("blank"), 1).otherwise(0)).over(order))
    n = F.sum(F.col("is_row").cast("int")).over(Window.partitionBy("doc_id", "run"))
    return l.withColumn("rows", n).where(~(F.col("is_row") & (F.col("rows") >= least))).select("doc_id", "line", "text")


def nearest_heading(titles: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, title, at, sequence): the heading for each contents entry: an exact title before a prefix, then the nearest."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\s:]+", " "))
    # the first word is an equi-key, so that the join isn't by condition alone
    t = titles.withColumn("k", norm(F.col("title"))).withColumn("w", F.substring_index("k", " ", 1))
    h = headings.withColumn("hk", norm(F.col("text"))).withColumn("w", F.substring_index("hk", " ", 1))
    both = t.join(h, ["doc_id", "w"]).where(F.startswith("hk", F.col("k"))).withColumn("exact", F.col("hk") == F.col("k"))
    order = Window.partitionBy("doc_id", "title", "at").orderBy(F.col("exact").desc(), F.abs(F.col("start") - F.col("at")), "sequence")
    return both.withColumn("r", F.row_number().over(order)).where("r = 1").select("doc_id", "title", "at", "sequence", "exact")


def mostly_increasing(entries: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, share, ok): share of page numbers (in order ``n``) not under the one before."""
    was = F.lag("page").over(Window.partitionBy("doc_id").orderBy("n"))
    e = entries.withColumn("was", was).where("was is not null")
    return e.groupBy("doc_id").agg(F.avg((F.col("page") >= F.col("was")).cast("double")).alias("share")).withColumn("ok", F.col("share") >= least)


def body_font(page_lines: DataFrame) -> DataFrame:
    """(doc_id, body_size): the commonest font size, to half points, of lines that aren't blank; the larger of equals."""
    l = page_lines.where(trim_ws(F.col("text")) != "").withColumn("size", F.round(F.col("font_size") * 2) / 2)
    return l.groupBy("doc_id", "size").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max(F.struct("n", "size")).alias("m")).select("doc_id", F.col("m.size").alias("body_size"))


def heading_profile(seed_lines: DataFrame) -> DataFrame:
    """Per document: medians and shares of lines known to be headings, in columns seed_*."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(f"seed_{c}")
    mid = lambda c: F.median(c).alias(f"seed_{c}")
    return seed_lines.groupBy("doc_id").agg(mid("font_size"), share("bold"), share("all_caps"), mid("gap_above"), mid("indent"))


def resemblance() -> Column:
    """How much a line (font_size, bold, all_caps, gap_above, indent, text) is like its document's seed_* profile, 0 to 1."""
    near = lambda c: F.greatest(F.lit(0.0), 1 - F.abs(F.col(c) - F.col(f"seed_{c}")) / F.greatest(F.abs(f"seed_{c}"), F.lit(1.0)))
    like = lambda c: 1 - F.abs(F.col(c).cast("double") - F.col(f"seed_{c}"))
    w = SEED_WEIGHTS
    return w["font"] * near("font_size") + w["bold"] * like("bold") + w["caps"] * like("all_caps") + w["gap"] * near("gap_above") + w["indent"] * near("indent") + w["shape"] * T.title_shape(F.col("text"))


def map_quality(mapped: DataFrame) -> DataFrame:
    """(doc_id, placed, order_ratio, quality) of (doc_id, n, title, idx, score): placed x order x (0.5 + half the mean score)."""
    so_far = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    m = mapped.where("idx is not null").withColumn("high", F.max("idx").over(so_far))
    per = m.groupBy("doc_id").agg(F.count("*").alias("placed"), F.avg((F.col("high").isNull() | (F.col("idx") > F.col("high"))).cast("double")).alias("order_ratio"), F.avg("score").alias("s"))
    return per.select("doc_id", "placed", "order_ratio", (F.col("placed") * F.col("order_ratio") * (0.5 + 0.5 * F.col("s"))).alias("quality"))


def editorial_runs(units: DataFrame, surnames: list[str], gap: int = 3, least_names: int = 5, least_bios: int = 1) -> DataFrame:
    """(doc_id, first, last): runs of units that name authors and tell of them; up to ``gap`` others lie between."""
    name = F.col("text").rlike(r"\b(?:" + "|".join(surnames) + r")\b") if surnames else F.lit(False)
    bio = F.col("text").rlike(r"(?i)\b(?:is a professor|is the author|lives in|teaches at|has published)\b")
    hits = units.withColumns({"name": name.cast("int"), "bio": bio.cast("int")}).where("name + bio > 0")
    order = Window.partitionBy("doc_id").orderBy("n")
    hits = hits.withColumn("new", F.when(F.col("n") - F.lag("n").over(order) <= gap + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    runs = hits.groupBy("doc_id", "run").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.sum("name").alias("names"), F.sum("bio").alias("bios"))
    return runs.where((F.col("names") >= least_names) & (F.col("bios") >= least_bios)).select("doc_id", "first", "last")
