"""Tables of contents: pages that hold one, its entries, where content starts and ends, and where headings lie."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rewrite import trim_ws

# Shapes of contents entries and of listing lines.
LEADER = r"[.…]{2,}\s*\d+"
TERM_DOTS, TERM_END = re.compile(r"[.…]+\s*(\d{1,4})\s*$"), re.compile(r"\s(\d{1,4})\s*$")
LABEL = re.compile(r"^(?:(?:\d+(?:\.\d+){0,3}\.?)|(?:[IVXLCDM]+\.?))\s+\S")
MARKER = r"(?i)^(?:(?:\d{1,3}(?:\.\d{1,3}){0,3}\.?)|(chapter|part|section|appendix|article|book)\s+[ivxlcdm\d]{1,8}\.?)\s+\S"
LABEL_LINE = r"^(?:(?:CHAPTER|Chapter)\s+)?(?:\d{1,3}|[IVXLCDM]{1,7})\.?$"
HEADING_LINE = r"(?i)^(PREFACE|INTRODUCTION|FOREWORD|PROLOGUE|ETYMOLOGY|EXTRACTS|ARGUMENT|LETTER|DEDICATION|CHAPTER|CONTENTS)\b"
APPARATUS = r"(?i)\b(PUBLISHER|PUBLISHERS|PRESS|PRINTED BY|& ?CO\.)\b|^(Copyright|©)|^List of Illustrations"
ENTRIES, CONTINUED, FIRST_PAGES = 5, 200, 5


def leaders(t: Column) -> Column:
    return F.regexp_count(t, F.lit(LEADER))


def is_contents(t: Column) -> Column:
    return (F.contains(F.lower(t), F.lit("table of contents")) | F.lower(t).rlike(r"(?:^|\s)contents(?:\s|$)")) & (leaders(t) >= ENTRIES)


def goes_on(t: Column) -> Column:
    return (leaders(t) >= ENTRIES) & (F.length(t) / leaders(t) < CONTINUED)


def contents_region(pages: DataFrame) -> DataFrame:
    """(doc_id, first_page, last_page, begin, end) of (doc_id, page, text): a contents page among the first, and those that go on."""
    order = Window.partitionBy("doc_id").orderBy("page")
    p = pages.withColumns({"n": F.row_number().over(order), "here": is_contents(F.col("text")), "on": goes_on(F.col("text"))})
    p = p.withColumn("start", F.coalesce(F.sum(F.length("text") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = p.where((F.col("n") <= FIRST_PAGES) & F.col("here")).groupBy("doc_id").agg(F.min("n").alias("first"))
    after = p.join(first, "doc_id").where("n >= first").withColumn("broken", F.sum(F.when((F.col("n") > F.col("first")) & ~F.col("on"), 1).otherwise(0)).over(order))
    return after.where("broken = 0").groupBy("doc_id").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min("start").cast("long").alias("begin"), F.max(F.col("start") + F.length("text") + 2).cast("long").alias("end"))


def _page_of(line: str, labelled: bool) -> int | None:
    m = TERM_DOTS.search(line) or (TERM_END.search(line) if labelled else None)
    return int(m[1]) if m else None


def entries(text: str) -> list[tuple[str, int]]:
    """(title, page): lines are held until one ends in a page number; a new label drops what has none."""
    out, held = [], []
    for line in filter(None, (x.strip() for x in text.split("\n"))):
        labelled = bool(LABEL.match(line))
        if labelled and held and _page_of(" ".join(held), bool(LABEL.match(held[0]))) is None:
            held = []
        held.append(line)
        page = _page_of(line, labelled)
        if page:
            title = re.sub(r"[.…]*\s*\d{1,4}\s*$", "", " ".join(held)).strip()
            if title and len(title) < 300 and (LABEL.match(title) or len(held) > 1):
                out.append((title, page))
            held = []
    return out


def placed_entries(text: str, found: list[tuple[str, int]], after: int = 0) -> list[tuple[str, int]]:
    """(title, offset): titles looked for from a moving place; those not found lie evenly between, always further on."""
    at: list[int | None] = []
    cursor = after
    for title, _ in found:
        bare = re.sub(r"^(?:\d+(?:\.\d+)*|[IVXLCDM]+)\.?\s+", "", title)
        spot = next((p for p in (text.find(title, cursor), text.find(bare, cursor)) if p >= 0), None)
        at.append(spot)
        cursor = spot + 1 if spot is not None else cursor
    out, last = [], after - 1
    for n, (title, _) in enumerate(found):
        if at[n] is None:
            ahead = next(((m, at[m]) for m in range(n + 1, len(at)) if at[m] is not None), (len(at), len(text)))
            spot = last + max(1, (ahead[1] - last) // (ahead[0] - n + 1))
        else:
            spot = max(at[n], last + 1)
        out.append((title, spot))
        last = spot
    return out


def skip_listing(lines: DataFrame, least_prose: int = 60, most: int = 300) -> DataFrame:
    """(doc_id, line): the first line of prose within the first lines, after any listing of contents."""
    prose = (F.length("text") >= least_prose) & (F.contains("text", F.lit(". ")) | F.contains("text", F.lit(", ")) | F.col("text").rlike(r"[.!?]$"))
    entry = F.col("text").rlike(r"^[0-9IVXLCDMivxlcdm. \t]+$") | F.col("text").rlike(MARKER) | F.col("text").rlike(T.DOT_LEADER) | F.col("text").rlike(APPARATUS)
    return lines.where((F.col("line") < most) & prose & ~entry).groupBy("doc_id").agg(F.min("line").alias("line"))


def second_occurrence(docs: DataFrame, first_entry: str, gap: int = 50) -> DataFrame:
    """(doc_id, end): where a listing's first entry comes again, ``gap`` past its first place; null if it doesn't."""
    one = F.instr(F.col("text"), F.lit(first_entry))
    two = F.instr(F.substring("text", one + gap, F.length("text")), F.lit(first_entry))
    return docs.select("doc_id", F.when((one > 0) & (two > 0), one + gap + two - 2).alias("end"))


def catalog_end(t: Column, tail: int = 6000) -> Column:
    """Where THE END comes among the last characters, past which a publisher's list may follow; else the text's length."""
    n = F.length(t)
    begin = F.greatest(n - tail, F.lit(0))
    at = F.instr(F.substring(t, begin + 1, n), F.lit("THE END"))
    return F.when(at > 0, begin + at - 1 + 7).otherwise(n)


def content_start(*candidates: Column) -> Column:
    """The furthest of the detectors' offsets that isn't null."""
    return F.coalesce(F.greatest(*candidates), F.lit(0))


def merge_labels(units: DataFrame) -> DataFrame:
    """A heading that is only a label takes the next unit, if that is a heading with a title, into itself."""
    order = Window.partitionBy("doc_id").orderBy("sequence")
    label = (F.col("kind") == "heading") & F.col("text").rlike(LABEL_LINE)
    u = units.withColumns({"label": label, "next_text": F.lead("text").over(order), "next_kind": F.lead("kind").over(order)})
    u = u.withColumn("next_label", F.lead("label").over(order))
    joins = F.col("label") & (F.col("next_kind") == "heading") & ~F.col("next_label")
    u = u.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("taken", F.coalesce(F.lag("joins").over(order), F.lit(False)))
    text = F.when(F.col("joins"), F.concat_ws(" ", "text", "next_text")).otherwise(F.col("text"))
    return u.withColumn("text", text).where("not taken").select(*units.columns)


def coalesce_wrapped(toc: DataFrame, most: int = 600) -> DataFrame:
    """Entries (doc_id, play_order, title, offset, level) whose title goes on in the next one, as one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in rows.sort_values("play_order").to_dict("records"):
            p = out[-1] if out else None
            wraps = p and p["level"] == r["level"] and r["play_order"] == p["_last"] + 1 and re.match(MARKER, p["title"]) and not re.match(MARKER, r["title"]) and abs(r["offset"] - p["offset"]) <= most and re.search(r"(?i)(\b(?:and|of|the|a|in|on|for|to|with)|[,:—-])$", p["title"].strip())
            if wraps:
                p["title"], p["_last"] = f"{p['title'].strip()} {r['title'].strip()}", r["play_order"]
            else:
                out.append(r | {"_last": r["play_order"]})
        return pd.DataFrame(out, columns=[*rows.columns, "_last"]).drop(columns="_last")

    return toc.groupBy("doc_id").applyInPandas(run, toc.schema)


def resolve_headings(titles: DataFrame, lines: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, n, line): a line for each title in order, by the heaviest increasing chain of candidates.

    Candidates share the title's first word, so they come from an equi-join; the chain is found per document.
    """
    t = titles.withColumn("w", F.lower(F.substring_index(trim_ws(F.col("title")), " ", 1)))
    l = lines.withColumn("w", F.lower(F.substring_index(trim_ws(F.col("text")), " ", 1)))
    pairs = t.join(l, ["doc_id", "w"]).withColumn("fit", T.title_overlap(F.col("title"), F.col("text"))).where(F.col("fit") >= least)
    bonus = F.when(F.lower(trim_ws(F.col("title"))) == F.lower(trim_ws(F.col("text"))), 1.0).otherwise(0.0)
    pairs = pairs.select("doc_id", F.col("n").cast("long").alias("n"), F.col("line").cast("long").alias("line"), (1000 * F.col("fit") + 100 * bonus).alias("weight"))

    def run(rows: pa.Table) -> pa.Table:
        weights = {(a, b): w for a, b, w in zip(*(rows.column(c).to_pylist() for c in ("n", "line", "weight")))}
        c = sorted(weights)
        ranks = {x: k for k, x in enumerate(sorted({line for _, line in c}), 1)}
        n, place, weight = [a for a, _ in c], [ranks[b] for _, b in c], [weights[x] for x in c]
        tree: list[tuple[float, int]] = [(0.0, -1)] * (len(ranks) + 1)  # prefix maxima of (weight of a chain, its end)
        total, back = [0.0] * len(c), [-1] * len(c)
        i = 0
        while i < len(c):
            j = i
            while j < len(c) and n[j] == n[i]:  # candidates of one title don't follow each other
                at, best = place[j] - 1, (0.0, -1)
                while at > 0:
                    best = max(best, tree[at], key=lambda x: x[0])
                    at -= at & -at
                total[j], back[j] = best[0] + weight[j], best[1]
                j += 1
            for k in range(i, j):
                at = place[k]
                while at < len(tree):
                    if total[k] > tree[at][0]:
                        tree[at] = (total[k], k)
                    at += at & -at
            i = j
        i = max(range(len(c)), key=lambda k: (total[k], -k))
        chain = []
        while i >= 0:
            chain.append(i)
            i = back[i]
        chain.reverse()
        doc = rows.column("doc_id").slice(0, 1).to_pylist() * len(chain)
        return pa.table({"doc_id": pa.array(doc, rows.schema.field("doc_id").type), "n": pa.array([c[i][0] for i in chain], pa.int64()), "line": pa.array([c[i][1] for i in chain], pa.int64())})

    return pairs.groupBy("doc_id").applyInArrow(run, f"doc_id {pairs.schema['doc_id'].dataType.simpleString()}, n long, line long")


def detect_headings(page_lines: DataFrame, body: DataFrame, most_words: int = 40) -> DataFrame:
    """Lines that stand out from the body's size, or are numbered, of 1 to ``most_words`` words."""
    l = page_lines.join(body, "doc_id")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    out = (F.col("font_size") >= 1.15 * F.col("body_size")) | F.col("text").rlike(T.SECTION_NUMBER)
    return l.where(out & words.between(1, most_words) & ~F.col("text").rlike(T.DOT_LEADER)).select(*page_lines.columns)


def choose_map(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, choice) from two maps' (doc_id, placed, order_ratio, quality): the built-in one if sound, else the better."""
    x = a.select("doc_id", F.col("placed").alias("ap"), F.col("order_ratio").alias("ao"), F.col("quality").alias("aq"))
    y = b.select("doc_id", F.col("placed").alias("bp"), F.col("quality").alias("bq"))
    sound = (F.col("ap") >= 4) & (F.col("ao") >= 0.90)
    return x.join(y, "doc_id", "full_outer").select("doc_id", F.when(sound, "built-in").when(F.coalesce((F.col("bq") > 1.3 * F.coalesce("aq", F.lit(0.0))) & (F.col("bp") >= 3), F.lit(False)), "seedless").otherwise("built-in").alias("choice"))


def visual_lines(boxes: DataFrame, same: float = 0.012, full: float = 0.74) -> DataFrame:
    """(doc_id, page, text) of recognised fragments (doc_id, page, x, max_x, y, text): lines by height, then wraps joined.

    Fragments of one line differ by less than ``same`` in y; a line that reaches ``full`` goes on in the next.
    """
    order = Window.partitionBy("doc_id", "page").orderBy(F.col("y").desc(), "x")
    f = boxes.withColumn("new", F.when(F.lag("y").over(order) - F.col("y") < same, 0).otherwise(1)).withColumn("row", F.sum("new").over(order))
    row = f.groupBy("doc_id", "page", "row").agg(F.array_sort(F.collect_list(F.struct("x", "text"))).alias("a"), F.max("max_x").alias("reach"))
    row = row.select("doc_id", "page", "row", F.array_join(F.transform("a", lambda z: z["text"]), " ").alias("text"), "reach")
    line = Window.partitionBy("doc_id", "page").orderBy("row")
    row = row.withColumn("joint", F.when(F.col("row") == 1, "").when(F.lag("reach").over(line) >= full, " ").otherwise("\n\n"))
    page = row.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("row", F.concat("joint", "text").alias("t")))).alias("a"))
    return page.select("doc_id", "page", F.array_join(F.transform("a", lambda z: z["t"]), "").alias("text"))


def paragraphs_from_lines(page_lines: DataFrame, gap: float = 1.5) -> DataFrame:
    """(doc_id, n, text): lines (doc_id, page, line, text, y) put together until a gap or an end of sentence before a capital."""
    order = Window.partitionBy("doc_id").orderBy("page", "line")
    l = page_lines.withColumns({"was": F.lag("text").over(order), "dy": F.col("y") - F.lag("y").over(order), "was_page": F.lag("page").over(order)})
    typical = F.percentile_approx("dy", 0.5).over(Window.partitionBy("doc_id", "page"))
    l = l.withColumn("typical", typical)
    ends = F.col("was").rlike(r"[.!?][\"'”’]?$") & F.col("text").rlike(r"^\p{Lu}")
    new = F.col("was").isNull() | ((F.col("was_page") == F.col("page")) & (F.col("dy") > gap * F.col("typical"))) | (ends & (F.length("was") < 60))
    l = l.withColumn("n", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(order))
    g = l.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("page", "line", "text"))).alias("a"))
    joined = F.array_join(F.transform("a", lambda z: z["text"]), "\n")
    return g.select("doc_id", "n", F.regexp_replace(F.regexp_replace(joined, r"(\p{L})-\n(\p{Ll})", "$1$2"), "\n", " ").alias("text"))


def suspect_tokens(docs: DataFrame, dictionary: DataFrame, most: int = 1000) -> DataFrame:
    """(doc_id, token): fused-looking tokens that aren't words but split into two; ``dictionary``: (word).

    At most ``most`` distinct tokens of a document, the first ones: what a repair pass takes on.
    """
    from ..functions.predicates import is_fused

    token = F.regexp_replace("raw", r"^\p{P}+|\p{P}+$", "")
    each = docs.select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("at", "raw")).select("doc_id", "at", token.alias("token")).where(is_fused(F.col("token")))
    each = each.groupBy("doc_id", "token").agg(F.min("at").alias("at")).withColumn("low", F.lower("token"))
    each = each.join(dictionary.select(F.col("word").alias("low")), "low", "left_anti")
    cuts = each.select("*", F.explode(F.sequence(F.lit(2), F.length("low") - 2)).alias("i")).withColumns({"a": F.substring("low", F.lit(1), F.col("i")), "b": F.substring("low", F.col("i") + 1, F.length("low"))})
    split = cuts.join(dictionary.select(F.col("word").alias("a")), "a", "left_semi").join(dictionary.select(F.col("word").alias("b")), "b", "left_semi")
    order = Window.partitionBy("doc_id").orderBy("at")
    return split.select("doc_id", "token", "at").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("doc_id", "token")


# A catalogue's opening sentences and words of its lines, shapes of entries told by keywords, bounds of the walk.
CATALOG_ANCHORS = ["There are several editions of this ebook", "Click on any of the filenumbers below"]
CATALOG_WORDS = ["ebook", "filenumber", "characteristics", "preferred file"]
CATALOG_CHARS, WALK_GAP = 3000, 5000
KEYWORD_LINE = re.compile(r"(?im)^\s*(?:chapter|part|section|appendix|book|volume)\s+[ivxlcdm0-9]+\b.{0,200}$")
KEYWORD = re.compile(r"(?i)\b(?:chapter|part|section|appendix)\s+[ivxlcdm0-9]+\b")
ANCHOR_PAGES, MORE_PAGES, TITLE_WORDS, ENTRY_CHARS = 8, 4, 16, 250
EPUB_FRONT = ["produced in epub format by the internet archive", "created with hocr-to-epub", "<title>notice</title>", "epub:type=\"toc\"", "epub:type='toc'"]
ROMAN = re.compile(r"^M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$")


def catalog_region_end(text: str, skip: int) -> int | None:
    """Where a catalogue of editions after ``skip`` ends: lines past its opening that are blank, numbers, bracketed or speak of files; None without one."""
    if skip >= len(text):
        return None
    head = text[skip : skip + CATALOG_CHARS]
    anchored = lambda x: any(a.lower() in x.lower() for a in CATALOG_ANCHORS)
    at, end = skip, None
    for line in head.split("\n"):
        at += len(line) + 1
        bare = line.strip(" \t\xa0")
        if end is None:
            end = at if anchored(bare) else None
        elif not bare or re.fullmatch(r"\d+", bare) or (bare[0] == "(" and bare[-1] == ")") or any(w in bare.lower() for w in CATALOG_WORDS):
            end = at
        else:
            break
    return None if end is None else min(end, len(text))


def first_prose(text: str, start: int, end: int) -> int | None:
    """Offset of the first line between that reads as prose: 60 characters, five small letters, a sentence's end."""
    at = start
    while at < end:
        stop = text.find("\n", at, end)
        stop = end if stop < 0 else stop
        line = text[at:stop].strip()
        if len(line) >= 60 and sum(c.islower() for c in line) >= 5 and re.search("[.!?]", line):
            return at
        at = stop + 1
    return None


def walk_start(toc: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, start, by_prose): where reading starts, from a walk of the contents to the first title of the body.

    toc: (doc_id, play_order, title, offset); docs: (doc_id, text, skip). Entries at or before the skip don't count. Past publishing matter the
    body's offset holds; without any, a gap of more than 5000 characters gives way to the first prose in it. Null without a body title.
    """
    from .structure import classify_title

    e = toc.join(docs.select("doc_id", "skip"), "doc_id").where(F.col("offset") > F.col("skip")).withColumn("class", classify_title(F.col("title")))
    body = e.where("class = 'body'").groupBy("doc_id").agg(F.min("play_order").alias("first"), F.min_by("offset", "play_order").alias("body"))
    passed = e.where("class = 'publishing'").groupBy("doc_id").agg(F.min("play_order").alias("matter"))
    d = docs.join(body, "doc_id", "left").join(passed, "doc_id", "left").withColumn("walked", F.coalesce(F.col("matter") < F.col("first"), F.lit(False)))
    line = F.split(F.substring("text", F.col("skip") + 1, F.col("body") - F.col("skip")), "\n")
    prose = lambda x: (F.length(trim_ws(x)) >= 60) & (F.regexp_count(trim_ws(x), F.lit(r"\p{Ll}")) >= 5) & trim_ws(x).rlike("[.!?]")
    begin = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("found"))
    seek = F.aggregate(line, begin, lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.coalesce(a["found"], F.when(prose(x), a["at"])).alias("found")), lambda a: a["found"])
    found = F.when(F.col("body").isNotNull() & ~F.col("walked") & (F.col("body") - F.col("skip") > WALK_GAP), seek)
    d = d.withColumn("found", found)
    use = F.coalesce(F.col("found") > 0, F.lit(False))
    return d.select("doc_id", F.when(use, F.col("skip") + F.col("found")).otherwise(F.col("body")).cast("long").alias("start"), use.alias("by_prose"))


def page_value(token: str) -> int | None:
    """The page that a token of digits or a small roman numeral names."""
    if re.fullmatch(r"\d{1,4}", token):
        return int(token) or None
    if len(token) >= 2 and token == token.lower() and ROMAN.match(token.upper()):
        values = [{"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}[c] for c in token.upper()]
        return sum(-v if v < max(values[n:]) else v for n, v in enumerate(values)) or None
    return None


def flow_entries(text: str) -> list[tuple[str, int]]:
    """(title, page) of running text: words up to a page number, of which there are at most sixteen."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    for token in re.split(r"[ \n\t\r]+", text):
        bare = token.strip(".,:;()[]")
        if not bare:
            continue
        page = page_value(bare)
        if page is None:
            held.append(token)
            held = [] if len(held) > TITLE_WORDS else held
            continue
        title = " ".join(held).strip()
        for anchor in ("table of contents", "contents"):
            if title.lower().startswith(anchor):
                title = title[len(anchor) :]
                break
        title = title.strip(" \t\n.…:;,-")
        if 2 <= len(title) <= 120 and any(c.isalpha() for c in title) and any(c.isupper() for c in title):
            out.append((title, page))
        held = []
    return out


def keyword_contents(pages: list[str]) -> tuple[int, int, list[tuple[str, int]]] | None:
    """(begin, end, entries) of contents told by keywords: a page among the first that names contents and has five entries, and those that go on.

    Entries are kept where there are five and their pages mostly rise; None without entries by lines or by flow.
    """
    by_line = lambda t: len(KEYWORD_LINE.findall(t))
    by_word = lambda t: len(KEYWORD.findall(t))
    names = lambda t: "table of contents" in t.lower() or re.search(r"(?:^|\s)contents(?:\s|$)", t.lower())
    first = next((n for n, t in enumerate(pages[:ANCHOR_PAGES]) if names(t) and (by_line(t) >= ENTRIES or by_word(t) >= ENTRIES)), None)
    if first is None:
        return None
    last = first
    for n in range(first + 1, min(len(pages), first + MORE_PAGES + 1)):
        lines = by_line(pages[n])
        if not (len(pages[n]) // max(lines, 1) < ENTRY_CHARS if lines >= ENTRIES else by_word(pages[n]) >= ENTRIES):
            break
        last = n
    begin = sum(len(t) + 2 for t in pages[:first])
    end = begin + sum(len(t) + 2 for t in pages[first : last + 1])
    found = flow_entries("\n\n".join(pages[first : last + 1]))
    rising = [b >= a for (_, a), (_, b) in zip(found, found[1:])]
    sound = found if len(found) >= ENTRIES and rising and sum(rising) / len(rising) >= 0.7 else []
    return (begin, end, sound) if sound or by_line(pages[first]) >= ENTRIES else None


def front_matter(spine: DataFrame) -> DataFrame:
    """(doc_id, skip_until): where content starts behind a spine's (doc_id, n, html, start) items of front matter; 0 without any.

    The last such item with an item behind it decides; an item of front matter at the end doesn't.
    """
    hit = F.lit(False)
    for sign in EPUB_FRONT:
        hit = hit | F.contains(F.lower("html"), F.lit(sign))
    s = spine.select("doc_id", "n", "start", hit.alias("hit")).withColumn("after", F.lead("start").over(Window.partitionBy("doc_id").orderBy("n")))
    return s.groupBy("doc_id").agg(F.coalesce(F.max_by(F.when(F.col("hit"), F.col("after")), F.when(F.col("hit") & F.col("after").isNotNull(), F.col("n"))), F.lit(0)).alias("skip_until"))


def text_structure(pages: DataFrame) -> DataFrame:
    """(doc_id, begin, end, entries) of (doc_id, page, text): contents by dot leaders, else by keywords; entries are (title, page)."""
    per = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p")).select("doc_id", F.transform("p", lambda x: x["text"]).alias("texts"))
    kind = f"doc_id {pages.schema['doc_id'].dataType.simpleString()}"

    def by_leaders(texts: list[str]) -> tuple[int, int, list[tuple[str, int]]] | None:
        leaders = [len(re.findall(LEADER, t)) for t in texts]
        names = [("table of contents" in t.lower() or re.search(r"(?:^|\s)contents(?:\s|$)", t.lower())) and n >= ENTRIES for t, n in zip(texts, leaders)]
        first = next((n for n, x in enumerate(names[:FIRST_PAGES]) if x), None)
        if first is None:
            return None
        last = first
        while last + 1 < len(texts) and leaders[last + 1] >= ENTRIES and len(texts[last + 1]) / leaders[last + 1] < CONTINUED:
            last += 1
        begin = sum(len(t) + 2 for t in texts[:first])
        return begin, begin + sum(len(t) + 2 for t in texts[first : last + 1]), [e for t in texts[first : last + 1] for e in entries(t)]

    def run(batches):
        for b in batches:
            rows = []
            for d, texts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one = by_leaders(texts)
                two = keyword_contents(texts) if one is None or not one[2] else None
                if one or two:
                    begin, end = (one or two)[:2]
                    rows.append((d, begin, end, [{"title": t, "page": p} for t, p in ((one and one[2]) or (two and two[2]) or [])]))
            cols = list(zip(*rows)) or [[]] * 4
            entry = pa.list_(pa.struct([("title", pa.string()), ("page", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (b.schema.field(0).type, pa.int64(), pa.int64(), entry))], ["doc_id", "begin", "end", "entries"])

    return per.mapInArrow(run, f"{kind}, begin long, end long, entries array<struct<title:string,page:long>>")
