"""Text scalar functions: signatures, titles, entities of text shape, estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewrite import bind, trim_ws

# Constants and patterns that decide a result.
CHARS_PER_TOKEN = 2.5
WORDS_PER_MINUTE = 155.0
ROMAN = r"(?i)^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
SITE_SEPARATOR = r"^(.*)( \| | - | – | — )(.*?)$"
REFERENCE_SITES = {
    "wikipedia": "Wikipedia",
    "wiktionary": "Wiktionary",
    "wikisource": "Wikisource",
    "wikibooks": "Wikibooks",
    "britannica": "Britannica",
    "encyclopedia britannica": "Britannica",
    "stanford encyclopedia of philosophy": "Stanford Encyclopedia",
}
AUTHOR_LINE = r"(?im)^\s*Author:\s*(.+?)\s*$"
BY_LINE = r"(?m)^[ \t]*(?:(?:[Cc]o-)?[Aa]uthored[ \t]+|[Ww]ritten[ \t]+)?[Bb]y[ \t]+([A-Z][a-z][\p{L}.'’-]*(?:[ \t]+(?:and[ \t]+)?[A-Z][\p{L}.'’-]*)+)"
YEAR_PRINTED = r"(?i)(?:first published|originally published|first edition|copyright(?:\s*©)?|\(c\)|©)\s*(?:in\s+)?(\d{4})"
YEAR_POSTED = r"(?i)(?:release date|posting date|publication date)[^0-9]{0,40}(\d{4})"
SECTION_NUMBER = r"^(?:(?i:chapter|part|section|article|schedule)\s+)?\d{1,3}(?:\.\d{1,3}){0,3}\.?\s+\p{L}"
DOT_LEADER = r"[.·•…]{3,}\s*\d{1,4}\s*$"
NUMBER_PREFIX = r"^[0-9IVXLC]+(?:[.\-][0-9A-Za-z]+)*[.:]?\s*"
TITLE_PHRASE = r"\b([A-Z][a-zA-Z]+(?:\s+(?:[A-Z][a-zA-Z]+|of|the|and|in|on|for|to|at)){1,7}\s+[A-Z][a-zA-Z]+)\b"
VERSIONED = r"\b([A-Z][A-Za-z]{1,11})[- ](\d+(?:\.\d+)?)\b"
QUOTES = [r'"([^"]{3,80})"', r"'([^']{3,80})'", "“([^”]{3,80})”"]
FOOTNOTE = r"(?<=[^0-9\s.]\.[0-9]{1,3})\s+(?=\p{Lu})"
SENTENCE = r"[^.!?]*[.!?]|[^.!?]+$"
LIST_MARK = r"^(?:•|\d+\.)\s+"
CAPTION_PREFIX = "^(?i)(.+?[.!?][\"'“”‘’]?\\s+)(chapter\\s+[ivxlcdm0-9]+\\b.*)$"
TWICE_MARKED = r"^(?i:[ivxlcdm]{1,8}\s+)((?i:chapter|part|section|appendix|article|book)\s+(?i:[ivxlcdm\d]{1,8})\b.*)$"
EMBEDDED_SECTION = r"\b\d{1,3}(?:\.\d{1,3}){0,3}\.?\s+[A-Z]"
# Loops at the start of a reversed text, and the one copy that stays of them: 30, 40, ... 80 characters twice, and 2 to 10
# characters, of which two are not white space, four times. A look-behind goes back to the text's start at most.
LONG_LOOPS = r"\A(?s)(?:" + "|".join(rf"(.{{{n}}})\{k}+" for k, n in enumerate(range(30, 81, 10), 1)) + ")", "$1$2$3$4$5$6"
SHORT_LOOPS = r"\A(?sU)(?:" + "|".join(rf"(.{{{n}}})(?<=\S.{{0,20}}\S.{{0,20}})\{k}{{3,}}" for k, n in enumerate(range(2, 11), 1)) + ")", "$1$2$3$4$5$6$7$8$9"
# How lines begin that tell of a book, and that end its title.
METADATA = [
    "the project gutenberg", "project gutenberg", "this ebook is", "release date:", "language:", "character set",
    "posting date:", "most recently updated:", "produced by", "credits:", "ebook designed and",
]
TITLE_ENDS = ["by ", "author:", "chapter ", "contents", "etymology", "foreword", "preface", "introduction", "dedication"]
WATERMARKS = [
    r"(?is)This document was created by an unregistered ChmMagic.{0,80}?bisenter\.com\s+to\s+(?:register\s+it\s*\.\s*Thanks\s*\.?|registe\w*\.?)\s*",
    r"(?is)Evaluation Only\.\s*Created with Aspose\.[A-Za-z]+\.[^.]*\.",
    r"(?is)(?:Generated|Created)\s+(?:by|with)\s+[Cc]alibre[^.\n]{0,80}\.",
    r"(?is)Evaluation Only[.,]?\s+(?:Please\s+)?(?:register|visit|trial)[^.]*?https?://\S+[^.\s]*\.?",
]


def token_estimate(t: Column) -> Column:
    """Tokens at 2.5 characters each, at least one for any text."""
    n = F.length(t)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.round(n / CHARS_PER_TOKEN).cast("int")))


def trim_to_tokens(t: Column, ceiling: int) -> Column:
    return F.substring(t, 1, int(ceiling * CHARS_PER_TOKEN))


def reading_minutes(chars: Column, rate: Column) -> Column:
    """Minutes left at five characters a word; the rate is a percentage from 50 to 200."""
    pct = F.greatest(F.lit(50.0), F.least(F.lit(200.0), F.when(rate > 0, rate).otherwise(100.0)))
    return F.round(F.greatest(chars, F.lit(0)) / 5.0 / (WORDS_PER_MINUTE * pct / 100.0)).cast("long")


def page_signature(t: Column) -> Column:
    """Letters with each run of digits as one #, all else as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"\p{N}+", "#"), r"[^\p{L}#]+", " "))


def numeric_anchor(t: Column) -> Column:
    """num: and the longest run of four digits or more (the first of equals); else null."""
    runs = F.regexp_extract_all(t, F.lit(r"\d{4,}"), F.lit(0))
    best = F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.when(F.size(runs) > 0, F.concat(F.lit("num:"), best))


def is_lone_page_number(t: Column) -> Column:
    """Nothing but digits, or a strict roman numeral of at most seven letters."""
    s = trim_ws(t)
    return s.rlike(r"^\d+$") | (s.rlike(ROMAN) & (F.length(s) <= 7) & (s != ""))


def header_form(t: Column, letters: str = r"\p{L}\p{M}\p{N}_") -> Column:
    """Spaces single, digit runs <N>, roman numeral words <R>; ``letters``: what a word goes on with, on either side."""
    s = F.regexp_replace(F.regexp_replace(t, r"[ \t\n\f\r]+", " "), r"\d+", "<N>")
    return F.trim(F.regexp_replace(s, rf"(?<![{letters}])[IVXLCDMivxlcdm]++(?![{letters}])", "<R>"))


def roman_value(t: Column) -> Column:
    """Value of a canonical roman numeral under 4000; else null."""
    s = F.upper(t)
    marks = [("CM", 900), ("CD", 400), ("XC", 90), ("XL", 40), ("IX", 9), ("IV", 4), ("M", 1000), ("D", 500), ("C", 100), ("L", 50), ("X", 10), ("V", 5), ("I", 1)]
    rest, total = s, F.lit(0)
    for mark, value in marks:
        total = total + F.regexp_count(rest, F.lit(mark)) * value
        rest = F.regexp_replace(rest, mark, "")
    return F.when(t.rlike(ROMAN) & (t != ""), total)


def html_title(html: Column) -> Column:
    """The title, or else the first heading, without tags."""
    title = trim_ws(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    head = trim_ws(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", ""))
    return F.when(title != "", title).when(head != "", head)


def markdown_title(t: Column) -> Column:
    """The first # heading among 50 lines, or else the first ## heading."""
    lines = F.transform(F.slice(F.split(t, "\n"), 1, 50), lambda x: F.trim(x))
    first = F.get(F.filter(lines, lambda x: x.startswith("# ")), 0)
    second = F.get(F.filter(lines, lambda x: x.startswith("## ")), 0)
    return F.coalesce(F.trim(F.substring(first, 3, 1 << 30)), F.trim(F.substring(second, 4, 1 << 30)))


def strip_site_suffix(title: Column) -> Column:
    """Without a site's name after the last separator; a reference work's name is kept in brackets."""
    head, tail = trim_ws(F.regexp_extract(title, SITE_SEPARATOR, 1)), trim_ws(F.regexp_extract(title, SITE_SEPARATOR, 3))
    shaped = (tail != "") & (F.length(tail) <= 30) & (F.size(F.split(tail, r"\s+")) <= 5) & (head != "")
    out = F.when(shaped, head).otherwise(title)
    for name, shown in REFERENCE_SITES.items():
        out = F.when(shaped & (F.lower(tail) == name), F.concat(head, F.lit(f" ({shown} article)"))).otherwise(out)
    return out


def clean_filename(name: Column) -> Column:
    """A title from a file name: no extension, ids or suffixes; capitalised words."""
    s = F.regexp_replace(name, r"(?<=.)\.[^./ ]+$", "")
    s = F.when(s.rlike(r"^pg\d+[-_]?"), F.regexp_replace(s, r"^pg\d+[-_]?", "")).otherwise(F.regexp_replace(s, r"^\d+[-_]", ""))
    s = F.regexp_replace(s, r"([-_](images|cleaned|raw))*([-_]\d+)*$", "")
    s = F.trim(F.regexp_replace(F.translate(s, "_-", "  "), r"\s+", " "))
    words = F.transform(F.split(s, " "), lambda w: F.when((w == F.upper(w)) & (F.length(w) > 1), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))))
    return F.when(s == "", "Untitled").otherwise(F.array_join(words, " "))


def resolve_title(content_title: Column, file_name: Column) -> Column:
    t = trim_ws(content_title)
    return F.when(t.isNotNull() & (t != "") & (F.length(t) <= 200), t).otherwise(clean_filename(file_name))


def txt_title(t: Column) -> Column:
    """The Title: line with what is indented under it; else the first lines, up to four, before an author, a part or a long line, without metadata."""
    lines = F.slice(F.split(t, r"\r\n|[\n\r\x{0B}\x{0C}\x{85}\x{2028}\x{2029}]"), 1, 200)
    told = F.regexp_extract(F.array_join(lines, "\n"), r"(?i)(?:^|\n)[ \t]*title:[ \t]*([^\n]*(?:\n[ \t]+[^\n]*[^\s][^\n]*)*)", 1)
    told = F.trim(F.regexp_replace(told, r"[ \t]*\n[ \t]+", " "))

    def opening(bare: Column) -> Column:
        low = lambda x: F.lower(x)
        meta = lambda x: (x == "") | x.startswith("***") | low(x).rlike("^(?:" + "|".join(METADATA) + ")")
        skip = F.aggregate(bare, F.struct(F.lit(0).alias("n"), F.lit(False).alias("done")), lambda a, x: F.struct(F.when(a["done"] | ~meta(x), a["n"]).otherwise(a["n"] + 1).alias("n"), (a["done"] | ~meta(x)).alias("done")), lambda a: a["n"])
        rest = F.slice(F.filter(F.slice(bare, skip + 1, F.lit(200)), lambda x: x != ""), 1, 4)
        stop = lambda x: low(x).rlike("^(?:" + "|".join(TITLE_ENDS) + ")") | x.startswith("***") | (F.length(x) > 100)
        begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("done"))
        parts = F.aggregate(rest, begin, lambda a, x: F.struct(F.when(a["done"] | stop(x), a["out"]).otherwise(F.concat(a["out"], F.array(x))).alias("out"), (a["done"] | stop(x)).alias("done")), lambda a: a["out"])
        first = F.get(F.filter(bare, lambda x: x != ""), 0)
        alone = F.when((F.length(first) <= 120) & ~first.rlike(r"[.!?]$"), first)
        return bind(parts, lambda p: F.when(F.size(p) > 0, F.regexp_replace(F.array_join(p, " "), r"^[. ]+|[. ]+$", "")).otherwise(alone))

    return F.when(told != "", told).otherwise(bind(F.transform(lines, lambda x: F.regexp_replace(x, r"^[\p{Zs}\t]+|[\p{Zs}\t]+$", "")), opening))


def split_authors(raw: Column) -> Column:
    parts = F.split(F.replace(raw, F.lit(" and "), F.lit(",")), "[,;&]")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^[ \t.’']+|[ \t.’']+$", "")), lambda p: (F.length(p) >= 2) & p.rlike(r"\p{L}"))


def bibliography(t: Column) -> Column:
    """(authors, year) from the opening of a text."""
    head = F.substring(t, 1, 3000)
    line, by = F.regexp_extract(head, AUTHOR_LINE, 1), F.regexp_extract(head, BY_LINE, 1)
    year, posted = F.regexp_extract(head, YEAR_PRINTED, 1), F.regexp_extract(head, YEAR_POSTED, 1)
    authors = F.when(line != "", split_authors(line)).when(by != "", split_authors(by)).otherwise(F.array().cast("array<string>"))
    return F.struct(authors.alias("authors"), F.when(year != "", year).when(posted != "", posted).alias("year"))


def sentences(t: Column) -> Column:
    """Cut after full stops, question and exclamation marks; trimmed, none empty."""
    return F.filter(F.transform(F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0)), trim_ws), lambda s: s != "")


def footnote_parts(t: Column) -> Column:
    """Cut where a footnote number after a full stop runs into the next sentence."""
    return F.split(t, FOOTNOTE)


def quoted_strings(t: Column) -> Column:
    found = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in QUOTES])
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(trim_ws(x))), lambda x: F.length(x) >= 4)))


def title_phrases(t: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(t, F.lit(TITLE_PHRASE), F.lit(1)), lambda x: F.length(x) >= 6)))


def versioned_names(t: Column) -> Column:
    """Names with a version, joined by a hyphen and by a space."""
    name, version = F.regexp_extract_all(t, F.lit(VERSIONED), F.lit(1)), F.regexp_extract_all(t, F.lit(VERSIONED), F.lit(2))
    both = F.concat(F.zip_with(name, version, lambda a, b: F.concat_ws("-", a, b)), F.zip_with(name, version, lambda a, b: F.concat_ws(" ", a, b)))
    return F.array_sort(F.array_distinct(F.transform(both, F.lower)))


def ungrounded(answer: Column, source: Column) -> Column:
    """Quotes, title phrases and versioned names of the answer that the source lacks as a string and as a set of words."""
    low = F.lower(source)
    words = F.split(low, r"[^\p{L}\p{N}]+")
    named = F.array_distinct(F.concat(quoted_strings(answer), F.transform(title_phrases(answer), F.lower), versioned_names(answer)))
    return F.filter(named, lambda e: ~F.contains(low, e) & (F.size(F.array_except(F.split(e, r"[^\p{L}\p{N}]+"), words)) > 0))


def title_shape(t: Column) -> Column:
    """Share of capitalised words after a number prefix."""
    words = F.filter(F.split(F.regexp_replace(t, NUMBER_PREFIX, ""), r"\s+"), lambda w: w.rlike(r"\p{L}"))
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w.rlike(r"^\P{L}*\p{Lu}"))) / F.size(words)).otherwise(0.0)


def title_overlap(title: Column, line: Column) -> Column:
    """Share of the title's words of two letters or more that the line has."""
    bag = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2))
    own = bag(title)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, bag(line))) / F.size(own)).otherwise(0.0)


def is_repetition(t: Column) -> Column:
    """Three equal tails of 30 to 80 characters, or a short string four times at the end."""
    n = F.length(t)
    tail = lambda size, back: F.substring(t, n - size * back + 1, F.lit(size))
    loops = F.lit(False)
    for size in range(30, 81, 10):
        loops = loops | ((n >= 3 * size) & (tail(size, 1) == tail(size, 2)) & (tail(size, 2) == tail(size, 3)))
    for size in range(2, 11):
        loops = loops | ((F.length(trim_ws(tail(size, 1))) >= 2) & (tail(size, 1) == tail(size, 2)) & (tail(size, 2) == tail(size, 3)) & (tail(size, 3) == tail(size, 4)))
    return (n >= 200) & loops


def trim_repetition(t: Column, closing: str = "") -> Column:
    """One copy of equal tails of 30, 40, ... 80 characters and then of a short string that ends the text four times; a closing behind what was cut.

    Copies are matched at the start of the reversed text, so that the work grows with the text's length alone.
    """
    ending = F.lit(" " + closing if closing else "")
    cut = lambda x: F.reverse(F.regexp_replace(F.regexp_replace(F.reverse(x), *LONG_LOOPS), *SHORT_LOOPS))
    both = bind(t, lambda x: F.struct(trim_ws(cut(x)).alias("cut"), F.length(trim_ws(x)).alias("n")))
    return bind(both, lambda x: F.when(F.length(x["cut"]) < x["n"], F.concat(x["cut"], ending)).otherwise(x["cut"]))


def fingerprint(t: Column, most: int = 48) -> Column:
    """The head of the text, cut at a word's end where that leaves half of it."""
    s = trim_ws(t)
    head = F.substring(s, 1, most)
    cut = F.regexp_replace(head, r"\s+\S*\z", "")
    return F.when(F.length(s) <= most, s).when(F.length(cut) >= most // 2, cut).otherwise(head)


def anchor(t: Column, start: Column, end: Column, window: int = 48) -> Column:
    """(text, before, after) around half-open offsets."""
    s, e = F.greatest(start, F.lit(0)), F.least(end, F.length(t))
    return F.struct(F.substring(t, s + 1, e - s).alias("text"), F.substring(t, F.greatest(s - window, F.lit(0)) + 1, F.least(s, F.lit(window))).alias("before"), F.substring(t, e + 1, F.lit(window)).alias("after"))


def refine_anchor(t: Column, near: Column, text: Column, before: Column, after: Column) -> Column:
    """Where the anchor is now: in place, else with its context, else nearest, else between its contexts, else as it was."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(t) - F.length(text) + 1, F.lit(1))), lambda p: F.substring(t, p, F.length(text)) == text)
    near_of = lambda a: F.get(F.transform(F.array_sort(F.transform(a, lambda p: F.struct(F.abs(p - 1 - near).alias("d"), p.alias("p")))), lambda x: x["p"] - 1), 0)
    whole = F.instr(t, F.concat(before, text)) - 1
    gap = F.instr(t, before) - 1
    return F.when(F.substring(t, near + 1, F.length(text)) == text, near).when((before != "") & (whole >= 0), whole + F.length(before)).when(F.size(places) > 0, near_of(places)).when((before != "") & (gap >= 0), gap + F.length(before)).otherwise(near)


def refine_passage(t: Column, near: Column, passage: Column) -> Column:
    """Place of the passage's first 120 characters, else what its last 120 tell, else as it was."""
    head, tail = F.substring(passage, 1, 120), F.substring(passage, -120, 120)
    at_head, at_tail = F.instr(t, head), F.instr(t, tail)
    return F.when(at_head > 0, at_head - 1).when(at_tail > 0, F.greatest(F.lit(0), at_tail - 1 + F.length(tail) - F.length(passage))).otherwise(near)


def context_line(t: Column, token: Column, size: int = 240) -> Column:
    """The token's line, of which at most ``size`` characters around it."""
    at = F.instr(t, token)
    begin = at - F.instr(F.reverse(F.substring(t, F.lit(1), at - 1)), F.lit("\n"))
    begin = F.when(F.contains(F.substring(t, F.lit(1), at - 1), F.lit("\n")), begin + 1).otherwise(1)
    line = F.substring_index(F.substring(t, begin, F.length(t)), "\n", 1)
    return F.when(at > 0, F.substring(line, F.greatest(F.instr(line, token) - size // 2, F.lit(1)), F.lit(size)))


def speech_text(t: Column) -> Column:
    return F.regexp_replace(t, LIST_MARK, "")


def is_resegmentation(token: Column, corrected: Column) -> Column:
    """Same letters and digits, and some."""
    bare = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")
    return (bare(token) == bare(corrected)) & (bare(token) != "")


def without_caption(title: Column) -> Column:
    """A chapter's title without the sentence of a picture's caption run into it."""
    t = trim_ws(title)
    chapter = F.regexp_extract(t, CAPTION_PREFIX, 2)
    return F.when(chapter != "", trim_ws(chapter)).otherwise(t)


def normal_toc_title(title: Column) -> Column:
    """A contents title with its marker once, and from a section's number on where a dozen characters of prose come before that."""

    def section(t: Column) -> Column:
        found = F.regexp_substr(t, F.lit(EMBEDDED_SECTION))
        at = F.instr(t, found)
        before = trim_ws(F.substring(t, F.lit(1), at - 1))
        return F.when(found.isNotNull() & (F.length(before) >= 12) & before.rlike(r"\p{Ll}"), trim_ws(F.substring(t, at, F.length(t)))).otherwise(t)

    return bind(F.regexp_replace(trim_ws(title), TWICE_MARKED, "$1"), section)


def strip_watermarks(t: Column) -> Column:
    for p in WATERMARKS:
        t = F.regexp_replace(t, p, " ")
    return F.regexp_replace(t, r" {2,}", " ")


def purpose_prefix(purpose: str) -> str:
    """What an asymmetric embedder puts before a text."""
    return {"query": "search_query: ", "document": "search_document: "}[purpose]


def prefixed(t: Column, purpose: str) -> Column:
    return F.concat(F.lit(purpose_prefix(purpose)), t)
