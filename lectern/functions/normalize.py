"""Text normalisation passes: each a Column -> Column, composed as the formats need."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rewrite import bind, rewrite, trim_ws

# Patterns that decide what counts as an artefact.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F-￰-�\x{E0100}-\x{E01EF}]"
HYPHENS = r"([A-Za-z]+)[-¬][ \n\x0c] ?([a-z]+)"
ITALICS = r"(?<![A-Za-z0-9_])_([^_\n]{1,80}?)_(?![A-Za-z0-9_])"
ASTERISMS = r"(?m)^\h*\*(?:\h+\*){1,}\h*$"
ILLUSTRATION = r"(?s)\[Illustration:?(.*?)\]"
PRINT_HEADERS = [
    r"\d{1,2}/\d{1,2}/\d{2,4},?\s+\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)?\s+The\s+Wayback\s+Machine\s+-\s+https?://[^\s]+",
    r"The\s+Wayback\s+Machine\s+-\s+https?://web\.archive\.org/[^\s]+",
]
SPACED_CAPITALS = r"(?<!\p{Lu})\p{Lu}(?: \p{Lu}){2,}(?!\p{Lu})"
SPACED_SMALL = r"(?<!\p{Ll})\p{Ll}(?: \p{Ll}){2,}(?!\p{Ll})"
SPACED_DIGITS = r"\d(?: \d){3,}"
DIMENSIONS = r"\d(?<![\d.]\d)\d*\.\d+ in\b"  # not the end of an address of four numbers
NUMERIC_BRACKETS = r"\[\s*\d[\d\s]*\]"


def strip_bom(t: Column) -> Column:
    return F.regexp_replace(t, "^﻿", "")


def strip_control(t: Column) -> Column:
    """Without control characters other than tab, line feed and return, private use and specials."""
    return F.regexp_replace(t, CONTROL, "")


def strip_invisible(t: Column) -> Column:
    """No-break spaces become spaces; soft hyphens and zero-width characters go."""
    return F.translate(t, " ­​‌‍", " ")


def line_endings(t: Column) -> Column:
    return F.regexp_replace(t, r"\r\n?", "\n")


def trailing_space(t: Column) -> Column:
    return F.regexp_replace(t, r"[ \t]+\n", "\n")


def tabs_and_spaces(t: Column) -> Column:
    return F.regexp_replace(F.translate(t, "\t", " "), r" {2,}", " ")


def join_hyphens(t: Column) -> Column:
    return F.regexp_replace(t, HYPHENS, "$1$2")


def blank_lines(t: Column) -> Column:
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def italics(t: Column) -> Column:
    return F.when(F.contains(t, F.lit("_")), F.regexp_replace(t, ITALICS, "$1")).otherwise(t)


def asterism_lines(t: Column) -> Column:
    lines = F.regexp_replace(t, "[  ]", "\n")
    return F.when(F.contains(t, F.lit("*")), F.regexp_replace(lines, ASTERISMS, "")).otherwise(lines)


def print_headers(t: Column) -> Column:
    out = t
    for p in PRINT_HEADERS:
        out = F.regexp_replace(out, p, "")
    return F.when(F.contains(t, F.lit("Wayback")), out).otherwise(t)


def illustration_markers(t: Column) -> Column:
    """A marker becomes a paragraph of its caption, cleaned of emphasis and credits; without caption it goes."""

    def caption(c: Column) -> Column:
        clean = F.regexp_replace(c, r"\[_[^\]]*", "")
        clean = F.regexp_replace(clean, r"_([^_]+)_", "$1")
        clean = F.trim(F.regexp_replace(F.regexp_replace(clean, "·[^·]*·", " "), r"\s+", " "))
        return F.when(F.length(clean) > 0, F.concat(F.lit("\n\n"), clean, F.lit("\n\n"))).otherwise("\n\n")

    return F.when(F.contains(t, F.lit("[Illustration")), rewrite(t, ILLUSTRATION, caption, 1)).otherwise(t)


def unwrap_lines(t: Column) -> Column:
    """Paragraphs (cut at blank lines) on one line each."""
    joined = F.transform(F.split(t, "\n\n"), lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n"), trim_ws), lambda x: x != ""), " "))
    return F.array_join(joined, "\n\n")


def spaced_letters(t: Column) -> Column:
    for p in (SPACED_CAPITALS, SPACED_SMALL):
        t = bind(t, lambda x: rewrite(x, p, lambda m: F.replace(m, F.lit(" "), F.lit(""))))
    return t


def spaced_digits(t: Column) -> Column:
    return rewrite(t, SPACED_DIGITS, lambda m: F.replace(m, F.lit(" "), F.lit("")))


def numeric_brackets(t: Column) -> Column:
    return rewrite(t, NUMERIC_BRACKETS, lambda m: F.regexp_replace(m, r"\s+", ""))


def dimensions(t: Column) -> Column:
    return tabs_and_spaces(F.regexp_replace(t, DIMENSIONS, ""))


def normalize(t: Column) -> Column:
    """The passes all formats share, in order."""
    for step in (strip_bom, strip_control, strip_invisible, line_endings, trailing_space, join_hyphens):
        t = step(t)
    for step in (print_headers, asterism_lines, illustration_markers):  # these look at the text more than once
        t = bind(t, step)
    return trim_ws(blank_lines(tabs_and_spaces(t)))


def normalize_universal(t: Column, hard_wrapped: bool = False) -> Column:
    t = normalize(t)
    return bind(unwrap_lines(t) if hard_wrapped else t, italics)


def normalize_page(t: Column) -> Column:
    """For page text layers: glyph repair, and single line feeds become spaces."""
    t = bind(bind(normalize_universal(t), spaced_letters), spaced_digits)
    return F.regexp_replace(t, r"(?<!\n)\n(?!\n)", " ")


def compact(t: Column) -> Column:
    """On one line."""
    return F.trim(F.regexp_replace(t, r"[\n ]+", " "))


def repair_text(text: str | None) -> str | None:
    """Undoes UTF-8 read as Windows-1252: a run of two to four such characters that decodes to one character becomes it."""
    if text is None or not any("\x80" <= c for c in text):
        return text
    raw: list[bytes | None] = []
    for c in text:
        try:
            raw.append(c.encode("cp1252"))
        except UnicodeEncodeError:
            raw.append(c.encode("latin-1") if "\x80" <= c <= "\x9f" else None)
    out, i = [], 0
    while i < len(text):
        for n in (4, 3, 2):
            run = raw[i : i + n]
            if len(run) == n and all(run) and run[0] >= b"\xc2":
                try:
                    one = b"".join(run).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if len(one) == 1:
                    out.append(one)
                    i += n
                    break
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def repair_mojibake(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the column repaired, in Arrow batches."""
    at = df.columns.index(column)

    def run(batches):
        for b in batches:
            fixed = pa.array([repair_text(x.as_py()) for x in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], fixed, *b.columns[at + 1 :]], schema=b.schema)

    return df.mapInArrow(run, T.StructType(df.schema.fields))
