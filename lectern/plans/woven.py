"""Columns of the shared tables with the cases woven in that the tables lack, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def replaced(t: Column, pairs: list[tuple[str, str]]) -> Column:
    for was, new in pairs:
        t = F.replace(t, F.lit(was), F.lit(new))
    return t


def literal(s: str) -> str:
    """A SQL string, with signs that aren't printable ASCII by number."""
    parts, held = [], ""
    for c in s:
        if " " <= c <= "~":
            held += c.replace("'", "''")
        else:
            if held:
                parts.append(f"'{held}'")
            parts.append(f"chr({ord(c)})")
            held = ""
    if held or not parts:
        parts.append(f"'{held}'")
    return "(" + " || ".join(parts) + ")"


def replaced_sql(t: str, pairs: list[tuple[str, str]]) -> str:
    for was, new in pairs:
        t = f"replace({t}, {literal(was)}, {literal(new)})"
    return t


#: What normalisation is for: returns, tabs, runs of spaces and line feeds, broken words, invisible, control and private characters.
DIRT = [
    ("_", "-"), (" t", "  \tt"), (" o", "\r\no"), (" p", "\rp"), (" b", " exam-\nple b"), (" w", " w­​"), (" e", "  \n\n\n\n e"), (" l", " \x07l"),
]
MARKS = " Evaluation Only. Created with Aspose.Words. Copyright 2024.  Generated by calibre 5.2 on a day. "


def dirty(t: Column) -> Column:
    return F.concat(F.lit("﻿"), replaced(t, DIRT), F.lit(MARKS))


def dirty_sql(t: str) -> str:
    return f"(chr(65279) || {replaced_sql(t, DIRT)} || {literal(MARKS)})"


def in_turn(key: Column, texts: list[str], other: Column) -> Column:
    """The texts by the key's remainder; ``other`` for what is left of ten."""
    out = other
    for n, t in enumerate(texts):
        out = F.when(key % 10 == n, F.lit(t)).otherwise(out)
    return out


def in_turn_sql(key: str, texts: list[str], other: str) -> str:
    return "(CASE " + " ".join(f"WHEN {key} % 10 = {n} THEN {literal(t)}" for n, t in enumerate(texts)) + f" ELSE {other} END)"


#: Turns of the kinds that the predicates are for.
SAID = [
    "?!.", "zzzz", " \n ", "The document doesn't mention it.", "Should I read it, or is this any good?", "Explain this", "Who was the co-author of it", "who ILLUSTRATED the cover",
]
#: Lines of a book around a document's own.
BEGIN = "CHAPTER I. The Start\nPreface\nContents\nPart One ..... 3\nPart Two ....... 17\nPart Three .... 40\n"
END = "\nChapter 2\nPROLOGUE\nIV\nChapter 3\nIII. The Third Part\nCHAPTER I. The Start\nPreface\nChapter 2\n1. the same long item\n2. the same long item\nTHE END\nBooks by the same hand"


def book(t: Column) -> Column:
    return F.concat(F.lit(BEGIN), t, F.lit(END))


def book_sql(t: str) -> str:
    return f"({literal(BEGIN)} || {t} || {literal(END)})"
