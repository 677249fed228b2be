"""HTML as text columns: chrome, headings, bylines, images, entities."""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rewrite import trim_ws

# Elements that are not content.
CHROME = [
    r"""(?si)<table[^>]*\bclass\s*=\s*["'][^"']*\binfobox\b[^"']*["'][^>]*>.*?</table\s*>""",
    r"""(?si)<table[^>]*\bclass\s*=\s*["'][^"']*\b(?:navbox|vertical-navbox)\b[^"']*["'][^>]*>.*?</table\s*>""",
    r"""(?si)<(?:div|table)[^>]*\bclass\s*=\s*["'][^"']*\b(?:sidebar|hatnote|dablink)\b[^"']*["'][^>]*>.*?</(?:div|table)\s*>""",
    r"""(?si)<span[^>]*\bclass\s*=\s*["'][^"']*\bmw-editsection\b[^"']*["'][^>]*>.*?(?:\]|&#93;)\s*</span>\s*</span>""",
    r"""(?si)<figure\b[^>]*>(?:(?!</figure>).)*?<audio\b(?:(?!</figure>).)*?</figure\s*>""",
    r"""(?si)<span[^>]*\bclass\s*=\s*["'][^"']*\bcitation-comment\b[^"']*["'][^>]*>.*?</span\s*>""",
    r"""(?si)<span[^>]*\bclass\s*=\s*["'][^"']*\bmw-cite-backlink\b[^"']*["'][^>]*>.*?</span\s*>""",
]
SCAN_LINK = r"""(?si)<a\b[^>]*\bhref\s*=\s*["'][^"']*\.(?:jpe?g|png|gif)["'][^>]*>(?:\s|<[^>]*>)*Original(?:\s|</[^>]*>)*</a\s*>"""
CODE_HEADERS = [
    r"""(?si)<div[^>]*\bclass\s*=\s*["'][^"']*\bexample-header\b[^"']*["'][^>]*>.*?</div\s*>""",
    r"""(?si)<span[^>]*\bclass\s*=\s*["'][^"']*\blanguage-name\b[^"']*["'][^>]*>.*?</span\s*>""",
]
ASTERISM_BLOCK = r"""(?si)<(p|div)[^>]*\bclass\s*=\s*(?:"[^"]*\basterism\b[^"]*"|'[^']*\basterism\b[^']*')[^>]*>.*?</\1\s*>"""
EMBEDDED_TOC = [
    r"""(?si)<(p|div)[^>]*\bclass\s*=\s*(?:"[^"]*\btoc\b[^"]*"|'[^']*\btoc\b[^']*')[^>]*>.*?</\1\s*>""",
    r"""(?si)<nav[^>]*\b(?:epub:type|id)\s*=\s*"toc"[^>]*>.*?</nav\s*>""",
]
DROPCAP = r"""(?si)<span\s+[^>]*\b(?:style\s*=\s*["'][^"']*\bfloat\s*:[^"']*["']|class\s*=\s*["'][^"']*\b(?:dropcap|initial|first[\s-]?character|first[\s-]?letter|letra)\b[^"']*["'])[^>]*>([^<]{1,3})</span\s*>"""
# Titles of navigation, and at a second level and deeper bare numbers and letters.
NAV = [r"(?i)project\s+gutenberg.{0,25}licen[sc]e", r"(?i)^\[\s*p(?:g|age)\s*\d+\s*\]$"]
ENUMERATOR = r"^(?:[IVXLCDMivxlcdm]+|\d{1,4}|[A-Za-z])\.?$"
# Headings of a page's frame, and what tells an author's name from a heading.
FRAME = [
    "references", "external links", "see also", "notes", "citations", "bibliography", "further reading", "sources", "footnotes", "contents",
    "navigation menu", "navigation", "tools", "languages", "in this article", "related topics", "related articles", "explanation", "site map",
]
HEADING = r"(?si)<h([1-6])\b([^>]*)>(.*?)</h\1\s*>"
AUTHOR_MARKS = ['href="/author/', 'rel="author"', 'itemprop="author"']
WRITTEN_BY = r"(?i)^\s*written by\b"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
HATNOTE = r"(?i)^(?:main article|see also|further information|part of a series|this article|from wikipedia)\b"


def strip_chrome(h: Column) -> Column:
    """Without infoboxes, side bars, edit links, scan links, code headers, embedded contents and scene breaks."""
    for p in [*CHROME, ASTERISM_BLOCK, *EMBEDDED_TOC]:
        h = F.regexp_replace(h, p, " ")
    for p in [SCAN_LINK, *CODE_HEADERS]:
        h = F.regexp_replace(h, p, "")
    return F.regexp_replace(h, DROPCAP, "$1")


def inner_text(h: Column) -> Column:
    """Text of a heading: a space for each tag and one for each run of spaces, the commonest character references resolved."""
    t = F.regexp_replace(h, r"<[^>]+>", " ")
    for was, new in ENTITIES:
        t = F.replace(t, F.lit(was), F.lit(new))
    return trim_ws(F.regexp_replace(t, r"\s+", " "))


def _marked(h: Column) -> Column:
    """Array of (level, text, author) of h1 to h6 that have a text, in order; ``author`` tells a byline."""
    part = lambda n: F.regexp_extract_all(h, F.lit(HEADING), F.lit(n))
    rows = F.arrays_zip(part(1).alias("level"), part(2).alias("attrs"), part(3).alias("inner"))

    def told(x: Column) -> Column:
        inner, text = F.lower(x["inner"]), inner_text(x["inner"])
        author = F.contains(F.lower(x["attrs"]), F.lit("author")) | text.rlike(WRITTEN_BY)
        for mark in AUTHOR_MARKS:
            author = author | F.contains(inner, F.lit(mark))
        return F.struct(x["level"].cast("int").alias("level"), text.alias("text"), author.alias("author"))

    return F.filter(F.transform(rows, told), lambda x: x["text"] != "")


def headings(h: Column) -> Column:
    """The texts of h1 to h6, in order, without bylines."""
    return F.transform(F.filter(_marked(h), lambda x: ~x["author"]), lambda x: x["text"])


def heading_levels(h: Column) -> Column:
    """(level, text) of h1 to h6, in order, without bylines."""
    return F.transform(F.filter(_marked(h), lambda x: ~x["author"]), lambda x: F.struct(x["level"].alias("level"), x["text"].alias("text")))


def byline(h: Column) -> Column:
    """The author that the first byline names, without ``Written by``; else null."""
    name = trim_ws(F.regexp_replace(F.get(F.filter(_marked(h), lambda x: x["author"]), 0)["text"], r"(?i)^\s*written by\s+", ""))
    return F.when(name != "", name)


def with_byline(text: Column, h: Column) -> Column:
    """The page's text behind ``By`` and its author, where a byline names one."""
    return F.coalesce(F.concat(F.lit("By "), byline(h), F.lit("\n\n"), text), text)


def image_sources(h: Column) -> Column:
    """Sources of inline images: data and file addresses that aren't SVG."""
    found = F.regexp_extract_all(h, F.lit(r"""(?i)<img[^>]+src=["']([^"']+)["'][^>]*/?>"""), F.lit(1))
    return F.filter(found, lambda s: s.rlike(r"(?i)^(data:image/(?!svg)|file:)"))


def image_bytes(source: Column) -> Column:
    """The content of a data address in base 64; else null."""
    return F.when(source.rlike(r"(?i)^data:[^,]*;base64,"), F.try_to_binary(F.substring_index(source, ",", -1), F.lit("base64")))


def is_nav(title: Column, level: Column | None = None) -> Column:
    """Titles of navigation rather than content: none, a licence, a page's mark, or a bare number or letter below the first level."""
    s = trim_ws(title)
    found = s == ""
    for p in NAV:
        found = found | s.rlike(p)
    return found if level is None else found | ((level >= 2) & s.rlike(ENUMERATOR))


def resolve_offsets(text: str, titles: list[tuple[int, str]]) -> list[tuple[str, int, int]]:
    """(title, level, offset): titles looked for one after the other, whatever white space lies between their words; those not found are left out."""
    out, at = [], 0
    for level, title in titles:
        if words := title.split():
            if m := re.compile(r"\s+".join(map(re.escape, words))).search(text, at):
                out.append((title, level, m.start()))
                at = m.end()
    return out


def fold(s: str) -> str:
    """Curly quotes and dashes as plain ones, each one character."""
    return s.translate(str.maketrans("‘’“”–—", "''\"\"--"))


def _prose(html: str) -> list[str]:
    """Texts of paragraphs, items and quotes, but hatnotes."""
    found = (re.sub(r"\s+", " ", _html.unescape(re.sub(r"<[^>]+>", " ", m[2]))).strip() for m in re.finditer(r"(?si)<(p|li|blockquote|dd)\b[^>]*>(.*?)</\1\s*>", html))
    return [t for t in found if not re.match(HATNOTE, t)]


def sections(html: str) -> list[tuple[int, str, str]]:
    """(level, title, how its first paragraph begins) of headings that head prose of their own; frame headings and bylines don't."""
    out = []
    for m in re.finditer(HEADING, html):
        title = re.sub(r"\s+", " ", _html.unescape(re.sub(r"<[^>]+>", " ", m[3]))).strip()
        author = "author" in m[2].lower() or any(x in m[3].lower() for x in AUTHOR_MARKS) or re.match(WRITTEN_BY, title)
        if not title or title.lower() in FRAME or author:
            continue
        tail = re.split(r"(?i)<h[1-6]\b", html[m.end() :], maxsplit=1)[0]
        if first := next((t for t in _prose(tail) if len(t) >= 24), None):
            out.append((int(m[1]), title, first[:80].strip()))
    return out


def restore_headings(text: str, specs: list[tuple[int, str, str]]) -> tuple[str, list[tuple[int, str]]]:
    """(text, headings): headings that a reader's extract of the page lost, put back before the prose they head.

    A heading whose words stand in the 300 characters before its prose, whatever the white space, has survived.
    """
    folded, at, puts, kept = fold(text), 0, [], []
    flat = lambda s: re.sub(r"\s+", " ", s)
    for level, title, anchor in specs:
        place = folded.find(fold(anchor), at)
        if place < 0:
            continue
        if flat(fold(title)) not in flat(folded[max(at, place - 300) : place]):
            puts.append((place, f"{title}\n\n"))
        kept.append((level, title))
        at = place + len(anchor)
    for place, put in reversed(puts):
        text = text[:place] + put + text[place:]
    return text, kept


def restore_lede(text: str, html: str) -> str:
    """The text behind the paragraphs between the page's title and first section that it lost; none if the first of them is there."""
    parts = re.split(r"(?si)</h1\s*>", html, maxsplit=1)
    if len(parts) < 2:
        return text
    region, folded, lost = re.split(r"(?si)<h2\b", parts[1], maxsplit=1)[0], fold(text), []
    for t in _prose(region):
        if len(t) < 60 or not (". " in t or t.endswith(".")):
            continue
        if fold(t[:60]) in folded:
            break
        lost.append(t)
    return "\n\n".join([*lost, text]) if lost else text


def decode_entities(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the column's character references resolved."""
    at = df.columns.index(column)

    def run(batches):
        for b in batches:
            out = pa.array([None if (v := x.as_py()) is None else _html.unescape(v) for x in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], out, *b.columns[at + 1 :]], schema=b.schema)

    return df.mapInArrow(run, T.StructType(df.schema.fields))
