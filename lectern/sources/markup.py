"""Parsers of single documents: Markdown blocks, HTML text, RTF, DOCX and EPUB. Plain functions of text or bytes."""

from __future__ import annotations

import html as _html
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from html.parser import HTMLParser

# Line shapes of Markdown and the replacements inside a line, in order.
HEADING, RULE, BULLET, NUMBER, QUOTE = r"^(#{1,6})\s+(.*)$", r"^(-{3,}|\*{3,}|_{3,})$", r"^[-*+]\s+(.*)$", r"^(\d+)[\.\)]\s+(.*)$", r"^>\s?(.*)$"
FENCE, REFERENCE, DIV = r"^ {0,3}(`{3,}|~{3,})", r"^ {0,3}\[([^\]]+)\]:[ \t]+(\S+)", r"^\s*:{3,}\s*(\{[^}]*\}|[A-Za-z][\w-]*)?\s*:*\s*$"
INLINE = [
    (r"`([^`]*)`", r"\1"), (r"\*\*([^*]+)\*\*", r"\1"), (r"__([^_]+)__", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"_([^_]+)_", r"\1"),
    (r"!\[([^\]]*)\]\([^)]+\)", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"<(https?://[^>\s]+|mailto:[^>\s]+)>", r"\1"),
    (r"<!--[\s\S]*?-->", ""), (r"</?[A-Za-z][^>]*>", ""),
]


def clean_inline(text: str) -> str:
    for pattern, to in INLINE:
        text = re.sub(pattern, to, text)
    text = re.sub(r"\\([\\`*_{}\[\]()#+\-.!>])", r"\1", text)
    return re.sub(r"\s+", " ", text).strip()


def markdown_blocks(source: str) -> list[tuple[str, int, str]]:
    """(kind, level, text). A YAML head, reference definitions and div markers go; fenced code is verbatim, closed or not."""
    lines = source.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines and lines[0].strip() == "---" and any(x.strip() in ("---", "...") for x in lines[1:]):
        lines = lines[next(n for n, x in enumerate(lines[1:], 1) if x.strip() in ("---", "...")) + 1 :]
    out: list[tuple[str, int, str]] = []
    held: list[str] = []
    kind = ""

    def close() -> None:
        nonlocal kind
        text = clean_inline(" ".join(held))
        if text:
            out.append((kind, 0, text))
        held.clear()
        kind = ""

    n = 0
    while n < len(lines):
        line, s = lines[n], lines[n].strip()
        n += 1
        if m := re.match(FENCE, line):
            close()
            code = []
            while n < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[n]):
                code.append(lines[n])
                n += 1
            n += 1
            out.append(("code", 0, "\n".join(code)))
        elif not s or re.match(REFERENCE, line) or re.match(DIV, line):
            close()
        elif kind == "prose" and re.match(r"^(=+|-+)$", s):
            level = 1 if s[0] == "=" else 2
            text = clean_inline(" ".join(held))
            held.clear()
            kind = ""
            out.append(("heading", level, text))
        elif m := re.match(HEADING, s):
            close()
            out.append(("heading", len(m[1]), clean_inline(re.sub(r"\s+#+\s*$", "", m[2]))))
        elif re.match(RULE, s):
            close()
            out.append(("horizontal_rule", 0, ""))
        elif m := re.match(BULLET, s) or re.match(NUMBER, s):
            close()
            out.append(("list_item", 0, clean_inline(m[m.lastindex])))
        elif m := re.match(QUOTE, s):
            if kind != "blockquote":
                close()
            kind = "blockquote"
            held.append(m[1])
        else:
            if kind != "prose":
                close()
            kind = "prose"
            held.append(s)
    close()
    return out


_BLOCKS = {"p", "div", "section", "article", "li", "ul", "ol", "table", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "header", "footer", "main", "figure", "title"}
_SKIP = {"script", "style", "noscript", "nav", "template", "head"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str]] = []
        self.held: list[str] = []
        self.skip, self.kind, self.level, self.lists = 0, "prose", 0, []

    def close_block(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.held)).strip()
        if text:
            self.blocks.append((self.kind, self.level, text))
        self.held, self.kind, self.level = [], "prose", 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        if tag in _BLOCKS:
            self.close_block()
        if re.fullmatch("h[1-6]", tag):
            self.kind, self.level = "heading", int(tag[1])
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            self.kind = "list_item"
            if self.lists:
                self.lists[-1][1] += 1
                self.held.append("• " if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}. ")
        elif tag == "blockquote":
            self.kind = "blockquote"
        elif tag == "pre":
            self.kind = "code"

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        if tag in _BLOCKS:
            self.close_block()
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)


def html_blocks(source: str) -> list[tuple[str, int, str]]:
    """(kind, level, text) of the page's text; list items carry their marks."""
    parser = _Text()
    parser.feed(source)
    parser.close()
    parser.close_block()
    return parser.blocks


def article(source: str, least: int = 200) -> str:
    """The text of the element that holds most of the paragraphs' text; the whole text if that is short."""
    whole = "\n\n".join(t for _, _, t in html_blocks(source))
    bodies = re.findall(r"(?is)<(article|main)\b[^>]*>(.*?)</\1\s*>", source)
    best = max(("\n\n".join(t for _, _, t in html_blocks(b)) for _, b in bodies), key=len, default="")
    return best if len(best) >= least else whole


def rtf_paragraphs(data: bytes) -> list[tuple[str, float]]:
    """(text, font size in points) of each paragraph."""
    text = data.decode("latin-1")
    out, held, stack = [], [], []
    size, skip, uc, at = 12.0, False, 1, 0
    sizes: list[float] = []
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|([^\\{}\r\n]+)", text):
        word, number, hexed, sign, brace, plain = m.groups()
        if m.start() < at:  # what stands in for a Unicode character is passed over, and no more
            if not plain or m.end() <= at:
                continue
            plain = text[at : m.end()]
        if brace == "{":
            stack.append((size, skip))
        elif brace == "}":
            size, skip = stack.pop() if stack else (size, skip)
        elif sign == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer"):
            skip = True
        elif word in ("par", "pard", "sect", "page") and word != "pard":
            joined = "".join(held).strip()
            if joined:
                out.append((joined, max(set(sizes), key=sizes.count) if sizes else size))
            held, sizes = [], []
        elif skip:
            continue
        elif word == "fs" and number:
            size = int(number) / 2
        elif word == "uc" and number:
            uc = int(number)
        elif word == "u" and number:
            held.append(chr(int(number) % 65536))
            at = m.end() + uc
        elif word in ("tab", "line"):
            held.append("\t" if word == "tab" else "\n")
        elif word in ("emdash", "endash", "lquote", "rquote", "ldblquote", "rdblquote", "bullet"):
            held.append({"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}[word])
        elif hexed:
            held.append(bytes([int(hexed, 16)]).decode("cp1252", "replace"))
        elif sign in ("\\", "{", "}", "~"):
            held.append(" " if sign == "~" else sign)
        elif plain:
            held.append(plain)
            sizes += [size] * len(plain)
    if joined := "".join(held).strip():
        out.append((joined, max(set(sizes), key=sizes.count) if sizes else size))
    return out


def rtf_blocks(data: bytes) -> list[tuple[str, int, str]]:
    """Paragraphs; those of at least 1.15 times the body's size and at most 200 characters are headings, unless too many are."""
    paras = rtf_paragraphs(data)
    weight: dict[float, int] = {}
    for t, s in paras:
        weight[s] = weight.get(s, 0) + len(t)
    body = max(weight, key=lambda s: (weight[s], s), default=12.0)
    heads = {n for n, (t, s) in enumerate(paras) if s >= 1.15 * body and len(t) <= 200}
    if len(heads) > max(50, len(paras) // 4):
        heads = set()
    top = sorted({paras[n][1] for n in heads}, reverse=True)[:3]
    return [("heading", (top.index(s) if s in top else 2) + 1, t) if n in heads else ("prose", 0, t) for n, (t, s) in enumerate(paras)]


# Titles of navigation, bare numbers and letters, and a caption before a chapter's title.
NAV = [r"(?i)project\s+gutenberg.{0,25}licen[sc]e", r"(?i)^\[\s*p(?:g|age)\s*\d+\s*\]$"]
ENUMERATOR = r"^(?:[IVXLCDMivxlcdm]+|\d{1,4}|[A-Za-z])\.?$"
CAPTION = "(?i)^(.+?[.!?][\"'“”‘’]?\\s+)(chapter\\s+[ivxlcdm0-9]+\\b.*)$"

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(data: bytes) -> list[tuple[str, int, str]]:
    """Paragraphs, headings by style, list items, and tables as rows of cells."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    body = root.find(f"{_W}body")
    text_of = lambda e: "".join((x.text or "") if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in e.iter()).strip()
    out = []
    for e in body if body is not None else []:
        if e.tag == f"{_W}p" and (t := text_of(e)):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            if m := re.match(r"(?i)heading\s*([1-6])$", name):
                out.append(("heading", int(m[1]), t))
            elif name.lower() == "title":
                out.append(("heading", 1, t))
            elif e.find(f"{_W}pPr/{_W}numPr") is not None:
                out.append(("list_item", 0, t))
            else:
                out.append(("prose", 0, t))
        elif e.tag == f"{_W}tbl":
            rows = [" | ".join(text_of(c) for c in r.iter(f"{_W}tc")) for r in e.iter(f"{_W}tr")]
            out.append(("table", 0, "\n".join(rows)))
    return out


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def epub_blocks(data: bytes) -> list[tuple[str, int, str]]:
    """The spine's chapters in order, a page break between them."""
    z = zipfile.ZipFile(io.BytesIO(data))
    container = ET.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.get("full-path") for e in container.iter() if _local(e) == "rootfile")
    package = ET.fromstring(z.read(opf))
    items = {e.get("id"): e.get("href") for e in package.iter() if _local(e) == "item"}
    out: list[tuple[str, int, str]] = []
    for ref in (e.get("idref") for e in package.iter() if _local(e) == "itemref"):
        path = posixpath.normpath(posixpath.join(posixpath.dirname(opf), _html.unescape(items.get(ref) or "")))
        if path in z.namelist():
            out += [("page_break", 0, "")] * bool(out) + html_blocks(z.read(path).decode("utf-8", "replace"))
    return out


def _package(data: bytes):
    """(archive, folder of the package file, its items by id, hrefs of the spine in order, the nav item's and the NCX's href or None)."""
    z = zipfile.ZipFile(io.BytesIO(data))
    container = ET.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.get("full-path") for e in container.iter() if _local(e) == "rootfile")
    package = ET.fromstring(z.read(opf))
    items = {e.get("id"): e for e in package.iter() if _local(e) == "item"}
    spine = [items[e.get("idref")].get("href") for e in package.iter() if _local(e) == "itemref" and e.get("idref") in items]
    nav = next((e.get("href") for e in items.values() if "nav" in (e.get("properties") or "").split()), None)
    ncx = next((e.get("href") for e in items.values() if e.get("media-type") == "application/x-dtbncx+xml"), None)
    return z, posixpath.dirname(opf), items, spine, nav, ncx


def _nav_entries(source: str) -> list[tuple[str, str, int]]:
    """(title, href, level) of an EPUB 3 navigation document's contents; lists in lists are deeper levels."""
    m = re.search(r"""(?si)<nav\b[^>]*epub:type\s*=\s*["'][^"']*\btoc\b[^"']*["'][^>]*>(.*?)</nav\s*>""", source) or re.search(r"(?si)<nav\b[^>]*>(.*?)</nav\s*>", source)
    out, level = [], 0
    for t in re.finditer(r"""(?si)<(/?)ol\b[^>]*>|<a\b[^>]*href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>""", m[1] if m else ""):
        if t[2] is None:
            level += -1 if t[1] else 1
        else:
            out.append((re.sub(r"\s+", " ", _html.unescape(re.sub(r"<[^>]+>", "", t[3]))).strip(), _html.unescape(t[2]), max(1, level)))
    return out


def _ncx_entries(source: bytes) -> list[tuple[str, str, int]]:
    """(title, href, level) of an EPUB 2 NCX, in the order of the file."""
    out: list[tuple[str, str, int]] = []

    def walk(e: ET.Element, level: int) -> None:
        for point in (c for c in e if _local(c) == "navPoint"):
            title = next(("".join(x.itertext()).strip() for x in point if _local(x) == "navLabel"), "")
            href = next((x.get("src", "") for x in point if _local(x) == "content"), "")
            out.append((re.sub(r"\s+", " ", title), href, level))
            walk(point, level + 1)

    for nav_map in (e for e in ET.fromstring(source).iter() if _local(e) == "navMap"):
        walk(nav_map, 1)
    return out


def epub_contents(data: bytes) -> list[tuple[str, int, int, int]]:
    """(title, offset, level, play order): the navigation document's contents, else the NCX's, else one entry for each item of the spine.

    Offsets are places in the chapters' texts, joined by two line feeds: where an anchor's element starts, else its file; -1 where neither is known.
    Titles of navigation go, and a caption run into a chapter's title.
    """
    z, folder, _, spine, nav, ncx = _package(data)
    at = lambda href: posixpath.normpath(posixpath.join(folder, _html.unescape(href)))
    names, places, size = set(z.namelist()), {}, 0
    sources = [(href, z.read(at(href)).decode("utf-8", "replace")) for href in spine if at(href) in names]
    for href, source in sources:
        bare = posixpath.basename(href.split("#")[0])
        places[bare] = size
        for m in re.finditer(r"""(?si)<[a-z][^>]*\b(?:id|name)\s*=\s*["']([^"']+)["'][^>]*>""", source):
            before = "\n\n".join(t for _, _, t in html_blocks(source[: m.start()]))
            places.setdefault(f"{bare}#{m[1]}", size + len(before) + 2 * bool(before))
        size += len("\n\n".join(t for _, _, t in html_blocks(source))) + 2
    raw: list[tuple[str, str, int]] = []
    if nav and at(nav) in names:
        raw = _nav_entries(z.read(at(nav)).decode("utf-8", "replace"))
    elif ncx and at(ncx) in names:
        raw = _ncx_entries(z.read(at(ncx)))
    out = []
    for n, (title, href, level) in enumerate(raw, 1):
        nothing = not title or any(re.search(p, title) for p in NAV) or (level >= 2 and re.match(ENUMERATOR, title))
        if not nothing:
            bare, _, anchor = href.partition("#")
            bare = posixpath.basename(bare)
            chapter = re.match(CAPTION, title)
            out.append((chapter[2].strip() if chapter else title, places.get(f"{bare}#{anchor}", places.get(bare, -1)), level, n))
    if out:
        return out
    for n, (href, source) in enumerate(sources, 1):
        found = [re.sub(r"<[^>]+>", "", m[1]) for p in (r"(?si)<h[1-3][^>]*>(.*?)</h[1-3]>", r"(?si)<title[^>]*>(.*?)</title>") if (m := re.search(p, source))]
        title = next((t for t in (re.sub(r"\s+", " ", _html.unescape(x)).strip() for x in found) if t), "")
        stem = posixpath.basename(href).rsplit(".", 1)[0]
        if not title and stem and stem not in ("ch", "index") and not stem.isnumeric():
            title = stem.replace("_", " ").replace("-", " ").strip()
        out.append((title or f"Chapter {n}", places[posixpath.basename(href.split("#")[0])], 1, n))
    return out


def rtf_headings(data: bytes, text: str) -> list[tuple[str, int, int]]:
    """(title, level, offset) of an RTF file's headings in its text: looked for by 40 characters, else by eight or more plain ones, each past the last and past lines of a listing."""
    weight: dict[float, int] = {}
    paras = rtf_paragraphs(data)
    for t, size in paras:
        weight[size] = weight.get(size, 0) + len(t)
    body = max(weight, key=lambda x: (weight[x], x), default=12.0)
    heads = [(t, size) for t, size in paras if size >= 1.15 * body and len(t) <= 200]
    top = sorted({size for _, size in heads}, reverse=True)[:3]
    out, at = [], 0
    for title, size in heads:
        needle = re.sub(r"\s+", " ", title).strip()[:40]
        place = text.find(needle, at)
        if place < 0:
            needle = (re.match(r"[\x00-\x7f]*", re.sub(r"\s+", " ", title).strip())[0]).strip()
            place = text.find(needle, at) if len(needle) >= 8 else -1
        if place < 0:
            continue
        end = text.find("\n", place)
        line = text[place : len(text) if end < 0 else end].strip()
        out.append((line or title, (top.index(size) if size in top else 2) + 1, place))
        at = place + len(needle)
        while m := re.compile(r"[^\n]*\n?").match(text, at):
            bare = m[0].strip()
            if not m[0] or (bare and not re.match(r"^.+?(?:\t+|\.{4,})\s*\d+\s*$", bare)):
                break
            at = m.end()
    return out


def rtf_images(data: bytes) -> list[tuple[str, bytes, str]]:
    """(format, bytes, the up to 60 characters of text before it) of pictures given in hexadecimal; broken ones are left out."""
    out = []
    for m in re.finditer(rb"\{\\(?:\*\\shppict\s*\{\\)?pict\b(.*?)\}", data, re.S):
        body = m[1]
        kind = "png" if rb"\pngblip" in body else "jpeg" if rb"\jpegblip" in body else None
        digits = re.sub(rb"\s+", b"", re.sub(rb"\\[a-z]+-?\d* ?|\{[^}]*\}", b"", body))
        if kind and digits and len(digits) % 2 == 0 and re.fullmatch(rb"[0-9a-fA-F]+", digits):
            before = " ".join(t for t, _ in rtf_paragraphs(data[: m.start()]))
            out.append((kind, bytes.fromhex(digits.decode()), before[-60:]))
    return out


def text_of(data: bytes) -> str:
    """Bytes as text by the first encoding that takes them all."""
    for name in ("utf-8-sig", "utf-16") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8-sig", "cp1252", "latin-1"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def text_blocks(data: bytes) -> list[tuple[str, int, str]]:
    """Paragraphs of plain text, hard-wrapped lines joined."""
    paras = re.split(r"\n\s*\n", text_of(data).replace("\r\n", "\n").replace("\r", "\n"))
    return [("prose", 0, t) for t in (" ".join(x.strip() for x in p.split("\n") if x.strip()) for p in paras) if t]


PARSERS = {
    "txt": text_blocks,
    "md": lambda b: markdown_blocks(text_of(b)),
    "html": lambda b: html_blocks(text_of(b)),
    "rtf": rtf_blocks,
    "docx": docx_blocks,
    "epub": epub_blocks,
}


def sniff(data: bytes, name: str = "") -> str:
    """Format by the first bytes, and by the name where those don't tell."""
    if data.startswith(b"%PDF-"):
        return "pdf"
    if data.startswith(b"{\\rtf"):
        return "rtf"
    if data.startswith(b"PK\x03\x04"):
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
        return "docx" if "word/document.xml" in names else "epub" if "META-INF/container.xml" in names else "zip"
    end = name.rsplit(".", 1)[-1].lower()
    return {"markdown": "md", "htm": "html", "xhtml": "html"}.get(end, end) if end in {"txt", "md", "markdown", "html", "htm", "xhtml"} else "txt"
