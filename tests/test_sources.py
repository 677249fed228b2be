"""Files of our own making: EPUB contents, RTF headings and pictures, plain text, DOCX; and cut of Markdown."""

import io
import re
import zipfile

from lectern.sources import files, markup

CHAPTERS = {
    "text/one.xhtml": '<html><head><title>x</title></head><body><h2 id="a">CHAPTER I. Start</h2><p>First words.</p><p id="mid">More of it.</p></body></html>',
    "text/two-b.xhtml": "<html><body><p>No heading here.</p></body></html>",
    "text/3.xhtml": "<html><head><title>A Titled Page</title></head><body><p>Third.</p></body></html>",
}


def epub(nav=None, ncx=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{n}" href="{h}" media-type="application/xhtml+xml"/>' for n, h in enumerate(CHAPTERS))
        items += '<item id="nav" href="nav.xhtml" properties="nav"/>' * bool(nav) + '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>' * bool(ncx)
        z.writestr("OPS/p.opf", f"<package><manifest>{items}</manifest><spine>{''.join(f'<itemref idref=\"c{n}\"/>' for n in range(len(CHAPTERS)))}</spine></package>")
        for h, body in CHAPTERS.items():
            z.writestr(f"OPS/{h}", body)
        if nav:
            z.writestr("OPS/nav.xhtml", nav)
        if ncx:
            z.writestr("OPS/toc.ncx", ncx)
    return out.getvalue()


WHOLE = "CHAPTER I. Start\n\nFirst words.\n\nMore of it.\n\nNo heading here.\n\nThird."


def test_contents_from_the_navigation_document():
    nav = """<html><nav epub:type="landmarks"><ol><li><a href="x">Cover</a></li></ol></nav><nav epub:type="toc"><ol>
    <li><a href="text/one.xhtml">A caption, "so." CHAPTER I. Start</a><ol><li><a href="text/one.xhtml#mid">The &amp; Middle</a></li><li><a href="text/one.xhtml#mid">II.</a></li></ol></li>
    <li><a href="text/two-b.xhtml#none">Two</a></li><li><a href="gone.xhtml">Gone</a></li><li><a href="text/3.xhtml">The Project Gutenberg License</a></li></ol></nav></html>"""
    got = markup.epub_contents(epub(nav=nav))
    assert got == [("CHAPTER I. Start", 0, 1, 1), ("The & Middle", WHOLE.index("More"), 2, 2), ("Two", WHOLE.index("No heading"), 1, 4), ("Gone", -1, 1, 5)]


def test_contents_from_an_ncx_and_from_the_spine():
    ncx = '<ncx><navMap><navPoint><navLabel><text>One</text></navLabel><content src="text/one.xhtml#a"/><navPoint><navLabel><text>Halfway</text></navLabel><content src="text/one.xhtml#mid"/></navPoint></navPoint></navMap></ncx>'
    assert markup.epub_contents(epub(ncx=ncx)) == [("One", 0, 1, 1), ("Halfway", WHOLE.index("More"), 2, 2)]
    want = [("CHAPTER I. Start", 0, 1, 1), ("two b", WHOLE.index("No heading"), 1, 2), ("A Titled Page", WHOLE.index("Third"), 1, 3)]
    assert markup.epub_contents(epub()) == want
    assert markup.epub_contents(epub(nav='<html><nav epub:type="toc"><ol><li><a href="x">[Pg 3]</a></li></ol></nav></html>')) == want


def test_contents_of_a_folder(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "c.epub").write_bytes(epub()[:60])
    rows = files.read_contents(spark, str(tmp_path)).collect()
    assert [r.title for r in rows if r.path.endswith("a.epub")] == ["CHAPTER I. Start", "two b", "A Titled Page"]
    assert not [r for r in rows if r.path.endswith("b.txt")] and [r.error for r in rows if r.path.endswith("c.epub")][0]


RTF = rb"""{\rtf1{\fonttbl{\f0 T;}}\fs48 The Big Title\par\fs32 Part One\par\fs24 Contents\par Part One....... 3\par Part Two\tab 9\par Body text that is long enough to be the body of it all.\par
{\pict\pngblip\picw1 89504e47
0d0a}\fs32 Part \u233? Two\par\fs24 And more of the body text here, as long as that.\par{\pict\wmetafile8 0102}{\pict\jpegblip ffd8f}}"""


def test_rtf_headings_lie_past_the_listing():
    text = "\n".join(t for t, _ in markup.rtf_paragraphs(RTF))
    got = markup.rtf_headings(RTF, text)
    assert [(t, level) for t, level, _ in got] == [("The Big Title", 1), ("Part One", 2), ("Part é Two", 2)]
    assert all(text[at:].startswith(t) for t, _, at in got) and [at for _, _, at in got] == sorted(at for _, _, at in got)


def test_rtf_images_are_read_from_hexadecimal():
    found = markup.rtf_images(RTF)
    assert [(k, b) for k, b, _ in found] == [("png", bytes.fromhex("89504e470d0a"))] and found[0][2].endswith("the body of it all.")


def test_text_by_its_encoding():
    for data in ("naïve".encode(), "naïve".encode("cp1252"), b"\xef\xbb\xbf" + "naïve".encode(), "naïve".encode("utf-16")):
        assert markup.text_of(data) == "naïve"
    assert markup.text_blocks(b"one\r\ntwo\r\n\r\nthree") == [("prose", 0, "one two"), ("prose", 0, "three")]


def test_docx_blocks():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>{run("Head")}</w:p><w:p>{run("Some ")}{run("prose")}</w:p><w:p><w:pPr><w:numPr/></w:pPr>{run("item")}</w:p><w:tbl><w:tr><w:tc><w:p>{run("a")}</w:p></w:tc><w:tc><w:p>{run("b")}</w:p></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    assert markup.docx_blocks(out.getvalue()) == [("heading", 2, "Head"), ("prose", 0, "Some prose"), ("list_item", 0, "item"), ("table", 0, "a | b")]
    assert markup.sniff(out.getvalue()) == "docx"


def plain_markdown(text):
    """Blocks of lines without fences, rules, underlines or references, said again."""
    out, held, kind = [], [], None

    def close():
        if held and (t := markup.clean_inline(" ".join(held))):
            out.append((kind, t))
        held.clear()

    for line in text.split("\n"):
        s = line.strip()
        if not s:
            close()
            kind = None
        elif m := re.match(r"(#{1,6})\s+(.*)$", s):
            close()
            kind = None
            out.append(("heading", markup.clean_inline(re.sub(r"\s+#+\s*$", "", m[2]))))
        elif m := re.match(r"[-*+]\s+(.*)$", s) or re.match(r"\d+[.)]\s+(.*)$", s):
            close()
            kind = None
            out.append(("list_item", markup.clean_inline(m[1])))
        else:
            want = "blockquote" if s[0] == ">" else "prose"
            if kind != want:
                close()
                kind = want
            held.append(re.sub(r"^>\s?", "", s))
    close()
    return out


def test_markdown_blocks_of_whole_documents(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        text = f"# Title {r.doc_id}\n\n{r.text}\n\n> a *quoted* line\n> goes on\n\n- item one\n2) item [two](http://x)\n"
        if re.search(r"(?m)^\s*(?:`{3}|~{3}|:{3}|[-=*_]{1,}\s*$|\[[^\]]+\]:)", r.text):
            continue
        assert [(k, t) for k, _, t in markup.markdown_blocks(text)] == plain_markdown(text), r.doc_id


def test_summary_layer_holds_every_leaf(spark, sf):
    from pyspark.sql import functions as F

    from lectern.operators import vectors as V
    from lectern.plans.search import vectors

    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    leaves = vectors(spark, sf).join(docs, "id")
    out = V.summary_layer(leaves, least_leaves=24).collect()
    assert sum(r.members for r in out) == leaves.count() or all(r.members >= 3 for r in out)
    assert out and all(r.summary for r in out) and V.summary_layer(leaves.limit(5), least_leaves=24).count() == 0
