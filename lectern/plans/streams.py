"""Streaming forms, file sources and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from ..streaming import fill, positions
from .registry import query, read, scratch
from .scans import reading_position  # noqa: F401  its SQL is the stream's oracle
from .registry import ORACLES


def _place(e):
    return e.where("value is not null").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("updated"), F.round("value").cast("long").alias("at"))


@query(ORACLES["reading_position"])
def stream_reading_position(spark, sf):
    schema = read(spark, sf, "events").schema
    path = scratch(spark, "positions")
    e = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    positions.track(_place(e), path, f"{path}-state").awaitTermination()
    versions = spark.read.option("basePath", path).parquet(path)
    last = versions.agg(F.max("v")).first()[0]
    return positions.read_version(spark, path, last).select(F.col("key").alias("user_id"), "latest", "furthest")


@query("SELECT doc_id, true AS filled FROM documents WHERE length(trim(text)) > 0")
def stream_null_fill(spark, sf):
    d = spark.readStream.schema(read(spark, sf, "documents").schema).parquet(f"{sf}/documents.parquet*")
    path = scratch(spark, "fill")
    rows = d.select("doc_id", "text", F.lit(None).cast("array<double>").alias("vec"))
    fill.fill_stream(rows, fill.hashed_embedder(), path, f"{path}-state").awaitTermination()
    return spark.read.parquet(path).where("vec is not null").select("doc_id", F.lit(True).alias("filled"))


@query("SELECT vec_id AS doc_id, true AS kept FROM embeddings")
def resume_by_null(spark, sf):
    """Vectors that are there stay as they are; null ones are filled."""
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("some words").alias("text"), F.when(F.col("vec_id") % 3 > 0, F.transform("embedding", lambda x: x.cast("double"))).alias("vec"), F.get("embedding", 0).cast("double").alias("first"))
    out = fill.fill(v, fill.hashed_embedder())
    return out.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.get("vec", 0) == F.col("first")).otherwise(F.size("vec") == 64).alias("kept"))


@query()
def html_units(spark, sf):
    u = files.parse_column(read(spark, sf, "pages"), "page_id", "html")
    return u.select("page_id", "sequence", "kind", "level", F.md5("text").alias("digest"))


@query()
def markdown_units(spark, sf):
    u = files.parse_column(read(spark, sf, "documents"), "doc_id", "text", "md")
    return u.select("doc_id", "sequence", "kind", F.md5("text").alias("digest"))


_FRAME = r"""<h1>A <b>Page</b><br>of   Words</h1><h4 class="gh-author-name"><a href="/author/x/">Some &amp; One</a></h4><h5>Written by Another</h5><h3><i> </i></h3>"""


def framed(h):
    """Pages behind a title with tags in it, an author's name and a byline."""
    return F.concat(F.lit(_FRAME), h)


@query(rf"""
WITH h AS (SELECT page_id, regexp_extract_all('{_FRAME}' || html, '(?is)<h[1-6]\b([^>]*)>(.*?)</h[1-6]\s*>', 1) AS a, regexp_extract_all('{_FRAME}' || html, '(?is)<h[1-6]\b([^>]*)>(.*?)</h[1-6]\s*>', 2) AS i FROM pages),
t AS (SELECT page_id, list_transform(list_zip(a, i), lambda x: {{'a': x[1], 'i': x[2], 't': trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(x[2], '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))}}) AS t FROM h)
SELECT page_id, md5(array_to_string(list_transform(list_filter(t, lambda x: x.t <> '' AND NOT contains(lower(x.a), 'author') AND NOT contains(lower(x.i), 'href="/author/') AND NOT contains(lower(x.i), 'rel="author"') AND NOT contains(lower(x.i), 'itemprop="author"') AND NOT regexp_matches(x.t, '(?i)^written by\b')), lambda x: x.t), '|')) AS headings FROM t""")
def html_headings(spark, sf):
    from ..functions.html import headings

    return read(spark, sf, "pages").select("page_id", F.md5(F.array_join(headings(framed(F.col("html"))), "|")).alias("headings"))


_CLUTTER = [
    ('<table class="infobox vcard">a<tr>b</tr></table>', " "), ('<div class="hatnote x">c</div>', " "), ('<p class="toc">d</p>', " "), ('<nav id="toc">e</nav>', " "), ('<div class="asterism">*</div>', " "),
    ('<div class="example-header"><span>js</span></div>', ""), ('<a href="p1.jpg"> <b>Original</b></a>', ""), ('<span class="dropcap">W</span>', "W"), ('<figure class="x"><audio src="s"></audio></figure>', " "),
]


@query("SELECT page_id, md5(t) AS digest, length(t) AS n FROM (SELECT page_id, " + "'" + "".join(b for _, b in _CLUTTER) + "' || html AS t FROM pages)")
def html_cleaned(spark, sf):
    """Pages behind one of each thing that isn't content."""
    from ..functions.html import strip_chrome

    t = strip_chrome(F.concat(F.lit("".join(a for a, _ in _CLUTTER)), "html"))
    return read(spark, sf, "pages").select("page_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


@query("""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Some & One' END AS byline, CAST(CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS images,
page_id % 7 IN (0, 1, 3) AS nav, md5(CASE WHEN page_id % 2 = 0 THEN 'By Some & One' || chr(10) || chr(10) || url ELSE url END) AS digest FROM pages""")
def html_byline(spark, sf):
    """Pages of which some name an author, hold images, and have titles of navigation."""
    from ..functions.html import byline, image_sources, is_nav, with_byline
    from .woven import in_turn

    h = F.when(F.col("page_id") % 2 == 0, framed(F.col("html"))).otherwise(F.col("html"))
    h = F.when(F.col("page_id") % 3 == 0, F.concat(h, F.lit('<img alt="" src="data:image/png;base64,AAAA"/><img src="file:///x.png"><img src="data:image/svg+xml,x"><img src="http://x/y.png">'))).otherwise(h)
    k = F.col("page_id") % 7
    title = in_turn(k, ["Project Gutenberg License", "[Pg 12]", "Contents", "IV.", "I. A Scandal", "XII"], F.lit("A Title"))
    level = F.when(k == 5, 1).otherwise(2)
    return read(spark, sf, "pages").select("page_id", byline(h).alias("byline"), F.size(image_sources(h)).alias("images"), is_nav(title, level).alias("nav"), F.md5(with_byline(F.col("url"), h)).alias("digest"))


@query()
def html_offsets(spark, sf):
    """Headings of each page looked for in its text."""
    from ..functions.html import heading_levels, resolve_offsets
    from ..functions.segments import each_part
    from ..sources.markup import html_blocks

    def places(page: str) -> list[tuple[str, int, int]]:
        import json

        source, told = page.split("\0")
        return resolve_offsets("\n\n".join(t for _, _, t in html_blocks(source)), [(x["level"], x["text"]) for x in json.loads(told)])

    h = framed(F.col("html"))
    both = F.concat(h, F.lit("\0"), F.to_json(heading_levels(h)))
    return each_part(read(spark, sf, "pages").select("page_id", both.alias("both")), places, "title string, level int, offset long", "page_id", "both")


@query("SELECT page_id, 3 AS n, true AS found FROM pages")
def html_restored(spark, sf):
    """Sections of which an extract lost the headings and the lede, put back."""
    from ..functions.html import restore_headings, restore_lede, sections
    from ..functions.segments import each_part

    prose = "This is a sentence of the page number %s and it goes on for a while. It ends here."
    page = F.concat(*[x for n, head in enumerate(["<h1>T</h1>", "<h2>One <b>Head</b></h2>", "<h2>See also</h2>", "<h3>Two</h3>", "<h2>Three</h2>"]) for x in (F.lit(f"{head}<p>"), F.format_string(prose, F.concat(F.lit(f"{n}-"), F.col("page_id").cast("string"))), F.lit("</p>"))])

    def restored(source: str) -> list[tuple[int, int]]:
        import re

        bare = re.findall("<p>(.*?)</p>", source)
        text, kept = restore_headings("\n\n".join([bare[1], bare[2], bare[3], "Three", bare[4]]), sections(source)[1:])
        text = restore_lede(text, source)
        want = "\n\n".join([bare[0], "One Head", bare[1], bare[2], "Two", bare[3], "Three", bare[4]])
        return [(len(kept), int(text == want))]

    out = each_part(read(spark, sf, "pages").select("page_id", page.alias("page")), restored, "kept int, same int", "page_id", "page")
    return out.select("page_id", F.col("kept").alias("n"), (F.col("same") == 1).alias("found"))
