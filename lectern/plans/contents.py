"""Contents, headings, layout, segments and prompts over documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import segments as G
from ..operators import contents as C
from ..operators import keyed
from ..operators import prompts as P
from ..operators import structure as S
from ..operators import units as U
from ..operators import vectors as V
from .registry import query, read
from . import woven as W
from .structures import _BOOK, _BOOK_LINES, _UNITS, book_lines, book_units, units


def _pages(spark, sf):
    """Orders as pages of contents: a customer's orders are the entries of its page."""
    o = read(spark, sf, "orders")
    line = F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.lit("Title"), F.lit("....."), (F.col("o_orderkey") % 900 + 1).cast("string"))
    per = o.groupBy(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))).alias("a"))
    return per.select("doc_id", "page", F.concat(F.lit("Table of Contents\n"), F.array_join(F.transform("a", lambda x: x["l"]), "\n")).alias("text"))


@query("SELECT o_custkey AS doc_id, count(*) >= 5 AS contents FROM orders GROUP BY o_custkey")
def contents_pages(spark, sf):
    return _pages(spark, sf).select("doc_id", C.is_contents(F.col("text")).alias("contents"))


@query("SELECT o_custkey AS doc_id, CAST(1 AS INTEGER) AS first_page, CAST(1 AS INTEGER) AS last_page FROM orders GROUP BY o_custkey HAVING count(*) >= 5")
def contents_region(spark, sf):
    return C.contents_region(_pages(spark, sf)).select("doc_id", "first_page", "last_page")


@query("SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, CAST(o_orderkey AS VARCHAR) || ' Title' AS title, o_orderkey % 900 + 1 AS page FROM orders")
def contents_entries(spark, sf):
    return G.each_part(_pages(spark, sf), C.entries, "title string, page long")


@query()
def contents_placed(spark, sf):
    return G.each_part(_pages(spark, sf), lambda t: C.placed_entries(t, C.entries(t)), "title string, offset long")


@query(_BOOK_LINES + r""", p AS (SELECT doc_id, line FROM l WHERE line < 300 AND length(text) >= 60 AND (contains(text, '. ') OR contains(text, ', ') OR regexp_matches(text, '[.!?]$')) AND NOT (regexp_matches(text, '^[0-9IVXLCDMivxlcdm. \t]+$')
OR regexp_matches(text, '(?i)^(?:(?:\d{1,3}(?:\.\d{1,3}){0,3}\.?)|(chapter|part|section|appendix|article|book)\s+[ivxlcdm\d]{1,8}\.?)\s+\S') OR regexp_matches(text, '[.·•…]{3,}\s*\d{1,4}\s*$')
OR regexp_matches(text, '(?i)\b(PUBLISHER|PUBLISHERS|PRESS|PRINTED BY|& ?CO\.)\b|^(Copyright|©)|^List of Illustrations')))
SELECT doc_id, CAST(min(line) AS INTEGER) AS line FROM p GROUP BY doc_id""")
def listing_skip(spark, sf):
    return C.skip_listing(book_lines(spark, sf))


@query("SELECT doc_id, CASE WHEN position('the' IN text) > 0 AND position('the' IN substr(text, position('the' IN text) + 50)) > 0 THEN position('the' IN text) + 50 + position('the' IN substr(text, position('the' IN text) + 50)) - 2 END AS \"end\" FROM documents")
def listing_second_occurrence(spark, sf):
    return C.second_occurrence(read(spark, sf, "documents"), "the")


@query(f"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || repeat('x ', 4000) ELSE text END AS t FROM (SELECT doc_id, {W.book_sql('text')} AS text FROM documents)),
p AS (SELECT *, greatest(length(t) - 6000, 0) AS lo FROM t)
SELECT doc_id, CASE WHEN contains(substr(t, lo + 1), 'THE END') THEN lo + position('THE END' IN substr(t, lo + 1)) - 1 + 7 ELSE length(t) END AS fin FROM p""")
def catalog_end(spark, sf):
    """Books with THE END among the last 6000 characters, and for a third only further up."""
    t = W.book(F.col("text"))
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(t, F.repeat(F.lit("x "), F.lit(4000)))).otherwise(t)
    d = read(spark, sf, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", C.content_start(F.lit(0), C.catalog_end(F.col("t"))).cast("long").alias("fin"))


@query(_BOOK + r""", b AS (SELECT *, heading AND regexp_matches(text, '^(?:(?:CHAPTER|Chapter)\s+)?(?:\d{1,3}|[IVXLCDM]{1,7})\.?$') AS label FROM kinds),
j AS (SELECT *, coalesce(label AND lead(heading) OVER w AND NOT lead(label) OVER w, false) AS joins, lead(text) OVER w AS after FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY sequence)),
k AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc_id ORDER BY sequence), false) AS taken FROM j)
SELECT doc_id, sequence, md5(CASE WHEN joins THEN text || ' ' || after ELSE text END) AS digest FROM k WHERE NOT taken""")
def label_merge(spark, sf):
    """A book's Chapter 2 takes PROLOGUE, no heading, not; Chapter 3 takes the third part's title."""
    return C.merge_labels(book_units(spark, sf)).select("doc_id", "sequence", F.md5("text").alias("digest"))


@query()
def wrapped_entries(spark, sf):
    """All units as contents entries, of which a third are numbered and break off."""
    u = U.with_offsets(units(spark, sf))
    title = F.when(F.col("sequence") % 30 == 10, F.concat(F.col("sequence").cast("string"), F.lit(". Of the"))).otherwise(F.col("text"))
    toc = u.select("doc_id", (F.col("sequence") / 10).cast("long").alias("play_order"), title.alias("title"), F.col("start").alias("offset"), F.lit(1).alias("level"))
    return C.coalesce_wrapped(toc).select("doc_id", "play_order", F.md5("title").alias("digest"))


@query()
def heading_resolve(spark, sf):
    """The first words of every line of a document looked for among its lines, in order."""
    l = S.lines(read(spark, sf, "documents"))
    titles = l.where("length(text) > 0").select("doc_id", F.col("line").alias("n"), F.substring_index("text", " ", 4).alias("title"))
    return C.resolve_headings(titles, l)


def _fonts(spark, sf):
    l = read(spark, sf, "lineitem")
    return l.select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") % 50).alias("page"), F.col("l_linenumber").alias("line"), F.concat_ws(" ", F.initcap("l_shipmode") if "l_shipmode" in l.columns else F.lit("Line"), F.col("l_orderkey").cast("string")).alias("text"), F.round(F.col("l_quantity") / 5).alias("font_size"), (F.col("l_returnflag") == "R").alias("bold"), (F.col("l_linestatus") == "O").alias("all_caps"), F.col("l_discount").alias("gap_above"), F.col("l_tax").alias("indent"))


@query()
def heading_scores(spark, sf):
    """Lines scored by likeness to their document's bold ones, and how good the map of the best is."""
    l = _fonts(spark, sf)
    body = S.body_font(l)
    seeds = C.detect_headings(l, body).where("bold")
    scored = l.join(S.heading_profile(seeds), "doc_id").withColumn("score", S.resemblance())
    mapped = scored.where("score >= 0.45").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line", "text"))).withColumn("idx", F.col("page") * 10 + F.col("line"))
    q = S.map_quality(mapped)
    return q.select("doc_id", "placed", F.round("order_ratio", 6).alias("order_ratio"), F.round("quality", 6).alias("quality"))


_MAP = """{name} AS (SELECT doc_id, n, page * 10 + line AS idx, gap * 10 AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line, text) AS n FROM l WHERE {cut})),
{name}_h AS (SELECT *, max(idx) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM {name}),
{name}_q AS (SELECT doc_id, count(*) AS placed, avg(CASE WHEN high IS NULL OR idx > high THEN 1.0 ELSE 0.0 END) AS ord, count(*) * avg(CASE WHEN high IS NULL OR idx > high THEN 1.0 ELSE 0.0 END) * (0.5 + 0.5 * avg(score)) AS quality FROM {name}_h GROUP BY doc_id)"""
_FONT_LINES = "l AS (SELECT l_suppkey AS doc_id, l_orderkey % 50 AS page, l_linenumber AS line, 'Line ' || l_orderkey AS text, round(l_quantity / 5) AS font_size, l_returnflag = 'R' AS bold, l_linestatus = 'O' AS all_caps, l_discount AS gap, l_tax AS indent FROM lineitem)"


@query("WITH " + _FONT_LINES + ", " + _MAP.format(name="a", cut="bold") + ", " + _MAP.format(name="b", cut="all_caps") + """
SELECT coalesce(a_q.doc_id, b_q.doc_id) AS doc_id, CASE WHEN a_q.placed >= 4 AND a_q.ord >= 0.90 THEN 'built-in' WHEN coalesce(b_q.quality > 1.3 * coalesce(a_q.quality, 0) AND b_q.placed >= 3, false) THEN 'seedless' ELSE 'built-in' END AS choice FROM a_q FULL JOIN b_q ON a_q.doc_id = b_q.doc_id""")
def heading_choice(spark, sf):
    q = lambda cut: S.map_quality(_fonts(spark, sf).withColumns({"score": F.col("gap_above") * 10, "idx": F.col("page") * 10 + F.col("line")}).where(cut).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line", "text"))))
    return C.choose_map(q("bold"), q("all_caps"))


@query()
def ocr_reflow(spark, sf):
    l = _fonts(spark, sf)
    boxes = l.select("doc_id", "page", F.col("indent").alias("x"), (F.col("gap_above") * 10).alias("max_x"), (1 - F.col("line") / 10.0).alias("y"), "text")
    return C.visual_lines(boxes).select("doc_id", "page", F.md5("text").alias("digest"))


@query()
def line_paragraphs(spark, sf):
    l = S.lines(read(spark, sf, "documents")).select("doc_id", F.lit(1).alias("page"), "line", "text", (F.col("line") * 12.0).alias("y"))
    return C.paragraphs_from_lines(l).select("doc_id", "n", F.md5("text").alias("digest"))


@query()
def suspect_tokens(spark, sf):
    d = read(spark, sf, "documents")
    words = d.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("length(word) >= 2").distinct()
    joined = d.select("doc_id", F.concat_ws(" ", F.regexp_replace("text", r"(\p{L}{3,}) (\p{L})(\p{L}{3,})", "$1$2$3"), F.lit("ofTheKind")).alias("text"))
    return C.suspect_tokens(joined, words)


@query()
def spoken_segments(spark, sf):
    return G.each_part(read(spark, sf, "documents"), G.spoken, "start long, end long")


@query()
def balanced_chunks(spark, sf):
    s = G.each_part(read(spark, sf, "documents"), lambda t: [(p,) for p in G.balanced(t, 120)], "piece string")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("piece")).alias("longest"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), r AS (SELECT doc_id, t, 0 AS k, 'text' AS kind, t AS body FROM t WHERE t <> ''
UNION ALL SELECT doc_id, t, 1, 'visual', '3:' FROM t UNION ALL SELECT doc_id, t, 2, 'text', 'between' FROM t UNION ALL SELECT doc_id, t, 3, 'visual', doc_id || ':ab-' || doc_id FROM t UNION ALL SELECT doc_id, t, 4, 'text', t FROM t WHERE t <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n, kind, md5(body) AS digest FROM r""")
def placeholder_split(spark, sf):
    """Documents twice over with a page's marker and an image's between."""
    mark = F.concat(F.lit("\n[[POSITION:page=3]] between [[POSITION:page="), F.col("doc_id").cast("string"), F.lit(";image=ab-"), F.col("doc_id").cast("string"), F.lit("]]"))
    d = read(spark, sf, "documents").select("doc_id", F.concat("text", mark, "text").alias("text"))
    return G.each_part(d, G.placeholders, "kind string, body string").select("doc_id", "n", "kind", F.md5("body").alias("digest"))


@query("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(len(w))) AS n FROM w)
SELECT doc_id, n, 'h2:' || 'x' AS anchor, CAST(n + coalesce(list_sum(list_transform(w[1:n], lambda x: length(x))), 0) AS BIGINT) AS \"at\" FROM i""")
def anchor_sentinels(spark, sf):
    """A mark before every word."""
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("⟦h2:x⟧"), F.replace("text", F.lit(" "), F.lit(" ⟦h2:x⟧"))).alias("text"))
    return G.each_part(d, lambda t: G.anchors(t)[1], "anchor string, at long")


@query()
def surrounding_context(spark, sf):
    return G.each_part(read(spark, sf, "documents"), lambda t: [(G.strip_preamble(G.surrounding(t, len(t) // 2)),)], "context string").select("doc_id", F.md5("context").alias("digest"))


_PAGED = r"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), i AS (SELECT doc_id, unnest(p) AS t, unnest(range(1, len(p) + 1)) AS page FROM p),
r AS (SELECT doc_id, page, 0 AS k, 'page_break' AS kind, '' AS text FROM i UNION ALL SELECT doc_id, page, 1, 'prose', regexp_replace(t, '^\s+|\s+$', '', 'g') FROM i WHERE regexp_matches(t, '\S')),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, k) * 10 AS sequence FROM r)"""


def paged(spark, sf):
    """Documents whose lines are pages."""
    return U.page_units(read(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text")))


@query(_PAGED + " SELECT doc_id, sequence, kind, page, md5(text) AS digest FROM u")
def page_units(spark, sf):
    return paged(spark, sf).select("doc_id", "sequence", "kind", "page", F.md5("text").alias("digest"))


@query(_PAGED + """, o AS (SELECT *, coalesce(sum(CASE WHEN kind = 'prose' THEN length(text) + 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u),
s AS (SELECT doc_id, page, min(CASE WHEN kind = 'prose' THEN start END) AS own FROM o GROUP BY doc_id, page)
SELECT doc_id, page AS page_no, CAST(coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page), 0) AS BIGINT) AS start FROM s""")
def page_starts(spark, sf):
    return U.page_starts(paged(spark, sf).drop("page"))


@query(_PAGED + " SELECT doc_id, page AS page_no, count(*) AS n, count(*) FILTER (WHERE kind = 'prose') AS prose FROM u GROUP BY doc_id, page")
def units_of_page(spark, sf):
    """Units counted under the page that breaks so far tell."""
    return U.page_numbers(paged(spark, sf).drop("page")).groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "prose").alias("prose"))


@query(_UNITS + "SELECT doc_id, sequence, CAST(sequence % 70 AS BIGINT) AS intra, start + sequence % 70 AS \"at\" FROM offs UNION ALL SELECT doc_id, 5, 0, NULL FROM documents")
def chunk_locate(spark, sf):
    """Chunks that start at different places of their units, and one a document whose unit isn't there."""
    u = U.with_offsets(units(spark, sf))
    c = u.select("doc_id", F.col("sequence").alias("start_sequence"), (F.col("sequence") % 70).alias("start_intra"))
    c = c.unionByName(read(spark, sf, "documents").select("doc_id", F.lit(5).cast("long").alias("start_sequence"), F.lit(0).cast("long").alias("start_intra")))
    return P.located(c, u).select("doc_id", F.col("start_sequence").alias("sequence"), F.col("start_intra").alias("intra"), "at")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS sequence, max(l_quantity) AS score, min(l_partkey) AS ordinal FROM lineitem GROUP BY 1, 2")
def hit_sentences(spark, sf):
    l = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("sequence"), F.col("l_quantity").alias("score"), F.col("l_partkey").alias("ordinal"))
    return P.first_sentence_of_hits(l.select("doc_id", "sequence", "score"), l.select("doc_id", "sequence", "ordinal"))


@query("SELECT doc_id, CAST(round(100.0 * least(500, length(text)) / length(text)) AS INTEGER) AS percent, md5(substr(text, CAST(greatest(least(500, length(text)) - 320, 0) + 1 AS BIGINT), CAST(least(least(500, length(text)), 320) AS BIGINT))) AS tail FROM documents WHERE length(text) > 0")
def position_block(spark, sf):
    b = P.position_block(F.col("text"), F.lit(500))
    return read(spark, sf, "documents").where("length(text) > 0").select("doc_id", b["percent"].alias("percent"), F.md5(b["tail"]).alias("tail"))


@query()
def spoiler_flags(spark, sf):
    """Sentences of documents taken for answers, against hits at their own offsets and a furthest place of 500."""
    s = V.sentence_spans(read(spark, sf, "documents"))
    hits = s.select(F.col("doc_id").alias("answer_id"), F.col("idx").alias("n"), "doc_id", F.col("start").alias("at"))
    far = read(spark, sf, "documents").select("doc_id", F.lit(500).alias("furthest"))
    return P.spoilers(s.select(F.col("doc_id").alias("answer_id"), F.col("idx").alias("n"), "text"), hits, far)


@query("""
WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
i AS (SELECT conv_id AS prompt_id, CASE role WHEN 'system' THEN 'system' WHEN 'user' THEN 'question' ELSE 'history' END AS section, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(round(length(text) / 2.5) AS INTEGER)) END AS cost, turn FROM c),
n AS (SELECT *, CASE section WHEN 'history' THEN 400 ELSE 200 END AS budget, row_number() OVER (PARTITION BY prompt_id, section ORDER BY turn, cost) AS k, count(*) OVER (PARTITION BY prompt_id, section) AS items FROM i),
w AS (SELECT prompt_id, section, k, items, (cost <= budget)::INTEGER AS kept, CASE WHEN cost <= budget THEN cost ELSE 0 END AS tokens FROM n WHERE k = 1
UNION ALL SELECT n.prompt_id, n.section, n.k, n.items, w.kept + (w.tokens + n.cost <= n.budget)::INTEGER, w.tokens + CASE WHEN w.tokens + n.cost <= n.budget THEN n.cost ELSE 0 END FROM w JOIN n ON n.prompt_id = w.prompt_id AND n.section = w.section AND n.k = w.k + 1)
SELECT prompt_id, section, kept, CAST(items - kept AS INTEGER) AS dropped, tokens FROM w WHERE k = items""")
def prompt_assembly(spark, sf):
    t = read(spark, sf, "conversations").distinct()
    section = F.when(F.col("role") == "system", "system").when(F.col("role") == "user", "question").otherwise("history")
    return P.assemble(t.select(F.col("conv_id").alias("prompt_id"), section.alias("section"), F.col("turn").alias("n"), "text"))


@query("""
WITH j AS (SELECT user_id AS doc_id, CASE WHEN event_type IN ('click', 'view') THEN 'embed' ELSE 'tree' END AS lane, min(event_id) AS added FROM events GROUP BY 1, 2)
SELECT doc_id, lane, CASE WHEN lane = 'embed' THEN 0 ELSE 1 END AS lane_no, row_number() OVER (PARTITION BY lane ORDER BY added, doc_id) AS place FROM j""")
def work_order(spark, sf):
    j = read(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.when(F.col("event_type").isin("click", "view"), "embed").otherwise("tree").alias("lane"), F.col("event_id").alias("added"))
    return P.work_order(j).select("doc_id", "lane", "lane_no", F.col("place").cast("long").alias("place"))


@query("SELECT conv_id AS doc_id, n FROM (SELECT conv_id, turn AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn >= 1 AND regexp_matches(text, '[\\p{L}\\p{N}]'))) WHERE r <= 2")
def look_ahead(spark, sf):
    """The next two turns from the second on: a report of the first few is what is asked for."""
    t = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("n"), "text").distinct()
    return P.look_ahead(t, 1, 2).select("doc_id", "n")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 'X' || c_mktsegment ELSE c_mktsegment END AS c_mktsegment FROM customer")
def vector_update(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.where("c_custkey % 5 = 0").select("c_custkey", F.concat(F.lit("X"), "c_mktsegment").alias("c_mktsegment"))
    return keyed.update(c, new, ["c_custkey"], ["c_mktsegment"])


_TREE = "n AS (SELECT vec_id, vec_id % 50 AS doc_id, CASE WHEN vec_id % 4 = 0 THEN 'm' || label % 2 END AS model, embedding[1] AS v, label FROM embeddings)"


def _tree(spark, sf):
    """Vectors as nodes of fifty documents: a quarter are summaries of one of two models, the rest leaves (no model)."""
    e = read(spark, sf, "embeddings")
    model = F.when(F.col("vec_id") % 4 == 0, F.concat(F.lit("m"), (F.col("label") % 2).cast("string")))
    return e.select("vec_id", (F.col("vec_id") % 50).alias("doc_id"), model.alias("model"), F.get("embedding", 0).alias("v"), "label")


@query(f"WITH {_TREE} SELECT doc_id, model, max(vec_id) AS latest, arg_max(v, vec_id) AS v FROM n WHERE model IS NOT NULL GROUP BY doc_id, model")
def latest_summary(spark, sf):
    return V.latest_node(_tree(spark, sf), ["doc_id", "model"], "vec_id", "v").withColumnRenamed("vec_id", "latest")


@query(f"WITH {_TREE} SELECT vec_id, doc_id, model FROM n WHERE model IS NULL OR model = 'm1'")
def summary_scan(spark, sf):
    """Leaves, and summary nodes of one model."""
    return V.of_model(_tree(spark, sf), "m1").select("vec_id", "doc_id", "model")


@query(f"WITH {_TREE} SELECT doc_id, count(*) FILTER (WHERE model IS NULL) AS leaves, count(*) FILTER (WHERE model = 'm1') AS nodes, count(DISTINCT model) AS models FROM n GROUP BY doc_id")
def tree_counts(spark, sf):
    return V.tree_counts(_tree(spark, sf), "m1")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id < 400 OR label <> 3")
def summary_clear(spark, sf):
    """Summary nodes of one model removed; leaves stay."""
    e = read(spark, sf, "embeddings")
    return keyed.delete(e, e.where("vec_id >= 400 and label = 3"), ["vec_id"]).select("vec_id", "label")


@query(_UNITS + r""", h AS (SELECT doc_id, sequence / 10.0 AS n FROM units WHERE regexp_matches(text, '(?:^|[^\p{L}\p{N}_])(?:The|Die|Le|La|De|And)(?:$|[^\p{L}\p{N}_])')),
g AS (SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY doc_id ORDER BY n) <= 4 THEN 0 ELSE 1 END AS fresh FROM h), r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM g)
SELECT doc_id, CAST(min(n) AS DOUBLE) AS first, CAST(max(n) AS DOUBLE) AS last FROM r GROUP BY doc_id, run HAVING count(*) >= 2""")
def editorial_runs(spark, sf):
    u = units(spark, sf).withColumn("n", F.col("sequence") / 10)
    return S.editorial_runs(u, ["The", "Die", "Le", "La", "De", "And"], least_names=2, least_bios=0)


_CATALOG = "Listing\nThere are several editions of this ebook in the collection.\n\n12345\n(Plain text)\nThe preferred file is first\n"


@query(f"SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST({len(_CATALOG)} + CASE WHEN starts_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS fin FROM documents WHERE regexp_matches(text, '^[^(0-9 \\n][^\\n]{{10}}') AND NOT regexp_matches(lower(string_split(text, chr(10))[1]), 'ebook|filenumber|characteristics|preferred file')")
def catalog_region(spark, sf):
    """Documents behind a catalogue of editions."""
    first = F.lower(F.substring_index("text", "\n", 1))
    d = read(spark, sf, "documents").where(F.col("text").rlike(r"^[^(0-9 \n][^\n]{10}") & ~first.rlike("ebook|filenumber|characteristics|preferred file"))
    return G.each_part(d.select("doc_id", F.concat(F.lit(_CATALOG), "text").alias("text")), lambda t: [(C.catalog_region_end(t, 3),)], "fin long")


_WALK = "t AS (SELECT doc_id, repeat(CASE WHEN doc_id % 2 = 0 THEN 'SHORT LINE' ELSE 'short line.' END || chr(10), CASE WHEN doc_id % 3 = 0 THEN 100 ELSE 600 END) || 'It was a long line of prose that goes on for more than sixty characters, and ends.' || chr(10) AS text FROM documents)"


@query(f"""
WITH {_WALK}, b AS (SELECT doc_id, length(text) AS body, length(text) - 83 AS prose, doc_id % 5 = 0 AS walked, doc_id % 7 = 0 AS none FROM t)
SELECT doc_id, CASE WHEN none THEN NULL WHEN NOT walked AND body - 10 > 5000 THEN prose ELSE body END AS start, NOT none AND NOT walked AND body - 10 > 5000 AS by_prose FROM b""")
def walk_start(spark, sf):
    """Short lines and then prose before the body; some contents pass a colophon, some name no body."""
    k = F.col("doc_id")
    line = F.when(k % 2 == 0, "SHORT LINE\n").otherwise("short line.\n")
    times = F.when(k % 3 == 0, 100).otherwise(600)
    text = F.concat(F.repeat(line, times), F.lit("It was a long line of prose that goes on for more than sixty characters, and ends.\n"))
    d = read(spark, sf, "documents").select("doc_id", text.alias("text"), F.lit(10).alias("skip"))
    n = F.length("text")
    rows = F.array(*[F.struct(F.lit(o).alias("play_order"), t.alias("title"), at.alias("offset")) for o, t, at in [(1, F.lit("Chapter 0"), F.lit(4)), (2, F.when(k % 5 == 0, "Colophon").otherwise("THE BOOK"), F.lit(20)), (3, F.when(k % 7 == 0, "Some words").otherwise("Chapter I"), n), (4, F.lit("Imprint"), n + 5)]])
    toc = d.select("doc_id", F.explode(rows).alias("e")).select("doc_id", "e.*")
    return C.walk_start(toc, d)


@query("""
WITH p AS (SELECT doc_id, length(text) + 2 AS lead, text FROM documents WHERE NOT regexp_matches(lower(text), 'contents'))
SELECT doc_id, lead AS begin, lead + 130 AS "end", 5 AS n, 'Chapter I One' AS first, 25 AS last FROM p""")
def keyword_contents(spark, sf):
    """A contents page without dot leaders behind each document as the first page, and a page of prose behind that."""
    page = "Contents\n" + "\n".join(f"Chapter {r} {w} {5 * n}" for n, (r, w) in enumerate([("I", "One"), ("II", "Two"), ("III", "Three"), ("IV", "Four"), ("V", "Five")], 1))
    page = page + " " * (128 - len(page))
    d = read(spark, sf, "documents").where(~F.lower("text").rlike("contents"))
    pages = d.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("page"), F.col("text")), F.struct(F.lit(2).alias("page"), F.lit(page).alias("text")), F.struct(F.lit(3).alias("page"), F.lit("Prose. " * 40).alias("text")))).alias("p")).select("doc_id", "p.*")
    t = C.text_structure(pages)
    return t.select("doc_id", "begin", "end", F.size("entries").alias("n"), F.get("entries", 0)["title"].alias("first"), F.try_element_at("entries", F.lit(-1))["page"].cast("int").alias("last"))


@query("SELECT o_custkey AS doc_id, CAST(coalesce(max(CASE WHEN front THEN after END), 0) AS BIGINT) AS skip_until FROM (SELECT o_custkey, o_orderkey % 3 = 0 AS front, lead(o_orderkey * 10) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders) GROUP BY o_custkey")
def epub_front_matter(spark, sf):
    """Orders as a customer's spine, of which a third are front matter by one of its signs."""
    k = F.col("o_orderkey")
    html = F.when(k % 3 == 0, F.get(F.array(*[F.lit(f"<html>{x.upper()}</html>") for x in C.EPUB_FRONT]), (k % 5).cast("int"))).otherwise("<title>A chapter</title>")
    s = read(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("n"), html.alias("html"), (k * 10).alias("start"))
    return C.front_matter(s)
