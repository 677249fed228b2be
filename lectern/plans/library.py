"""Notes, images, contents, corrections, structure and recall over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import library as L
from ..operators import retrieval as R
from ..operators import units as U
from . import woven as W
from .contents import _PAGED, paged
from .registry import cut, query, read
from .structures import _UNITS, units

_TOC = "t AS (SELECT o_custkey AS doc_id, o_orderkey AS play_order, o_orderpriority || ' page ' || (o_orderkey % 60) AS title, CAST(round(o_totalprice) AS BIGINT) AS off FROM orders)"


def toc(spark, sf):
    """Orders as contents entries of their customers."""
    title = F.concat_ws(" ", "o_orderpriority", F.lit("page"), (F.col("o_orderkey") % 60).cast("string"))
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("play_order"), title.alias("title"), F.round("o_totalprice").cast("long").alias("offset"))


@query(f"WITH {_TOC} SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY play_order) AS place FROM t")
def toc_scan(spark, sf):
    return L.contents_of(toc(spark, sf)).select("doc_id", "title", F.col("place").cast("long").alias("place"))


@query("SELECT l_orderkey AS doc_id, l_partkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem")
def image_scan(spark, sf):
    i = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("image_id"), F.col("l_linenumber").alias("ordinal"))
    return L.images_of(i).select("doc_id", "image_id", F.col("place").cast("long").alias("place"))


def notes(spark, sf):
    e = read(spark, sf, "events")
    return e.select(F.col("event_id").alias("note_id"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("kind"), F.col("props").alias("body"), F.col("ts").alias("created"), F.col("ts").alias("updated"))


@query("SELECT user_id AS doc_id, event_id AS note_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events")
def notes_scan(spark, sf):
    return L.notes_of(notes(spark, sf)).select("doc_id", "note_id", F.col("place").cast("long").alias("place"))


@query("""
SELECT event_id AS note_id, user_id AS doc_id, NULL AS anchor_text, NULL AS context_before, NULL AS context_after FROM events
UNION ALL SELECT -doc_id - 1, doc_id, substr(text, 21, least(60, length(text)) - 20), substr(text, 1, 20), substr(text, least(60, length(text)) + 1, 48) FROM documents WHERE length(text) >= 20
UNION ALL SELECT -doc_id - 1000000, -doc_id - 1, NULL, NULL, NULL FROM documents WHERE length(text) >= 20""")
def note_insert(spark, sf):
    """A note on each document's 21st to 60th character, and one on a document that isn't there."""
    d = read(spark, sf, "documents").where(F.length("text") >= 20)
    new = d.select((-F.col("doc_id") - 1).alias("note_id"), "doc_id", F.lit("note").alias("kind"), F.lit(20).alias("start"), F.lit(60).alias("end"))
    new = new.unionByName(d.select((-F.col("doc_id") - 1000000).alias("note_id"), (-F.col("doc_id") - 1).alias("doc_id"), F.lit("note").alias("kind"), F.lit(0).alias("start"), F.lit(9).alias("end")))
    return L.add_notes(notes(spark, sf), new, d.select("doc_id", F.col("text").alias("plain_text"))).select("note_id", "doc_id", "anchor_text", "context_before", "context_after")


@query("SELECT event_id AS note_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'new ' || props ELSE props END AS body FROM events")
def note_update(spark, sf):
    n = notes(spark, sf)
    changes = n.where("note_id % 3 < 2").select("note_id", F.when(F.col("note_id") % 3 == 1, F.concat(F.lit("new "), "body")).alias("body"), F.col("created").alias("updated"))
    return L.edit_notes(n, changes).select("note_id", "body")


@query("SELECT page_id AS image_id, CASE WHEN page_id % 2 = 0 THEN md5(url) ELSE md5(html) END AS digest FROM pages UNION ALL SELECT -page_id - 1, md5(url) FROM pages WHERE page_id % 4 = 0")
def image_put(spark, sf):
    """Pages' bytes as images: half get new bytes, some are new."""
    p = read(spark, sf, "pages")
    old = p.select(F.col("page_id").alias("image_id"), F.col("html").cast("binary").alias("data"))
    new = p.where("page_id % 2 = 0").select(F.col("page_id").alias("image_id"), F.col("url").cast("binary").alias("data"))
    new = new.unionByName(p.where("page_id % 4 = 0").select((-F.col("page_id") - 1).alias("image_id"), F.col("url").cast("binary").alias("data")))
    return L.put_images(old, new).select("image_id", F.md5("data").alias("digest"))


_T = "c AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations)"


@query(f"WITH {_T}, m AS (SELECT conv_id, max(turn) AS last FROM c GROUP BY conv_id) SELECT conv_id, turn, role, md5(text) AS digest FROM c UNION ALL SELECT conv_id, last + 1, 'user', md5('and then?') FROM m UNION ALL SELECT conv_id, last + 2, 'assistant', md5('nothing') FROM m")
def turn_append(spark, sf):
    t = read(spark, sf, "conversations").distinct()
    c = t.select("conv_id").distinct()
    new = c.select("conv_id", F.lit(1).alias("n"), F.lit("user").alias("role"), F.lit("and then?").alias("text")).unionByName(c.select("conv_id", F.lit(2).alias("n"), F.lit("assistant").alias("role"), F.lit("nothing").alias("text")))
    return L.add_turns(t, new).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query(f"WITH {_T} SELECT conv_id, count(*) AS removed FROM c WHERE conv_id % 4 = 1 GROUP BY conv_id UNION ALL SELECT -1, 0")
def conversation_clear(spark, sf):
    t = read(spark, sf, "conversations").distinct()
    gone = t.where("conv_id % 4 = 1").select("conv_id").unionByName(t.sparkSession.createDataFrame([(-1,)], "conv_id long"))
    return L.clear_turns(t, gone)[1]


_FIX = "f AS (SELECT p_size AS doc_id, p_name AS original, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE p_name END AS corrected FROM part)"


def corrections(spark, sf):
    new = F.when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).when(F.col("p_partkey") % 3 == 2, F.col("p_name"))
    return read(spark, sf, "part").select(F.col("p_size").alias("doc_id"), F.col("p_name").alias("original"), new.alias("corrected"))


@query(f"WITH {_FIX} SELECT doc_id, count(DISTINCT original) AS n, md5(string_agg(DISTINCT original, '|' ORDER BY original)) AS digest FROM f GROUP BY doc_id")
def corrections_tried(spark, sf):
    return L.tried_corrections(corrections(spark, sf)).select("doc_id", F.size("originals").cast("long").alias("n"), F.md5(F.array_join("originals", "|")).alias("digest"))


@query(f"WITH {_FIX} SELECT doc_id, original, min(corrected) AS corrected FROM f WHERE corrected <> original GROUP BY doc_id, original")
def corrections_list(spark, sf):
    return L.corrections_of(corrections(spark, sf))


def _structured(spark, sf):
    u = units(spark, sf).withColumns({"level": F.lit(0), "title_length": F.lit(None).cast("int"), "revision": F.lit(0), "source_tier": F.lit("import")})
    d = read(spark, sf, "documents").select("doc_id", F.lit(None).cast("long").alias("skip_seq"), F.lit(0).alias("skip_offset"), F.lit("none").alias("skip_source"))
    old = u.where("sequence in (10, 20)").select("doc_id", (F.col("sequence") / 10).cast("int").alias("play_order"), F.lit("old").alias("title"), F.lit(0).alias("offset"))
    odd = u.where("doc_id % 2 = 1 and sequence in (20, 40, 60)")
    new = odd.select("doc_id", F.col("sequence").cast("int").alias("play_order"), F.lit("new").alias("title"), F.when(F.col("sequence") < 60, 7).otherwise(9).alias("offset"))
    promotions = odd.select("doc_id", "sequence", F.lit(2).alias("level"), F.length("text").alias("title_length"))
    skips = d.where("doc_id % 2 = 1").select("doc_id", F.lit(20).cast("long").alias("skip_seq"), F.lit(5).alias("skip_offset"), F.lit("toc").alias("skip_source"))
    return L.apply_structure(old, u, d, new, promotions, skips)


@query(_UNITS + ", k AS (SELECT DISTINCT doc_id, CASE WHEN sequence < 60 THEN 7 ELSE 9 END AS off FROM units WHERE doc_id % 2 = 1 AND sequence IN (20, 40, 60)) SELECT doc_id, 'new' AS title, off AS \"offset\" FROM k UNION ALL SELECT doc_id, 'old', 0 FROM units WHERE doc_id % 2 = 0 AND sequence IN (10, 20)")
def structure_toc(spark, sf):
    return _structured(spark, sf)[0].select("doc_id", "title", "offset")


@query(_UNITS + "SELECT doc_id, sequence, doc_id % 2 = 1 AND sequence IN (20, 40, 60) AS promoted, CASE WHEN doc_id % 2 = 1 AND sequence IN (20, 40, 60) THEN length(text) END AS title_length FROM units")
def structure_units(spark, sf):
    u = _structured(spark, sf)[1]
    promoted = (F.col("kind") == "heading") & (F.col("revision") == 1) & (F.col("source_tier") == "redetect_structure") & (F.col("level") == 2)
    return u.select("doc_id", "sequence", promoted.alias("promoted"), "title_length")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 20 END AS skip_seq, CASE WHEN doc_id % 2 = 1 THEN 5 ELSE 0 END AS skip_offset, CASE WHEN doc_id % 2 = 1 THEN 'toc' ELSE 'none' END AS skip_source FROM documents")
def structure_skips(spark, sf):
    return _structured(spark, sf)[2]


@query(_PAGED + r""", n AS (SELECT doc_id, page, sequence AS b FROM u WHERE kind = 'page_break' AND page % 2 = 0)
SELECT doc_id, sequence, kind, md5(text) AS digest FROM u WHERE kind = 'page_break' OR page % 2 = 1 UNION ALL SELECT doc_id, b + 1, 'prose', md5('One, of page ' || page) FROM n UNION ALL SELECT doc_id, b + 2, 'prose', md5('two') FROM n""")
def page_replace(spark, sf):
    """Every second page takes two new paragraphs."""
    u = paged(spark, sf)
    new = u.where("kind = 'page_break' and page % 2 = 0").select("doc_id", "page", F.concat(F.lit("One, of page "), F.col("page").cast("string"), F.lit("\n\n \n\n two ")).alias("new_text"))
    return L.replace_pages(u, new).select("doc_id", "sequence", "kind", F.md5("text").alias("digest"))


@query(f"""
WITH {_TOC}, p AS (SELECT doc_id, play_order % 60 AS page, arg_min(off, play_order) AS start, count(*) AS n FROM t GROUP BY 1, 2),
o AS (SELECT *, coalesce(max(CASE WHEN n > 1 OR page < 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS odd FROM p),
e AS (SELECT doc_id, unnest(range(1, max(page) + 1)) AS page FROM p WHERE page >= 1 GROUP BY doc_id)
SELECT e.doc_id, e.page, CAST(coalesce(last_value(CASE WHEN odd = 0 THEN o.start END IGNORE NULLS) OVER (PARTITION BY e.doc_id ORDER BY e.page), 0) AS BIGINT) AS start FROM e LEFT JOIN o ON e.doc_id = o.doc_id AND e.page = o.page""")
def page_map_labels(spark, sf):
    return L.pages_from_labels(toc(spark, sf))


@query("SELECT doc_id, md5(CASE WHEN 13.0 / greatest(length(text), 1) > 0.3 THEN text ELSE substr(text, 6, 10) || substr(text, 24) END) AS digest FROM documents")
def strip_capped(spark, sf):
    """Two ranges of each text, given out of order, unless they are too much of it."""
    r = F.array(F.struct(F.lit(15).alias("lo"), F.lit(23).alias("hi")), F.struct(F.lit(0).alias("lo"), F.lit(5).alias("hi")))
    return read(spark, sf, "documents").select("doc_id", F.md5(L.strip_ranges(F.col("text"), r)).alias("digest"))


@query("""
WITH i AS (SELECT DISTINCT l_suppkey AS doc_id, l_orderkey % 40 AS page, l_partkey % 60 AS width, l_linenumber AS height FROM lineitem),
f AS (SELECT doc_id, width, height FROM i GROUP BY 1, 2, 3 HAVING count(DISTINCT page) >= 6)
SELECT i.* FROM i LEFT JOIN f USING (doc_id, width, height) WHERE f.doc_id IS NULL""")
def recurring_images(spark, sf):
    """Images of a size that six pages of a document have are furniture and go."""
    i = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") % 40).alias("page"), (F.col("l_partkey") % 60).alias("width"), F.col("l_linenumber").alias("height"))
    return L.figures(i.distinct())


_TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


@query(rf"""
WITH {_T}, s AS (SELECT * FROM c WHERE role IN ('user', 'assistant')), a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM s),
v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings WHERE vec_id < 100),
sim AS (SELECT a.conv_id, a.turn, row_number() OVER (PARTITION BY a.conv_id ORDER BY round(list_cosine_similarity(x.e, q.e), 9) DESC, a.turn) AS r FROM a JOIN v x ON x.vec_id = (a.conv_id * 7 + a.turn) % 100 JOIN v q ON q.vec_id = a.conv_id % 100 WHERE age > 2 AND a.turn % 5 > 0),
q AS (SELECT conv_id, list_distinct({_TOKENS.format('text')}[1:2]) AS terms FROM s WHERE turn = (SELECT min(turn) FROM s z WHERE z.conv_id = s.conv_id AND z.role = 'user')),
w AS (SELECT conv_id, turn, {_TOKENS.format('text')} AS w FROM s), n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w), p AS (SELECT conv_id, turn, len(w) AS dl, unnest(w) AS term FROM w), tf AS (SELECT conv_id, turn, dl, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT tf.conv_id, turn, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS met, any_value(len(terms)) AS need FROM tf JOIN df USING (term) JOIN q ON q.conv_id = tf.conv_id AND list_contains(q.terms, tf.term), n GROUP BY 1, 2),
l1 AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 9) DESC, turn) AS r FROM sc WHERE met = need), l2 AS (SELECT l1.conv_id, l1.turn, row_number() OVER (PARTITION BY l1.conv_id ORDER BY r) AS r FROM l1 JOIN a USING (conv_id, turn) WHERE l1.r <= 25 AND age > 2),
f AS (SELECT coalesce(x.conv_id, y.conv_id) AS conv_id, coalesce(x.turn, y.turn) AS turn, coalesce(1.0 / (60 + x.r), 0) + coalesce(1.0 / (60 + y.r), 0) AS rrf, x.r AS sem_rank, y.r AS lex_rank FROM sim x FULL JOIN l2 y ON x.conv_id = y.conv_id AND x.turn = y.turn),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(rrf, 12) DESC, turn) AS place FROM f)
SELECT conv_id, turn, round(rrf, 6) AS rrf, sem_rank, lex_rank FROM z WHERE place <= 4""")
def conversation_recall(spark, sf):
    """A conversation's first two words asked of its older turns, of which four fifths have a vector."""
    t = read(spark, sf, "conversations").distinct()
    s = t.where("role in ('user', 'assistant')")
    v = read(spark, sf, "embeddings").where("vec_id < 100").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    own = s.where("turn % 5 > 0").withColumns({"vec_id": (F.col("conv_id") * 7 + F.col("turn")) % 100, "q_id": F.col("conv_id") % 100})
    near = own.join(v, "vec_id").join(v.select(F.col("vec_id").alias("q_id"), F.col("e").alias("q")), "q_id")
    sim = near.select("conv_id", "turn", F.round(R.cosine(F.col("e"), F.col("q")), 9).alias("score"))
    first = s.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    terms = first.select(F.col("conv_id").alias("query_id"), F.explode(F.array_distinct(F.slice(R.tokens(F.col("text")), 1, 2))).alias("term"))
    docs = s.select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    index = cut(R.postings(docs))
    # a conversation's question is asked of its own turns, by the statistics of all
    lex = R.bm25(index, R.statistics(docs, index), terms, every_term=True).where("query_id = id.conv_id")
    lex = lex.select("id.conv_id", "id.turn", F.round("score", 9).alias("score"))
    return L.recall(sim, lex, t, recent=2).select("conv_id", "turn", F.round("rrf", 6).alias("rrf"), F.col("sem_rank").cast("long").alias("sem_rank"), F.col("lex_rank").cast("long").alias("lex_rank"))


@query("WITH x AS (SELECT label, unnest(embedding[1:8]) AS v, unnest(range(8)) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY label, i) SELECT label, CAST(i AS INTEGER) AS i, round(m, 6) AS mean FROM m")
def mean_pooling(spark, sf):
    """Vectors of a label as a text's tokens, in eight dimensions."""
    t = read(spark, sf, "embeddings").groupBy("label").agg(F.collect_list("embedding").alias("tokens"))
    return t.select("label", F.posexplode(L.mean_pooled(F.col("tokens"), 8)).alias("i", "mean")).select("label", "i", F.round("mean", 6).alias("mean"))


@query("SELECT vec_id AS id, 'new' AS backend, round(CASE WHEN vec_id % 3 = 0 THEN embedding[1] ELSE embedding[2] END, 6) AS v FROM embeddings")
def backend_swap(spark, sf):
    """A third of the vectors are the new backend's already; the others are taken over."""
    e = read(spark, sf, "embeddings")
    old = e.select(F.col("vec_id").alias("id"), F.array(F.get("embedding", 0)).alias("vec"), F.when(F.col("vec_id") % 3 == 0, "new").when(F.col("vec_id") % 3 == 1, "old").alias("backend"))
    told, _ = L.swap_backend(old, "new", e.select(F.col("vec_id").alias("id"), F.array(F.get("embedding", 1)).alias("vec")))
    return told.select("id", "backend", F.round(F.get("vec", 0), 6).alias("v"))


@query(_UNITS + ", n AS (SELECT doc_id, translate(substr(text, 3, 12), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS needle FROM units WHERE sequence = 20) SELECT u.doc_id, u.sequence AS idx, needle, false AS spans_units FROM units u JOIN n ON u.doc_id = n.doc_id AND contains(lower(u.text), lower(needle)) UNION ALL SELECT n.doc_id, -1, needle, true FROM n")
def chunk_find(spark, sf):
    """Twelve characters of each document's second unit looked for in its units and in a chunk of the whole."""
    u = units(spark, sf)
    needles = u.where("sequence = 20").select("doc_id", F.translate(F.substring("text", 3, 12), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("needle"))
    whole = U.plain_text(u).select("doc_id", F.lit(-1).cast("long").alias("idx"), F.col("plain_text").alias("text"), F.lit(10).alias("start_sequence"), F.lit(20).alias("end_sequence"))
    c = u.select("doc_id", F.col("sequence").alias("idx"), "text", F.col("sequence").cast("int").alias("start_sequence"), F.col("sequence").cast("int").alias("end_sequence")).unionByName(whole)
    return L.find_chunks(c, needles)


@query(_UNITS + r""",
t AS (SELECT DISTINCT doc_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS title, start + 5 AS "at", CASE WHEN sequence % 40 = 10 THEN 1 ELSE 2 END AS level FROM offs WHERE sequence % 20 = 10),
k AS (SELECT *, trim(regexp_replace(lower(title), '[\s:]+', ' ', 'g')) AS k FROM t), h AS (SELECT doc_id, sequence, start, trim(regexp_replace(lower(text), '[\s:]+', ' ', 'g')) AS hk FROM offs),
m AS (SELECT k.doc_id, title, "at", level, sequence, row_number() OVER (PARTITION BY k.doc_id, title, "at", level ORDER BY (hk = k) DESC, abs(start - "at"), sequence) AS r FROM k JOIN h ON k.doc_id = h.doc_id AND starts_with(hk, k)),
p AS (SELECT doc_id, sequence, min(level) AS level FROM m WHERE r = 1 GROUP BY 1, 2)
SELECT o.doc_id, o.sequence, coalesce(level, 0) AS level FROM offs o LEFT JOIN p USING (doc_id, sequence)""")
def heading_promotion(spark, sf):
    """The first words of every second unit as contents titles a little off their place."""
    u = U.with_offsets(units(spark, sf))
    marks = u.where("sequence % 20 = 10").select("doc_id", F.substring_index("text", " ", 3).alias("title"), (F.col("start") + 5).alias("at"), F.when(F.col("sequence") % 40 == 10, 1).otherwise(2).alias("level")).distinct()
    return L.promote(u, marks).select("doc_id", "sequence", "level")


_CAPTIONS = [("He said \"so it is.\" CHAPTER XIX.", "CHAPTER XIX."), ("Well! Chapter 4 The Sea", "Chapter 4 The Sea"), ("CHAPTER I.", "CHAPTER I."), ("A plain title", "A plain title"), (" No end chapter 5 ", "No end chapter 5"), ("Introduction", "Introduction")]
_MARKED = [("IV Chapter IV The Sea", "Chapter IV The Sea"), ("of what was said before 2.1 The Method", "2.1 The Method"), ("2.1 The Method", "2.1 The Method"), ("SHORT 3 Words", "SHORT 3 Words"), (" A title ", "A title"), ("ALL CAPITALS HERE 3 Words", "ALL CAPITALS HERE 3 Words")]


def _cases(pairs: list[tuple[str, str]], name: str) -> str:
    return "SELECT page_id, CASE page_id % 10 " + " ".join(f"WHEN {n} THEN {W.literal(b)}" for n, (_, b) in enumerate(pairs)) + f" ELSE trim(url) END AS {name} FROM pages"


@query(_cases(_CAPTIONS, "title"))
def caption_prefix(spark, sf):
    from ..functions.text import without_caption

    return read(spark, sf, "pages").select("page_id", without_caption(W.in_turn(F.col("page_id"), [a for a, _ in _CAPTIONS], F.col("url"))).alias("title"))


@query(_cases(_MARKED, "title"))
def toc_title_normalise(spark, sf):
    from ..functions.text import normal_toc_title

    return read(spark, sf, "pages").select("page_id", normal_toc_title(W.in_turn(F.col("page_id"), [a for a, _ in _MARKED], F.col("url"))).alias("title"))
