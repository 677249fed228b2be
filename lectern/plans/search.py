"""Lexical, vector and fused retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import expand as X
from ..operators import grounding as G
from ..operators import retrieval as R
from ..operators import vectors as V
from .registry import cut, query, read

_STOP = "(" + ", ".join(f"'{w}'" for w in R.STOPWORDS) + ")"
_TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
#: The queries: every benchmark item's words, and every vector whose id is divisible by 100; in fusion, vector 100 k goes with item k.
_ASK = f"""
d AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
e AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM d),
p AS (SELECT id, term, dl, count(*) AS tf FROM e GROUP BY id, term, dl),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter({_TOKENS.format('text')}, lambda w: length(w) >= 2 AND w NOT IN {_STOP})) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT p.id, p.term, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM p JOIN df USING (term), stats WHERE term IN (SELECT term FROM q)),
lex_all AS (SELECT query_id, id, sum(s) AS score, count(*) AS matched FROM q JOIN s USING (term) GROUP BY query_id, id),
lex AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM lex_all) WHERE rank <= 50)"""
_SEM = """
v AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS vec FROM embeddings),
c AS (SELECT a.id AS query_id, b.id, list_cosine_similarity(a.vec, b.vec) AS score FROM v a, v b WHERE a.id % 100 = 0),
sem AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM c WHERE score > 0) WHERE rank <= 50)"""
_FUSED = """
hundred AS (SELECT query_id // 100 AS query_id, id, score, rank FROM sem),
g AS (SELECT t.query_id, t.top >= 1.5 AS distinctive, coalesce(h.mean > 0 AND (h.best - h.mean) / h.mean >= 0.15 AND NOT t.top >= 1.5 AND (m.r IS NULL OR m.r[len(m.r) // 2 + 1] > 5), false) AS excluded
  FROM (SELECT query_id, max(score) AS top FROM lex GROUP BY query_id) t
  LEFT JOIN (SELECT query_id, avg(score) AS mean, max(score) AS best FROM hundred WHERE rank <= 10 GROUP BY query_id) h USING (query_id)
  LEFT JOIN (SELECT l.query_id, list(s.rank ORDER BY s.rank) AS r FROM lex l JOIN hundred s ON l.query_id = s.query_id AND l.id = s.id WHERE l.rank <= 5 GROUP BY l.query_id) m USING (query_id)),
l2 AS (SELECT lex.query_id, id, rank, 1.0 / (CASE WHEN g.distinctive THEN 10 ELSE 60 END + rank) AS part FROM lex JOIN g USING (query_id) WHERE NOT excluded),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, coalesce(1.0 / (60 + a.rank), 0) + coalesce(b.part, 0) AS rrf, a.score AS sem_score, a.rank AS sem_rank, b.rank AS lex_rank FROM hundred a FULL JOIN l2 b ON a.query_id = b.query_id AND a.id = b.id)"""


def ask(spark, sf):
    """(query_id, term) of every benchmark item."""
    q = read(spark, sf, "benchmark")
    return q.select(F.col("item_id").alias("query_id"), F.explode(R.query_terms(F.col("text"))).alias("term")).distinct()


def lexical(spark, sf, every_term=False):
    d = read(spark, sf, "documents")
    index = cut(R.postings(d))  # read by statistics and scores
    return R.bm25(index, R.statistics(d, index), ask(spark, sf), every_term)


def vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def similar(spark, sf):
    """Every vector whose id is divisible by 100 against all."""
    v = vectors(spark, sf)
    return R.semantic(v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q_vec")))


def _ranked(scores):
    return R.ranked(scores.withColumn("score", F.round("score", 9)))


def lists(spark, sf):
    """The two ranked lists, each used by gate and fusion."""
    sem = cut(_ranked(similar(spark, sf)).withColumn("query_id", F.expr("query_id div 100")))
    return sem, cut(_ranked(lexical(spark, sf)))


def fused(spark, sf):
    sem, lex = lists(spark, sf)
    return R.fuse(sem, lex, R.gate(sem, lex))


@query(f"""
WITH t AS (SELECT conv_id, turn, list_filter({_TOKENS.format('text')}, lambda w: length(w) >= 2 AND w NOT IN {_STOP}) AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' OR ') AS match FROM t""")
def query_terms(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(R.query_terms(F.col("text")), " OR ").alias("match"))


@query(f"WITH {_ASK} SELECT query_id, id, round(score, 6) AS score, rank FROM lex")
def bm25_or(spark, sf):
    return _ranked(lexical(spark, sf)).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_ASK}, need AS (SELECT query_id, count(*) AS need FROM q GROUP BY query_id) SELECT query_id, id, round(score, 6) AS score FROM lex_all JOIN need USING (query_id) WHERE matched = need")
def bm25_and(spark, sf):
    return lexical(spark, sf, every_term=True).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"WITH {_ASK} SELECT id, term, dl, tf FROM p")
def postings(spark, sf):
    return R.postings(read(spark, sf, "documents")).select("id", "term", "dl", "tf")


@query(f"WITH {_SEM} SELECT query_id, id, round(score, 6) AS score, rank FROM sem")
def cosine_topk(spark, sf):
    return _ranked(similar(spark, sf)).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_ASK}, {_SEM}, {_FUSED} SELECT query_id, id, round(rrf, 6) AS rrf, round(sem_score, 6) AS sem_score, sem_rank, lex_rank FROM f")
def hybrid_rrf(spark, sf):
    f = fused(spark, sf)
    return f.select("query_id", "id", F.round("rrf", 6).alias("rrf"), F.round("sem_score", 6).alias("sem_score"), F.col("sem_rank").cast("long").alias("sem_rank"), F.col("lex_rank").cast("long").alias("lex_rank"))


@query(f"WITH {_ASK}, {_SEM}, {_FUSED} SELECT query_id, distinctive, excluded FROM g")
def rrf_gate(spark, sf):
    return R.gate(*lists(spark, sf))


@query(f"WITH {_ASK}, {_SEM}, {_FUSED} SELECT query_id, max(rrf) < 0.020 AS weak FROM f GROUP BY query_id")
def weak_retrieval(spark, sf):
    return fused(spark, sf).groupBy("query_id").agg((F.max("rrf") < R.WEAK).alias("weak"))


@query(f"WITH {_ASK}, {_SEM}, {_FUSED} SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, id) AS rank FROM f WHERE rrf >= 0.020) WHERE rank <= 3")
def top_sources(spark, sf):
    f = fused(spark, sf).where(F.col("rrf") >= R.WEAK).select("query_id", "id", F.round("rrf", 9).alias("score"))
    return R.ranked(f, 3).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {_ASK}, {_SEM}, {_FUSED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, id) AS place FROM f)
SELECT query_id, CASE WHEN max(rrf) < 0.020 THEN 'weak' WHEN NOT max(CASE WHEN place <= 2 THEN sem_rank IS NOT NULL END) THEN 'uncorroborated' ELSE 'none' END AS reason FROM r GROUP BY query_id""")
def expansion_reason(spark, sf):
    return R.expansion_reason(fused(spark, sf).withColumn("rrf", F.round("rrf", 9)))


@query(r"""
WITH l AS (SELECT conv_id, turn, list_transform(string_split('1. First   thing' || chr(10) || '- Second, thing!' || chr(10) || text, chr(10)), lambda s: trim(regexp_replace(lower(regexp_replace(trim(s), '^[\p{P}\p{N}•\s]+', '')), '[^\p{L}\p{N} -]', '', 'g'))) AS t FROM conversations),
k AS (SELECT conv_id, turn, list_filter(t, lambda x: length(x) >= 2 AND length(x) <= 30 AND NOT contains(x, '  ')) AS t FROM l)
SELECT conv_id, turn, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[1:10], '|') AS terms FROM k""")
def expansion_terms(spark, sf):
    """A numbered and a bulleted line before each turn's own."""
    t = F.concat(F.lit("1. First   thing\n- Second, thing!\n"), "text")
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(R.expansion_terms(t), "|").alias("terms"))


@query("""
WITH n AS (SELECT vec_id, embedding, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])) AS norm FROM embeddings)
SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_size, count(*) FILTER (WHERE len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite,
count(*) FILTER (WHERE norm < 1e-6) AS zero, round(min(norm), 6) AS least, round(max(norm), 6) AS most FROM n""")
def vector_health(spark, sf):
    h = V.health(vectors(spark, sf), 64)
    return h.withColumns({"least": F.round("least", 6), "most": F.round("most", 6)})


@query()
def kmeans_clusters(spark, sf):
    return V.kmeans(vectors(spark, sf)).groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("SELECT label, greatest(6, least(32, count(*) // 20)) AS k FROM embeddings GROUP BY label")
def cluster_count(spark, sf):
    return read(spark, sf, "embeddings").groupBy("label").agg(V.cluster_count(F.count("*")).alias("k"))


@query(f"WITH {_SEM.replace('a.id % 100 = 0', 'a.id % 100 = 0 AND b.id % 100 <> 0')} SELECT query_id AS id, round(max(score), 6) AS best, round(max(score), 9) >= 0.45 AS kept FROM c GROUP BY query_id")
def summary_verify(spark, sf):
    """Vectors whose id is divisible by 100, taken for a summary's sentences, against all others."""
    v = vectors(spark, sf)
    out = G.verify(v.where("id % 100 = 0"), v.where("id % 100 <> 0"))
    return out.select("id", F.round("best", 6).alias("best"), "kept")


@query("""
WITH h AS (SELECT l_orderkey AS doc_id, l_linenumber AS idx, l_quantity AS relevance FROM lineitem WHERE l_linenumber IN (1, 4, 7)),
w AS (SELECT *, greatest(idx - 1, 0) AS lo, idx + 1 AS hi FROM h),
n AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY doc_id ORDER BY lo, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM w),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY lo, idx) AS run FROM n)
SELECT doc_id, min(lo) AS lo, max(hi) AS hi, arg_max(idx, (relevance, -idx)) AS best, max(relevance) AS relevance FROM r GROUP BY doc_id, run""")
def neighbor_islands(spark, sf):
    h = read(spark, sf, "lineitem").where("l_linenumber in (1, 4, 7)").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx"), F.col("l_quantity").alias("relevance"))
    return X.islands(h, radius=1)


@query()
def neighbor_stitch(spark, sf):
    """Overlapping chunks of a document put together again."""
    c = V.chunks(read(spark, sf, "documents"))
    t = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("a"))
    return t.select("doc_id", F.length(X.stitch(F.transform("a", lambda x: x["text"]))).alias("n"))


@query()
def chunks_400_50(spark, sf):
    return V.chunks(read(spark, sf, "documents")).select("doc_id", "idx", "start", "end", F.md5("text").alias("digest"))


@query()
def sentence_index(spark, sf):
    return V.sentence_spans(read(spark, sf, "documents")).select("doc_id", "idx", "start", "end")


@query()
def entity_grounding(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Zyxwv Qwertz said so. "), "text")).otherwise(F.col("text")).alias("summary"))
    return d.select("doc_id", F.array_join(G.ungrounded_names(F.col("summary"), F.col("text")), "|").alias("ungrounded"))


@query()
def summary_layer(spark, sf):
    """One layer of cluster summaries, extractive: vectors pair with documents by id."""
    v = vectors(spark, sf).join(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return V.summary_layer(v, least_leaves=24).select("cluster", "members", F.md5("summary").alias("digest"))


@query(f"""
WITH {_ASK}, {_SEM}, {_FUSED}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, id) AS place FROM f WHERE round(rrf, 9) >= round(1.0 / 65, 9))
SELECT query_id, min(id) AS earliest FROM r WHERE place <= 5 GROUP BY query_id""")
def earliest_occurrence(spark, sf):
    """The first document that a query's five best come from."""
    f = fused(spark, sf).where(F.round("rrf", 9) >= round(1 / 65, 9)).select("query_id", "id", F.round("rrf", 9).alias("score"))
    return R.ranked(f, 5).groupBy("query_id").agg(F.min("id").alias("earliest"))


_TRACE = f"{_ASK}, {_SEM}, {_FUSED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, id) AS rank FROM f)"


@query(f"WITH {_TRACE} SELECT query_id, id, rank, round(rrf, 6) AS rrf, round(sem_score, 6) AS cosine, sem_rank, lex_rank, sem_rank IS NULL AS lexical_only FROM r WHERE rank <= 25")
def retrieval_trace(spark, sf):
    t = R.trace(fused(spark, sf))
    return t.withColumns({"rrf": F.round("rrf", 6), "cosine": F.round("cosine", 6), **{c: F.col(c).cast("long") for c in ("rank", "sem_rank", "lex_rank")}})


@query(f"WITH {_TRACE} SELECT query_id, md5(string_agg(d.text, chr(10) || chr(10) ORDER BY rank)) AS digest, round(max(rrf), 6) AS best, round(sum(rrf), 6) AS total FROM r JOIN documents d ON d.doc_id = r.id WHERE rank <= 5 GROUP BY query_id")
def retrieval_evaluation(spark, sf):
    """The five best documents of each query as its passages."""
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    e = R.evaluation(fused(spark, sf), texts)
    return e.select("query_id", F.md5("passages").alias("digest"), F.round("best", 6).alias("best"), F.round("total", 6).alias("total"))
