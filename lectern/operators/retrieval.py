"""Lexical and vector retrieval and their fusion, over all documents at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranking constants and the words a query leaves out.
K_SEMANTIC, K_LEXICAL, K_DISTINCTIVE = 60.0, 60.0, 10.0
SPREAD, DISTINCTIVE, GATE_TOP, GATE_RANK = 0.15, 1.5, 5, 5
WEAK, TOP = 0.020, 50
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "of", "to", "in", "for", "on", "with", "as",
    "at", "by", "from", "this", "that", "these", "those", "it",
    "its", "i", "you", "he", "she", "we", "they", "them", "us",
    "his", "her", "their", "what", "which", "who", "whom", "where",
    "when", "why", "how",
]


def tokens(t: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def query_terms(q: Column) -> Column:
    """Distinct tokens of two characters or more that aren't stop words, in order."""
    return F.array_distinct(F.filter(tokens(q), lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS)))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, dl): an inverted index. Counts are combined before the shuffle."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(text_col, F.lit(""))).alias("w"))
    each = words.select("id", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term"))
    return each.groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def statistics(docs: DataFrame, index: DataFrame) -> tuple[int, float]:
    """(n, avgdl) of the whole index: its documents, and their tokens as the postings count them."""
    n = docs.count()
    tokens = index.agg(F.sum("tf")).first()[0] or 0
    return n, tokens / n if n else 0.0


def bm25(index: DataFrame, stats: tuple[int, float], queries: DataFrame, every_term: bool = False) -> DataFrame:
    """(query_id, id, score): Okapi scores, larger is better; ``queries``: (query_id, term), distinct.

    Only postings of the queries' terms leave the scan: the terms meet the index by a join whose small side
    Spark may broadcast after looking at its size. The index is best a table written once, as it is read twice.
    """
    n, avgdl = stats
    terms = queries.select("term").distinct()
    hit = index.join(terms, "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    scored = hit.join(df, "term").select("id", "term", (idf * weight).alias("s"))
    per = queries.join(scored, "term").groupBy("query_id", "id").agg(F.sum("s").alias("score"), F.count("*").alias("matched"))
    if every_term:
        need = queries.groupBy("query_id").agg(F.count("*").alias("need"))
        per = per.join(need, "query_id").where("matched = need")
    return per.select("query_id", "id", "score")


def ranked(scores: DataFrame, most: int = TOP) -> DataFrame:
    """``rank`` from 1 by score, then id; only the first ``most``."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths, empty or zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def _meet(most: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        tables = [(t.column(i), t.column(v), pc.list_value_length(t.column(v))) for t, i, v in ((rows, "id", "vec"), (asked, "query_id", "q_vec"))]
        for width in {int(w) for w in pc.unique(tables[1][2]).to_pylist() if w}:
            sides = []
            for ids, vec, size in tables:
                mask = pc.equal(size, width)
                m = vec.filter(mask).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                norm = np.sqrt((m * m).sum(1))
                keep = norm > 0
                sides.append((ids.filter(mask).to_numpy()[keep], m[keep], norm[keep]))
            (c_ids, c, c_norm), (q_ids, q, q_norm) = sides
            for at in range(0, len(q_ids), 256):
                score = q[at : at + 256] @ c.T / np.outer(q_norm[at : at + 256], c_norm)
                told = np.round(score, 9)
                if len(c_ids) > most:
                    least = np.partition(told, -most, axis=1)[:, -most]
                    r, k = np.nonzero(told >= least[:, None])
                else:
                    r, k = (x.ravel() for x in np.indices(told.shape))
                order = np.lexsort((c_ids[k], -told[r, k], r))
                r, k = r[order], k[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) < most
                r, k = r[first], k[first]
                out.append((q_ids[at : at + 256][r], c_ids[k], score[r, k]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, most: int = TOP, block: int = 8192, part: int = 65536) -> DataFrame:
    """(query_id, id, score): at least the ``most`` best by cosine (to nine places, then id) of each query (query_id, q_vec).

    Queries and vectors (id, vec) meet in blocks of bounded size, each pair of blocks in a task, which passes on ``most`` rows
    a query. Vectors of another length than the query's, empty ones and zeros, whose cosine counts as 0, are left out.
    """
    many, n = queries.count(), vectors.count()
    blocks = max(1, -(-many // block))
    parts = max(1, -(-n // part), min(-(-n // 1024), vectors.sparkSession.sparkContext.defaultParallelism))
    left = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("id", "vec"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q_vec").cast("array<double>").alias("q_vec"), F.pmod(F.xxhash64("query_id", "q_vec"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_meet(most), "query_id long, id long, score double")


def semantic(vectors: DataFrame, queries: DataFrame, most: int = TOP) -> DataFrame:
    """(query_id, id, score > 0): cosines of each query's nearest vectors, ``most`` or more of them."""
    return nearest(vectors, queries, most).where("score > 0")


def gate(sem: DataFrame, lex: DataFrame) -> DataFrame:
    """(query_id, distinctive, excluded): whether the lexical list stands out, or is left out as noise."""
    head = sem.where("rank <= 10").groupBy("query_id").agg(F.avg("score").alias("mean"), F.max("score").alias("best"))
    top = lex.groupBy("query_id").agg(F.max("score").alias("top"))
    ranks = lex.where(F.col("rank") <= GATE_TOP).join(sem.select("query_id", "id", F.col("rank").alias("s_rank")), ["query_id", "id"], "left")
    met = ranks.groupBy("query_id").agg(F.array_sort(F.collect_list("s_rank")).alias("r"))
    upper = F.get(F.col("r"), (F.size("r") / 2).cast("int"))  # the upper median
    confident = (F.col("mean") > 0) & ((F.col("best") - F.col("mean")) / F.col("mean") >= SPREAD)
    distinctive = F.col("top") >= DISTINCTIVE
    apart = (F.size("r") == 0) | (upper > GATE_RANK)
    rows = top.join(head, "query_id", "left").join(met, "query_id", "left")
    return rows.select("query_id", distinctive.alias("distinctive"), F.coalesce(confident & ~distinctive & apart, F.lit(False)).alias("excluded"))


def fuse(sem: DataFrame, lex: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """(query_id, id, rrf, sem_score, sem_rank, lex_rank): reciprocal rank fusion of two ranked lists."""
    a = sem.select("query_id", "id", F.col("score").alias("sem_score"), F.col("rank").alias("sem_rank"))
    b = lex.select("query_id", "id", F.col("rank").alias("lex_rank"))
    k = F.lit(K_LEXICAL)
    if gates is not None:
        b = b.join(gates, "query_id", "left").where("not coalesce(excluded, false)")
        k = F.when(F.col("distinctive"), K_DISTINCTIVE).otherwise(K_LEXICAL)
    b = b.withColumn("lex_part", 1 / (k + F.col("lex_rank"))).select("query_id", "id", "lex_rank", "lex_part")
    both = a.join(b, ["query_id", "id"], "full_outer")
    rrf = F.coalesce(1 / (F.lit(K_SEMANTIC) + F.col("sem_rank")), F.lit(0.0)) + F.coalesce("lex_part", F.lit(0.0))
    return both.select("query_id", "id", rrf.alias("rrf"), "sem_score", "sem_rank", "lex_rank")


def expansion_reason(fused: DataFrame) -> DataFrame:
    """(query_id, reason): weak when the best is under the bound, uncorroborated when the first two are lexical only."""
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "id")
    r = fused.withColumn("rank", F.row_number().over(order))
    per = r.groupBy("query_id").agg(F.max("rrf").alias("top"), F.max(F.when(F.col("rank") <= 2, F.col("sem_rank").isNotNull())).alias("backed"))
    return per.select("query_id", F.when(F.col("top") < WEAK, "weak").when(~F.col("backed"), "uncorroborated").otherwise("none").alias("reason"))


def keep_better(base: DataFrame, expanded: DataFrame) -> DataFrame:
    """Rows of the expanded retrieval where its best is at least the base's; else the base's."""
    top = lambda d, n: d.groupBy("query_id").agg(F.max("rrf").alias(n))
    better = top(base, "b").join(top(expanded, "e"), "query_id", "left").select("query_id", F.coalesce(F.col("e") >= F.col("b"), F.lit(False)).alias("better"))
    return base.join(better.where("not better"), "query_id", "left_semi").unionByName(expanded.join(better.where("better"), "query_id", "left_semi"))


def expansion_terms(response: Column) -> Column:
    """At most ten clean terms from lines that may be bulleted or numbered."""
    clean = lambda s: F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.trim(s), r"^[\p{P}\p{N}•\s]+", "")), r"[^\p{L}\p{N} -]", ""))
    terms = F.transform(F.split(response, "\n"), clean)
    return F.slice(F.array_distinct(F.filter(terms, lambda s: (F.length(s) >= 2) & (F.length(s) <= 30) & ~F.contains(s, F.lit("  ")))), 1, 10)


def trace(fused: DataFrame, most: int = 25) -> DataFrame:
    """(query_id, id, rank, rrf, cosine, sem_rank, lex_rank, lexical_only) of each query's first rows: how a passage came to its place."""
    order = Window.partitionBy("query_id").orderBy(F.round("rrf", 9).desc(), "id")
    r = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return r.select("query_id", "id", "rank", "rrf", F.col("sem_score").alias("cosine"), "sem_rank", "lex_rank", F.col("sem_rank").isNull().alias("lexical_only"))


def evaluation(fused: DataFrame, texts: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, passages, best, total): each query's first passages put together, with their scores; texts: (id, text)."""
    r = trace(fused, most).join(texts, "id")
    per = r.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("p"), F.max("rrf").alias("best"), F.sum("rrf").alias("total"))
    return per.select("query_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("passages"), "best", "total")
