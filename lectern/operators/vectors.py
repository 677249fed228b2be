"""Vectors and chunks: health, clusters, sentence spans, overlapping chunks, a layer of summaries."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import dot

# Sizes of chunks and of the summary layer.
CHUNK, OVERLAP = 400, 50
LEAVES, MEMBERS, PACK_CHARS = 24, 3, 5000
ABBREVIATIONS = {"mr", "mrs", "ms", "dr", "prof", "st", "vs", "etc", "e.g", "i.e", "no", "vol", "fig", "jr", "sr"}
_END = re.compile(r"[.!?]+[\"'”’)\]]*(?=\s|$)|\n+")


def health(vectors: DataFrame, dimension: int) -> DataFrame:
    """One row of counts: sizes, finiteness, norms."""
    norm = F.sqrt(dot(F.col("vec"), F.col("vec")))
    v = vectors.select("vec", norm.alias("norm"))
    odd = F.exists("vec", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return v.agg(F.count("*").alias("n"), F.count_if(F.size("vec") != dimension).alias("wrong_size"), F.count_if(odd).alias("not_finite"), F.count_if(F.col("norm") < 1e-6).alias("zero"), F.min("norm").alias("least"), F.max("norm").alias("most"))


def of_model(nodes: DataFrame, model: str | None) -> DataFrame:
    """Leaves (no model), and the summary nodes of one model; of none, leaves alone."""
    return nodes.where(F.col("model").isNull() | F.coalesce(F.col("model") == F.lit(model), F.lit(False)))


def latest_node(nodes: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """(keys, at, value) of the last summary node of each key."""
    return nodes.where(F.col("model").isNotNull()).groupBy(*keys).agg(F.max(at).alias(at), F.max_by(value, at).alias(value))


def tree_counts(nodes: DataFrame, model: str) -> DataFrame:
    """(doc_id, leaves, nodes, models): a node with a vector is a summary of its model, never a leaf."""
    return nodes.groupBy("doc_id").agg(F.count_if(F.col("model").isNull()).alias("leaves"), F.count_if(F.col("model") == model).alias("nodes"), F.count_distinct("model").alias("models"))


def cluster_count(leaves: Column) -> Column:
    """A twentieth of the leaves, from 6 to 32."""
    return F.greatest(F.lit(6), F.least(F.lit(32), F.floor(leaves / 20))).cast("long")


def kmeans(vectors: DataFrame, k: int | None = None, seed: int = 42, rounds: int = 50) -> DataFrame:
    """(id, vec, cluster) by cosine k-means; zero vectors take no part."""
    v = vectors.where(dot(F.col("vec"), F.col("vec")) > 0).withColumn("features", array_to_vector("vec"))
    if k is None:
        k = max(6, min(32, v.count() // 20))
    if v.isEmpty():
        return vectors.withColumn("cluster", F.lit(0)).limit(0)
    model = KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="cosine", predictionCol="cluster").fit(v)
    return model.transform(v).drop("features")


def spans(text: str) -> list[tuple[int, int]]:
    """Sentence spans, trimmed: ends at closing marks or line feeds, but not after an abbreviation."""
    out, begin = [], 0
    for m in [*_END.finditer(text), None]:
        end = m.end() if m else len(text)
        word = text[begin : m.start()].rsplit(None, 1)[-1:] if m and m[0].startswith(".") else []
        if m and word and word[0].lower().lstrip("(\"'") in ABBREVIATIONS:
            continue
        body = text[begin:end]
        left = len(body) - len(body.lstrip())
        if body.strip():
            out.append((begin + left, begin + left + len(body.strip())))
        begin = end
    return out


def chunk_spans(sentences: list[tuple[int, int]], size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Runs of whole sentences up to ``size`` characters; the next run starts with what fits into ``overlap``, but always further on."""
    out, i, n = [], 0, len(sentences)
    while i < n:
        j = i + 1
        while j < n and sentences[j][1] - sentences[i][0] <= size:
            j += 1
        out.append((sentences[i][0], sentences[j - 1][1]))
        if j >= n:
            break
        k = j
        while k - 1 > i and sentences[j - 1][1] - sentences[k - 1][0] <= overlap:
            k -= 1
        i = k
    return out


def _spans(cut: Callable[[str], list[tuple[int, int]]], docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                for n, (s, e) in enumerate(cut(text)):
                    for col, v in zip(rows, (d, n, s, e, text[s:e])):
                        col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], ["doc_id", "idx", "start", "end", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, idx long, start long, end long, text string")


def sentence_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, start, end, text), half-open."""
    return _spans(spans, docs)


def chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, idx, start, end, text) of overlapping chunks."""
    return _spans(lambda t: chunk_spans(spans(t), size, overlap), docs)


def first_sentence(texts: list[str]) -> str:
    """Stands in for a summariser: the first sentence of each text."""
    return " ".join(t[s:e] for t in texts for s, e in spans(t)[:1])


def summary_layer(leaves: DataFrame, summarise: Callable[[list[str]], str] = first_sentence, least_leaves: int = LEAVES) -> DataFrame:
    """(cluster, members, summary): clusters of three leaves or more, largest first, each packed up to 5000 characters.

    All leaves take part; no tree is built if there are fewer than ``least_leaves``.
    """
    if leaves.count() < least_leaves:
        return leaves.sparkSession.createDataFrame([], "cluster int, members long, summary string")
    c = kmeans(leaves)
    order = Window.partitionBy("cluster").orderBy("id")
    spent = F.sum(F.length("text")).over(order)
    packed = c.withColumns({"spent": spent, "place": F.row_number().over(order), "members": F.count("*").over(Window.partitionBy("cluster"))})
    packed = packed.where((F.col("members") >= MEMBERS) & ((F.col("spent") <= PACK_CHARS) | (F.col("place") == 1)))
    texts = packed.groupBy("cluster", "members").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("a")).select("cluster", "members", F.transform("a", lambda x: x["text"]).alias("texts"))
    run = F.udf(lambda t: summarise(list(t)), "string")
    return texts.select("cluster", "members", run("texts").alias("summary"))
