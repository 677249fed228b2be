"""The operators with production parameters on their whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_model, licenses, packing, quality, secrets, simhash, token_counts, topk, toxicity
from .common import fold_of, fresh_path, table

VOCABULARY = "byte_bpe_50k.json"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _judged(rows: DataFrame, cut: float) -> DataFrame:
    return rows.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(toxicity.score_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.5)


def _of_kind(spans: str, rank: int) -> Column:
    """Number of spans of a kind. The rank is an argument here: a second one of the lambda would be the place in the array."""
    return F.size(F.filter(spans, lambda x: x["rank"] == rank)).cast("long")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_of_kind("base", rank).alias(f"n_{kind}") for rank, kind in enumerate(secrets.KINDS[:3])]
    return rows.select("doc_id", *counts, F.sha2(secrets.told(F.col("base")), 256).alias("base_sha256"), secrets.told(F.col("spans")).alias("spans"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language_model.scores(table(spark, sf_dir, "documents"))
    return rows.withColumnRenamed("id", "doc_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(quality.score_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.3)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty here, so every distinct text is encoded."""
    rows = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), fresh_path(spark, "token-counts"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_toxicity": op2_toxicity,
        "op3_secrets": op3_secrets,
        "op6_language_model": op6_language_model,
        "op7_decontamination": op7_decontamination,
        "op8_quality": op8_quality,
        "op9_licenses": op9_licenses,
        "op4_topk": op4_topk,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op10_token_counts": op10_token_counts,
    }


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array(" + _LOWER.format("coalesce(text, '')") + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP4_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, w[s:s + n - 1] AS win FROM i),
sizes AS (SELECT DISTINCT n FROM iw),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.s, p.n, iw.item_id FROM p JOIN iw ON iw.n = p.n AND iw.win = p.w[p.s:p.s + p.n - 1]),
hit_words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


def _op9_sql() -> str:
    rows = []
    for n, label, phrase, grams, k, at, tokens in licenses.template_rows():
        rows.append(f"({n}, '{label}', {phrase}, {grams}, {k}, {at}, [{', '.join(repr(x) for x in tokens)}])")
    return f"""
WITH t(template, label, phrase, grams, k, tpos, words) AS (VALUES {', '.join(rows)}),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS pos FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) >= k),
g AS (SELECT doc_id, template, label, phrase, grams, pos - tpos AS diagonal, list(DISTINCT tpos) AS places FROM p JOIN t ON t.k = p.k AND t.words = p.w[pos + 1:pos + p.k] GROUP BY ALL),
n AS (SELECT *, CASE WHEN phrase OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > 3, true) THEN 1 ELSE 0 END AS fresh FROM g),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM n),
s AS (SELECT doc_id, label, phrase, min(diagonal) AS start, len(list_distinct(flatten(list(places))))::DOUBLE / grams AS share FROM r GROUP BY doc_id, template, label, phrase, grams, run),
f AS (SELECT *, phrase AND share = 1 AS base, (phrase AND share = 1) OR (NOT phrase AND share >= 0.6) AS found FROM s)
SELECT d.doc_id, len(any_value(w)) AS n_words, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found), '') AS labels,
coalesce(max(share) FILTER (WHERE found), 0) AS score FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others use hashes, models, tokenizers or folds that SQL lacks; tests hold them against brute force."""
    return {"op4_topk": OP4_SQL, "op7_decontamination": OP7_SQL, "op9_licenses": _op9_sql()}
