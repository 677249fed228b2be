"""Scans, sets, keyed writes and counts over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyed
from .registry import query, read


@query("SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents")
def doc_list_latest(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return keyed.numbered(d, "source", [F.col("n_chars").desc(), "doc_id"])


@query("SELECT source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source")
def doc_count_by_source(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def doc_sha256(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("""
WITH h AS (SELECT doc_id, source, sha256(text) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY source, h) AS existing_id, count(*) OVER (PARTITION BY source, h) AS n_same FROM h""")
def dup_documents(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = d.groupBy("source", "h").agg(F.min("doc_id").alias("existing_id"), F.count("*").alias("n_same"))
    return d.join(first, ["source", "h"]).select("doc_id", "existing_id", "n_same")


@query("""
WITH d AS (SELECT doc_id, source, length(text) AS n, text FROM documents)
SELECT a.doc_id, min(b.doc_id) AS existing_id FROM d a JOIN d b ON a.source = b.source AND a.n = b.n AND a.text = b.text GROUP BY a.doc_id""")
def dup_documents_by_text(spark, sf):
    """Without a stored hash: by length and a fresh digest; only rows that share both are compared as texts."""
    d = read(spark, sf, "documents").select("doc_id", "source", F.length("text").alias("n"), F.sha2("text", 256).alias("h"))
    return keyed.same_as(d, read(spark, sf, "documents").select("doc_id", "text"), ["source", "n", "h"])


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'purchase')")
def membership_scan(spark, sf):
    return keyed.with_status(read(spark, sf, "events"), "event_type", ["error", "purchase"]).select("event_id", "user_id", "event_type")


@query("SELECT conv_id, turn, text FROM conversations WHERE turn BETWEEN greatest(0, 1) AND 3")
def chunk_range_scan(spark, sf):
    return read(spark, sf, "conversations").where(F.col("turn").between(1, 3)).select("conv_id", "turn", "text")


@query("SELECT d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS place FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def null_fill_queue(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left").where("quality is null")
    return keyed.numbered(d.select("doc_id", "source"), "source", ["doc_id"]).select("doc_id", "place")


@query("SELECT DISTINCT d.source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def sources_needing_fill(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left").where("quality is null").select("source").distinct()


@query("SELECT vec_id, label FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 200")
def sample_scan(spark, sf):
    """A sample of 200 by a hash, so that it is the same each time."""
    return read(spark, sf, "embeddings").select("vec_id", "label").orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(200)


@query("""
WITH r AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS n, count(*) OVER () AS total FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 4))), 3) AS rounded_sum FROM r WHERE n % greatest(1, total // 100) = 0""")
def embedding_export(spark, sf):
    v = keyed.stride_sample(read(spark, sf, "embeddings"), "vec_id", 100)
    return v.select("vec_id", F.round(F.aggregate(F.transform("embedding", lambda x: F.round(x.cast("double"), 4)), F.lit(0.0), lambda a, x: a + x), 3).alias("rounded_sum"))


@query("""
SELECT user_id, arg_max(CAST(round(value) AS BIGINT), (ts, event_id)) AS latest, max(CAST(round(value) AS BIGINT)) AS furthest FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def reading_position(spark, sf):
    e = read(spark, sf, "events").where("value is not null").withColumn("at", F.round("value").cast("long"))
    return keyed.positions(e, "user_id", "at", F.struct("ts", "event_id"))


@query("SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE greatest(CAST(round(value) AS BIGINT), 50) END AS furthest FROM events")
def furthest_offset(spark, sf):
    """The larger of two, null if either is."""
    return read(spark, sf, "events").select("event_id", keyed.strict_greatest(F.round("value").cast("long"), F.lit(50).cast("long")).alias("furthest"))


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1""")
def toc_dedup(spark, sf):
    """The first row of each key, by order: as contents entries are deduplicated."""
    return keyed.first_of(read(spark, sf, "orders"), ["o_custkey", "o_orderdate"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""
SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 10 = 1""")
def keyed_upsert(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    fresh = c.where("c_custkey % 10 = 1").withColumn("c_custkey", F.col("c_custkey") + 1000000)
    return keyed.upsert(c, changed.unionByName(fresh), ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT -c_custkey, 'new ' || c_name FROM customer WHERE c_custkey % 5 = 0")
def insert_if_absent(spark, sf):
    """New rows come in only under keys that aren't there: old ones keep their names."""
    c = read(spark, sf, "customer").select("c_custkey", "c_name")
    new = c.withColumn("c_name", F.concat(F.lit("new "), "c_name"))
    new = new.unionByName(new.where("c_custkey % 5 = 0").withColumn("c_custkey", -F.col("c_custkey")))
    return keyed.insert_absent(c.where("c_custkey % 3 <> 0"), new, ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0)")
def cascade_delete(spark, sf):
    gone = read(spark, sf, "orders").where("o_custkey % 7 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return keyed.delete(read(spark, sf, "lineitem"), gone, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("""
SELECT doc_id, source FROM documents WHERE source <> 'src1' AND NOT (source = 'src2' AND doc_id % 2 = 0)
UNION ALL SELECT doc_id, source FROM documents WHERE source = 'src1' AND doc_id % 2 = 1
UNION ALL SELECT doc_id, source FROM documents WHERE source = 'src2' AND doc_id % 2 = 0""")
def replace_all(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source")
    return keyed.replace_groups(d, d.where("source = 'src1' and doc_id % 2 = 1 or source = 'src2'"), "source", d.where("source in ('src1', 'src2')").select("source").distinct())


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def dangling_references(spark, sf):
    """Documents whose label isn't there."""
    return keyed.dangling(read(spark, sf, "documents"), read(spark, sf, "labels"), "doc_id", "doc_id").select("doc_id")


@query("SELECT source, count(*) AS n, count(l.quality) AS n_quality, count(l.toxic) AS n_toxic, count(*) - count(l.quality) AS missing, count(*) = count(l.quality) AS complete FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def fill_coverage(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("n_quality"), F.count("toxic").alias("n_toxic"), F.count_if(F.col("quality").isNull()).alias("missing"), (F.count("*") == F.count("quality")).alias("complete"))


@query("""
SELECT 'quality' AS backend, count(quality) AS filled, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'toxic', count(toxic), count(*) FROM documents LEFT JOIN labels USING (doc_id)""")
def coverage_by_backend(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    one = d.agg(F.count("quality").alias("q"), F.count("toxic").alias("t"), F.count("*").alias("total"))
    return one.select(F.expr("stack(2, 'quality', q, 'toxic', t) as (backend, filled)"), "total")


@query("SELECT l_returnflag, median(l_quantity) AS mid FROM lineitem GROUP BY l_returnflag")
def median_averaged(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.median("l_quantity").alias("mid"))


@query("""
WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1 AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)
SELECT o_custkey, o_totalprice AS mid FROM r WHERE n = c // 2""")
def median_upper(spark, sf):
    """The element at half the count: the upper one of two."""
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_totalprice")).alias("a"))
    return o.select("o_custkey", F.get("a", F.floor(F.size("a") / 2).cast("int")).alias("mid"))


@query("SELECT event_id, props, json_extract_string(props, '$.k') AS k FROM events")
def metadata_read(spark, sf):
    return read(spark, sf, "events").select("event_id", "props", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT user_id, event_type AS kind, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id) AS share FROM events GROUP BY user_id, event_type")
def kind_histogram(spark, sf):
    return keyed.histogram(read(spark, sf, "events").withColumnRenamed("event_type", "kind"), ["user_id"], "kind")
