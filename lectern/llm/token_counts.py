"""Token counts with a digest cache.

``token_counts`` joins the digest of each normalised text (null: empty; the library's
own normaliser does the rest) and of the tokenizer's version to a stored table of counts.
Only distinct texts that the table lacks are encoded, and their counts are appended. Digests are
joined before any text moves: texts whose digest is stored never leave their place, texts that occur once
are encoded where they lie, and only one copy a task of the others is shuffled.

Nulls: a null text counts as empty, a null id stays null. Bytes that aren't UTF-8 are read as U+FFFD. Empty
text: 0 tokens. Very long texts: encoded whole, in one task each. Repeated rows (ties): encoded once, returned
each. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, decoded, fresh_path
from .encoding import encoder


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def _pass(path: str):
    """(digest, n_tokens, body): texts that occur once are counted where they lie, of others a task passes on one copy."""

    def run(batches):
        enc, seen = encoder(path), set()
        for b in batches:
            digests, counts, bodies = [], [], []
            for d, n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if n == 1 or d not in seen:
                    alone = n == 1
                    if not alone:
                        seen.add(d)
                    digests.append(d)
                    counts.append(len(enc.ids((t.as_py() or b"").decode("utf-8", "replace"))) // 4 if alone else None)
                    bodies.append(None if alone else t.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(bodies, pa.binary())], ["content_digest", "n_tokens", "body"])

    return run


def _counter(path: str):
    def run(batches):
        enc, seen = encoder(path), set()
        for b in batches:
            digests, counts = [], []
            for d, t in zip(b.column(0).to_pylist(), decoded(b.column(1))):
                if d not in seen:
                    seen.add(d)
                    digests.append(d)
                    counts.append(len(enc.ids(t)) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], ["content_digest", "n_tokens"])

    return run


def misses(ids: DataFrame, known: DataFrame | None) -> DataFrame:
    """(content_digest, n): digests that the stored counts lack, with how many rows have them; no text takes part."""
    tally = ids.groupBy("content_digest").agg(F.count("*").alias("n"))
    return tally if known is None else tally.join(known, "content_digest", "left_anti")


def texts_of(texts: DataFrame, lacking: DataFrame, known_any: bool, most: int) -> DataFrame:
    """(content_digest, n, body) of the rows whose digest is lacking, ``n`` 1 for those that occur once.

    If the digests lacked are ``most`` at most, or else (where nothing is known) those that occur more than
    once, they are broadcast and texts stay where they are. Otherwise texts meet the digests in a shuffle.
    """
    if known_any:
        few = lacking.limit(most + 1).count() <= most
        return texts.join(F.broadcast(lacking) if few else lacking, "content_digest").select("content_digest", "n", "body")
    often = lacking.where("n > 1")
    few = often.limit(most + 1).count() <= most
    return texts.join(F.broadcast(often) if few else often, "content_digest", "left").select("content_digest", F.coalesce("n", F.lit(1)).alias("n"), "body")


def token_counts(docs: DataFrame, tokenizer: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = 1 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens) per row; ``cache_path``: Parquet table that grows with each call; ``most``: digests broadcast."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    body = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(body, 256)).alias("content_digest"), body.alias("body"))

    def stored() -> DataFrame | None:
        try:
            rows = spark.read.parquet(cache_path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None
        rows = rows.where(F.col("version") == version)
        return rows.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))  # a retried append may repeat rows

    ids = cut(keyed.select("id", "content_digest", F.octet_length("body").cast("long").alias("n_bytes")))
    known = stored()
    lacking = cut(misses(ids, known))
    path = fresh_path(spark, "token-texts")
    schema = "content_digest binary, n_tokens long, body binary"
    texts_of(keyed.select("content_digest", "body"), lacking, known is not None, most).select("content_digest", "n", "body").mapInArrow(_pass(tokenizer), schema).write.parquet(path)
    met = spark.read.schema(schema).parquet(path)
    copies = met.where("n_tokens is null").select("content_digest", "body").repartition("content_digest").mapInArrow(_counter(tokenizer), "content_digest binary, n_tokens long")
    new = met.where("n_tokens is not null").select("content_digest", "n_tokens").unionByName(copies)
    new.withColumn("version", F.lit(version)).write.mode("append").parquet(cache_path)
    known = stored()
    if known is None:  # an empty table leaves nothing to read
        known = new.limit(0)
    known = cut(known)  # a join of two plain shuffles, of which Spark can split a hot text's partition
    return ids.join(known, "content_digest", "left").select("id", "n_bytes", "n_tokens")
