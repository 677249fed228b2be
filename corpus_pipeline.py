"""Documents to packed training sequences, a stage at a time.

Each stage takes all documents that the one before kept, as Parquet, and all but the last return
the columns of ``documents``; other columns are left out, whatever their names. Very long texts are read
whole by every stage, and an empty table gives an empty table. Null ids and repeated rows are rows like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontamination, packing, secrets, simhash, toxicity
from lectern.llm.common import fresh_path, table
from lectern.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.5 or more go.

    Nulls: a null text is scored as an empty one. Ties: a score of just 0.5 goes. Repeated rows go or stay together.
    Without labels of both classes all have one score, and so all stay or go by the share of toxic labels.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.score(docs.select(*COLUMNS), model, out_col="toxicity_score")
    return rows.where("toxicity_score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike by five-word shingles (similarity of 0.8 and more) the document with the smallest id stays.

    Nulls: texts that are null, empty or without words are one group; a null id comes after all others. Ties and
    repeated rows: of rows alike in id and text any one stays.
    """
    return simhash.keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Nulls: a null text holds none; an item without words has no window. Repeated rows go or stay together.
    Texts shorter than a window are held against items as short. There are no ties.
    """
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; ``n_chars`` follows the text where it changed.

    Nulls: a null text stays null, and a text without findings as it is, ``n_chars`` too. Ties: findings that overlap
    get one mark. Repeated rows are treated alike.
    """
    rows = secrets.redact(docs.select(*COLUMNS, F.col("text").alias("_was")))  # a name of its own: only COLUMNS come in
    return rows.withColumn("n_chars", F.when(F.col("text") != F.col("_was"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a sequence of 1024 tokens.

    Nulls: a null text is one piece, the end id. Very long texts are cut into pieces of 1024. Ties: equal pieces may change
    places. Repeated rows are packed each.
    """
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
