"""Shared pieces: checkpoints in the shared folder, crc32 folds, table reader."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_FILE_ROWS = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one only where executors are threads of the driver."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not told and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    told = told or tempfile.mkdtemp(prefix="lectern-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(told)
    return told


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def in_files(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than about so many rows need, or the cores if they are more, whatever the session deals its shuffles to; none is added."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // _FILE_ROWS)))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Reliable checkpoint: lineage ends in files that outlive any executor, as many as ``rows`` need where that is told."""
    shared_dir(df.sparkSession)
    return (df if rows is None else in_files(df, rows)).checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold_of(doc_id: Column, k: int) -> Column:
    """crc32 of the id's text, modulo k; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(k))


def decoded(column: pa.Array) -> Iterator[str]:
    """Texts one by one: a null is empty, bytes that aren't UTF-8 are U+FFFD."""
    return ((t.as_py() or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()))


def fresh_name(name: str, taken: list[str]) -> str:
    """The name, with signs added while a column has it (names are compared without case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
