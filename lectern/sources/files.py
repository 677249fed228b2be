"""Folders of files as units: one scan of binary files, one parse per file, errors as rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.units import STEP
from .markup import PARSERS, epub_contents, html_blocks, markdown_blocks, sniff

UNITS = "path string, format string, content_hash string, sequence long, kind string, level int, text string, error string"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Units of every file under the path; a file that can't be read is one row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (files.option("pathGlobFilter", glob) if glob else files).load(path)

    def run(batches):
        for b in batches:
            for p, h, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                body, fmt = data.as_py(), "unknown"
                try:
                    fmt = sniff(body, p)
                    if fmt not in PARSERS:
                        raise ValueError(f"no reader for {fmt}")
                    rows = [(p, fmt, h, (n + 1) * STEP, k, lv, t, None) for n, (k, lv, t) in enumerate(PARSERS[fmt](body))]
                except Exception as e:  # noqa: BLE001  whatever a broken file does, the others go on
                    rows = [(p, fmt, h, None, None, None, None, f"{type(e).__name__}: {e}")]
                names = [c.split()[0] for c in UNITS.split(", ")]
                types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
                cols = zip(*rows) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)

    return files.select("path", F.sha2("content", 256).alias("content_hash"), "content").mapInArrow(run, UNITS)


def parse_column(df: DataFrame, key: str, column: str, markup: str = "html") -> DataFrame:
    """(key, sequence, kind, level, text) of texts that already are a column."""
    parse = {"html": html_blocks, "md": markdown_blocks}[markup]

    def run(batches):
        for b in batches:
            rows = [(k, (n + 1) * STEP, kind, lv, t) for k, v in zip(b.column(0).to_pylist(), b.column(1)) for n, (kind, lv, t) in enumerate(parse(v.as_py() or ""))]
            cols = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (b.schema.field(0).type, pa.int64(), pa.string(), pa.int32(), pa.string()))], [key, "sequence", "kind", "level", "text"])

    return df.select(key, column).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, sequence long, kind string, level int, text string")


CONTENTS = "path string, play_order long, title string, level int, offset long, error string"


def read_contents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Contents entries of every EPUB file under the path; a file that can't be read is one row with its error, other formats have none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (files.option("pathGlobFilter", glob) if glob else files).load(path)

    def run(batches):
        names = [c.split()[0] for c in CONTENTS.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()]
        for b in batches:
            rows = []
            for p, data in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    body = data.as_py()
                    if sniff(body, p) == "epub":
                        rows += [(p, n, title, level, at, None) for title, at, level, n in epub_contents(body)]
                except Exception as e:  # noqa: BLE001  whatever a broken file does, the others go on
                    rows.append((p, None, None, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)

    return files.select("path", "content").mapInArrow(run, CONTENTS)
