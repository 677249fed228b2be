"""Words and rolling word k-grams as columns, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Everything that isn't an ASCII digit, a lower-case ASCII letter or beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of the words of the text, lower-cased in ASCII; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def gram(tokens: Column, pos: Column, k: int) -> Column:
    """Hash of the k tokens from ``pos`` (from 0); past the end, of fewer, which a later look at the tokens tells."""
    return F.xxhash64(F.lit(k), *[F.get(tokens, pos + i) for i in range(k)])


def rolling_grams(docs: DataFrame, sizes: list[int], tokens: str = "words") -> DataFrame:
    """A row per token and size with ``pos``, ``k`` and ``gram``; a row with null ``pos`` for no tokens.

    The tokens stay a column of each row, but as rows are only made past the join that follows
    in the same generated code, they are copied for its survivors alone.
    """
    at = docs.select("*", F.posexplode_outer(tokens).alias("pos", "_token")).drop("_token")
    if len(sizes) == 1:
        return at.withColumns({"k": F.lit(sizes[0]), "gram": gram(F.col(tokens), F.col("pos"), sizes[0])})
    keys = F.array(*[F.struct(F.lit(k).alias("k"), gram(F.col(tokens), F.col("pos"), k).alias("gram")) for k in sizes])
    return at.select("*", F.explode(keys).alias("_key")).select(*at.columns, "_key.k", "_key.gram")
