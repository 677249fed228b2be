"""Toxicity by a factorization machine over hashed terms.

Terms are the words of the lower-cased text and their prefixes of three to six characters,
hashed into a fixed number of buckets. Buckets that tell the classes apart best on a bounded
sample of labelled rows get a linear weight and a latent vector; the score is the logistic of
bias + weights + pairwise inner products of the terms present, so that a pair of terms (an insult
with a group's name) can count where neither does alone.

Nulls: a null text is empty; a null id or label never trains. Bytes that aren't UTF-8 are read as U+FFFD. Empty text:
scored by the bias. Very long texts: scored whole; a term counts once, however often it occurs. Ties: a score of just 0.5
is toxic; of buckets that tell the classes apart alike, the smaller are kept. Repeated rows: scored each, trained on once
(with the larger label). No labels, or one class: every score is the smoothed
base rate. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import decoded
from .labelled import sampled_features

BUCKETS = 1 << 20
_LETTERS = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 500_000


def terms_of(token: str) -> list[int]:
    """Buckets of a lower-cased, space-free token's words and their prefixes."""
    out = []
    for w in _LETTERS.findall(token):
        for t in {w, *(w[:k] + "*" for k in (3, 4, 5, 6) if len(w) >= k)}:
            out.append(zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS)
    return out


class _Terms(dict):
    def __init__(self, kept: dict[int, int] | None = None):
        super().__init__()
        self.kept = kept

    def __missing__(self, token: str) -> tuple[int, ...]:
        found = terms_of(token)
        found = tuple(found) if self.kept is None else tuple({self.kept[t] for t in found if t in self.kept})
        if len(token) <= 64:
            if len(self) > _CACHE_WORDS:
                self.clear()
            self[token] = found
        return found


def _present(text: str, terms: _Terms) -> set[int]:
    out: set[int] = set()
    for token in set(text.lower().split()):
        if found := terms[token]:
            out.update(found)
    return out


@dataclass
class FactorizationMachine:
    """``kept``: bucket of each feature. At most ``features`` x (1 + ``rank``) numbers, so it may be broadcast."""

    bias: float
    kept: np.ndarray
    weight: np.ndarray
    latent: np.ndarray

    def margin(self, active: list[int]) -> float:
        if not active:
            return self.bias
        v = self.latent[active]
        s = v.sum(axis=0)
        return self.bias + float(self.weight[active].sum() + 0.5 * (s @ s - (v * v).sum()))


def fit(label: np.ndarray, buckets: pa.ListArray, features: int = 512, rank: int = 4, epochs: int = 60, seed: int = 7) -> FactorizationMachine:
    y = (label > 0).astype(np.float64)
    empty = FactorizationMachine(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, rank)))
    if not 0 < y.sum() < len(y):
        return empty
    counts = np.diff(buckets.offsets.to_numpy())
    flat, row = buckets.flatten().to_numpy(), np.repeat(np.arange(len(y)), counts)
    n1, n0 = y.sum(), len(y) - y.sum()
    a, b = np.bincount(flat[y[row] > 0], minlength=BUCKETS), np.bincount(flat[y[row] == 0], minlength=BUCKETS)
    seen = np.flatnonzero(a + b >= 3)
    p1, p0 = (a[seen] + 0.5) / (n1 + 1), (b[seen] + 0.5) / (n0 + 1)
    p = (a[seen] + b[seen] + 1) / (n1 + n0 + 2)
    gain = n1 * (p1 * np.log(p1 / p) + (1 - p1) * np.log((1 - p1) / (1 - p))) + n0 * (p0 * np.log(p0 / p) + (1 - p0) * np.log((1 - p0) / (1 - p)))
    kept = np.sort(seen[np.argsort(-gain, kind="stable")[:features]])
    at = np.searchsorted(kept, flat)
    at[at == len(kept)] = 0
    ok = kept[at] == flat if len(kept) else np.zeros(len(flat), bool)
    col, row = at[ok], row[ok]
    starts = np.searchsorted(row, np.arange(len(y) + 1))
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), rank)), empty.bias
    gw, gv, gb = np.full(len(kept), 1e-6), np.full((len(kept), rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for rows in np.array_split(order, max(1, len(y) // 256)):
            n = starts[rows + 1] - starts[rows]
            idx = col[np.repeat(starts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            of = np.repeat(np.arange(len(rows)), n)
            vi = v[idx]
            s = np.zeros((len(rows), rank))
            np.add.at(s, of, vi)
            margin = bias + np.bincount(of, w[idx], len(rows)) + 0.5 * ((s * s).sum(1) - np.bincount(of, (vi * vi).sum(1), len(rows)))
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
            dw = np.bincount(idx, err[of], len(kept)) + 1e-5 * w
            dv = np.zeros_like(v)
            np.add.at(dv, idx, err[of][:, None] * (s[of] - vi))
            dv += 1e-5 * v
            gw += dw * dw
            gv += dv * dv
            gb += err.sum() ** 2
            w -= 0.2 * dw / np.sqrt(gw)
            v -= 0.02 * dv / np.sqrt(gv)
            bias -= 0.05 * err.sum() / np.sqrt(gb)
    return FactorizationMachine(float(bias), kept, w, v)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 8000) -> FactorizationMachine:
    """Fits on at most ``sample_rows`` labelled documents outside the held-out fold."""
    y, x = sampled_features(docs, labels, label, lambda t: sorted(_present(t, _Terms())), "int", sample_rows)
    return fit(y, x)


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1, in place of one of that name."""
    docs = docs.drop(out_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        terms = _Terms({int(b): k for k, b in enumerate(m.kept)})
        for b in batches:
            found = [m.margin(sorted(_present(t, terms))) for t in decoded(b.column(text_col))]
            found = 1 / (1 + np.exp(-np.clip(np.array(found, dtype=float), -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], schema=b.schema.append(pa.field(out_col, pa.float64())))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))


def score_table(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000) -> DataFrame:
    """(doc_id, score) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return score(rows, train(docs, labels, sample_rows=sample_rows)).select("doc_id", "score")
