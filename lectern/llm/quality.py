"""Quality by Bradley-Terry pairwise ranking.

Each text gets a few surface features (lengths, repeats, symbols, case). From preference pairs
(a document labelled good over one labelled bad) weights are learned by logistic loss on feature
differences. A document's worth is the weighted sum; the cut is the quantile of the sample's
worths at the share of bad labels. Worths map to scores so that the cut lies at 0.3.

Nulls: a null text is empty; a null id or label never trains. Bytes that aren't UTF-8 are read as U+FFFD. Empty text:
features are zero. Very long texts: features of the whole. Ties: texts with the same features score alike, and a score
of just 0.3 is good. Repeated rows: scored each, trained on once (with the larger label). No labels, or one class: every score is the smoothed
base rate. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import decoded
from .labelled import sampled_features

#: Classes of ASCII bytes.
_SYMBOL = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"])
_DIGIT, _UPPER, _STOP = np.arange(48, 58), np.arange(65, 91), np.array([ord(c) for c in ".!?"])
NAMES = ["words", "distinct", "top_word", "echoes", "symbols", "digits", "capitals", "stops", "word_length", "repeated_lines", "line_length", "bars", "wordless", "symbol_words"]


def features(text: str) -> list[float]:
    """Surface features of a whole text, each of the order of one."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [0.0] * len(NAMES)
    seen = Counter(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    symbols = int(count[_SYMBOL].sum())
    lines = text.split("\n")
    share = lambda x: float(np.log1p(50 * x))  # noqa: E731  small shares matter most
    echoes = sum(map(eq, words, words[1:])) / n
    return [
        np.log1p(n) / 5, np.log(len(seen)) / np.log(n) if n > 1 else 1.0, share(max(seen.values()) / n) if n > 20 else 0.0, share(echoes), share(symbols / size),
        share(int(count[_DIGIT].sum()) / size), share(int(count[_UPPER].sum()) / size), share(int(count[_STOP].sum()) / n), (size - n) / n / 6,
        1 - len(set(lines)) / len(lines), np.log1p(size / len(lines)) / 5, share(int(count[124]) / n), share(int(count[:33].sum()) / size), share(min(1.0, symbols / n)),
    ]


@dataclass
class BradleyTerry:
    weight: np.ndarray
    cut: float
    scale: float
    base: float | None = None  # the score of all, where there was nothing to learn

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        z = self.scale * (x @ self.weight - self.cut) + np.log(0.3 / 0.7)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(label: np.ndarray, x: np.ndarray, rounds: int = 12, steps: int = 400, seed: int = 5) -> BradleyTerry:
    """``rounds``: opponents of each document in the pairs."""
    good, bad = np.flatnonzero(label > 0), np.flatnonzero(label <= 0)
    if not len(good) or not len(bad):
        return BradleyTerry(np.zeros(x.shape[1] if x.ndim > 1 else 0), 0.0, 1.0, (len(good) + 0.5) / (len(label) + 1))
    spread = x.std(axis=0) + 1e-6
    rng = np.random.default_rng(seed)
    more = max(len(good), len(bad)) * rounds
    win, lose = rng.choice(good, more), rng.choice(bad, more)
    d = (x[win] - x[lose]) / spread
    w, g = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(p @ d) / len(d) + 1e-4 * w
        g += grad * grad
        w -= 0.3 * grad / np.sqrt(g)
    w = w / spread
    worth = np.sort(x @ w)
    k = len(bad)
    return BradleyTerry(w, float((worth[k - 1] + worth[k]) / 2), float(2 / (np.std(x[good] @ w) + 1e-6)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 8000) -> BradleyTerry:
    """Fits on at most ``sample_rows`` labelled documents outside the held-out fold."""
    y, x = sampled_features(docs, labels, label, features, "double", sample_rows)
    return fit(y, x.flatten().to_numpy().reshape(-1, len(NAMES)))


def score_table(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000) -> DataFrame:
    """(doc_id, score) of every document."""
    model = train(docs, labels, sample_rows=sample_rows)

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in decoded(b.column(1))]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, score double")
