"""Exact top-k inner products, norm-sorted with pruning.

Vectors are scaled to whole numbers, so scores are exact. A rotation onto the eigenvectors of the
sum of outer products (the right singular vectors of the data) gathers length in the first
dimensions. Vectors are dealt by descending length into ranges of bounded size over the whole table, and
queries by the length that a vector must have to reach the query's k-th best so far, which starts from the
longest vectors of all. A query meets only ranges that hold such lengths. There a pair is dropped as soon as the
largest score it could have (a partial sum over an eighth, a quarter, then half of the rotated dimensions, plus the
product of the residual lengths, by Cauchy and Schwarz) stays under the query's k-th best. What is left is
scored exactly; equal scores are never dropped.

A task holds one range of vectors and one range of queries, each of about ``cells`` numbers, and passes on
k rows per query at most. Nothing but the seeds, the rotation and the ranges' greatest lengths reaches the driver.

Vectors that are null or hold a null or non-finite component, and rows without an id, take no
part. Shorter vectors count as padded with zeros; very long ones (beyond ``rotated`` components) are rotated in
their first components only. A query id that repeats asks once (its smallest
vector); a candidate that repeats is ranked each time; rows with the query's id are its own. Ties go to the smaller id. Scores
beyond 64 bits are held at the ends of the range. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

_EXACT, _LONG = 2.0**53, 2**63 - 1


def _matrix(column, width: int) -> np.ndarray:
    """Floor of the scaled components as float64, padded to the width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of paired rows, as int64."""
    if not len(a):
        return np.zeros(0, np.int64)
    if a.shape[1] * max(1.0, np.abs(a).max()) * max(1.0, np.abs(b).max()) < _EXACT:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    whole = ([int(x) * int(y) for x, y in zip(p, q)] for p, q in zip(a, b))
    return np.array([max(-_LONG - 1, min(_LONG, sum(w))) for w in whole], dtype=np.int64)


class Best:
    """The k best (score, then smaller id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.q, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(queries, -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        q, ids, scores = np.concatenate((self.q, q)), np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        order = np.lexsort((ids, -scores.astype(np.float64), q)) if np.abs(scores.astype(np.float64)).max(initial=0) < _EXACT else np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(scores[i]), ids[i])), dtype=int)
        q, ids, scores = q[order], ids[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], scores[last].astype(np.float64))
        self.q, self.ids, self.scores = q[keep], ids[keep], scores[keep]


def _heads(width: int) -> list[int]:
    return sorted({max(1, width // 8), max(1, width // 4), max(1, width // 2)})


def _rotate(m: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """The first components rotated; beyond the rotation's width they stay."""
    n = len(rotation)
    if m.shape[1] < n:
        m = np.pad(m, ((0, 0), (0, n - m.shape[1])))
    return np.concatenate((m[:, :n] @ rotation, m[:, n:]), axis=1)


def search(best: Best, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, rotation: np.ndarray, step: int = 512) -> int:
    """Adds to ``best`` what the candidates offer, and tells how many pairs were scored in full.

    ``best.floor`` may start from any k-th score that is reached elsewhere.
    """
    if not len(ids) or not len(q_ids):
        return 0
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (q, c))
    length = np.sqrt((c * c).sum(1))
    order = np.argsort(-length, kind="stable")
    ids, c, length = ids[order], c[order], length[order]
    qr, cr = _rotate(q, rotation), _rotate(c, rotation)
    heads = _heads(min(len(rotation), width))
    q_length = np.sqrt((q * q).sum(1))
    q_rest, c_rest = ([np.sqrt((m[:, h:] ** 2).sum(1)) for h in heads] for m in (qr, cr))
    exact = width * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) < _EXACT
    scored = 0
    for at in range(0, len(ids), step):
        slack = 1e-9 * q_length * length[at] + 1e-6
        rows = np.flatnonzero(q_length * length[at] + slack >= best.floor)
        if not len(rows):
            break  # the rest is shorter still
        cols = np.arange(at, min(at + step, len(ids)))
        acc, low = np.zeros((len(rows), len(cols))), 0
        for h, qe, ce in zip(heads, q_rest, c_rest):
            acc += qr[rows, low:h] @ cr[cols, low:h].T
            low = h
            live = acc + np.outer(qe[rows], ce[cols]) + slack[rows][:, None] >= best.floor[rows][:, None]
            r, k = live.any(1), live.any(0)
            if not r.any():
                break
            if 2 * r.sum() * k.sum() < live.size:
                rows, cols, acc, live = rows[r], cols[k], acc[np.ix_(r, k)], live[np.ix_(r, k)]
        scored += int(live.sum())
        if exact and 16 * live.sum() > live.size:  # many are left: one product of whole numbers, exact in floating point
            full = q[rows] @ c[cols].T
            live &= full >= best.floor[rows][:, None]
        else:
            full = None
        row, col = np.nonzero(live)
        other = q_ids[rows[row]] != ids[cols[col]]
        row, col = row[other], col[other]
        for b in range(0, len(row), 1 << 16):
            r, k = row[b : b + (1 << 16)], col[b : b + (1 << 16)]
            scores = _dots(q[rows[r]], c[cols[k]]) if full is None else full[r, k].astype(np.int64)
            best.add(rows[r], ids[cols[k]], scores)
    return scored


def _rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the sum of outer products, by falling eigenvalue; width x width numbers reach the driver."""

    def run(batches):
        total = np.zeros((width, width))
        for b in batches:
            m = _matrix(b.column(0), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], ["line", "v"])

    gram = np.zeros((width, width))
    lines = rows.select(F.slice("vec", 1, width).alias("vec")).mapInArrow(run, "line long, v array<double>")
    lines = lines.select("line", F.posexplode("v").alias("at", "v")).groupBy("line", "at").agg(F.sum("v").alias("v")).toArrow()
    gram[lines.column("line").to_numpy(), lines.column("at").to_numpy()] = lines.column("v").to_numpy()
    if not np.isfinite(gram).all():
        return np.eye(width)
    return np.linalg.eigh(gram)[1][:, ::-1]


def _asked(k: int, seeds: tuple, rotation: np.ndarray, longest: np.ndarray):
    """Each query with its k-th best among the seeds, and how many ranges of vectors may hold better ones."""

    def run(batches):
        for b in batches:
            ids, vec = b.column(0).to_numpy(), _matrix(b.column(1), int(pc.max(pc.list_value_length(b.column(1))).as_py() or 0)) if b.num_rows else None
            if not b.num_rows:
                continue
            first = Best(len(ids), k)
            search(first, ids, vec, *seeds, rotation)
            length = np.sqrt((vec * vec).sum(1))
            need = np.where(length > 0, first.floor / np.maximum(length, 1e-300), np.where(first.floor > 0, np.inf, -np.inf))
            need = np.where(need > 0, need * (1 - 1e-9) - 1e-6, -np.inf)
            reach = np.searchsorted(-longest, -need, side="right")  # ranges whose greatest length suffices
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(first.floor), pa.array(reach.astype(np.int32))], ["q_id", "q_vec", "floor", "reach"])

    return run


def _meet(k: int, rotation: np.ndarray, cells: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = [[], [], []]
        if vectors.num_rows and queries.num_rows:
            width = max(pc.max(pc.list_value_length(x)).as_py() for x in (vectors.column("vec"), queries.column("q_vec")))
            rows = max(1, cells // max(1, width))
            for q_at in range(0, queries.num_rows, rows):
                part = queries.slice(q_at, rows)
                q_ids, best = part.column("q_id").to_numpy(), Best(part.num_rows, k)
                best.floor = part.column("floor").to_numpy().copy()
                q = _matrix(part.column("q_vec"), width)
                for at in range(0, vectors.num_rows, rows):
                    mine = vectors.slice(at, rows)
                    search(best, q_ids, q, mine.column("id").to_numpy(), _matrix(mine.column("vec"), width), rotation)
                for out, x in zip(found, (q_ids[best.q], best.ids, best.scores)):
                    out.append(x)
        return pa.table({n: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), found)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = 1 << 22, seeds: int = 2048, rotated: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest of each query over all other rows."""
    spark = vectors.sparkSession
    vec = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec"), is_query.alias("asks"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(sound)
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")))
    rows = cut(rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))))
    size = rows.agg(F.max(F.size("vec")).alias("width"), F.count("*").alias("n"), F.sum(F.size("vec")).alias("cells")).first()
    if size.width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tasks = spark.sparkContext.defaultParallelism
    ranges = max(-(-size.cells // cells), min(-(-size.n // 512), 2 * tasks), 1)
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(ranges, F.col("norm").desc(), "id", "row")
    dealt = cut(dealt.select("id", "vec", "norm", F.spark_partition_id().alias("part")))
    lines = dealt.groupBy("part").agg(F.max("norm").alias("norm")).toArrow()  # a row per range
    order = np.lexsort((lines.column("part").to_numpy(), -lines.column("norm").to_numpy()))
    parts, longest = lines.column("part").to_numpy()[order], lines.column("norm").to_numpy()[order]
    rotation = _rotation(rows, max(1, min(size.width, rotated)))
    few = max(1, min(seeds, cells // max(1, size.width)))
    seed = rows.orderBy(F.col("norm").desc(), "id").limit(few).select("id", "vec").toArrow()
    seeded = (seed.column("id").to_numpy(), _matrix(seed.column("vec"), max(1, size.width)))
    asking = rows.where("asks").groupBy("id").agg(F.min("vec").alias("vec"))
    asking = cut(asking.select("id", "vec").mapInArrow(_asked(k, seeded, rotation, longest), "q_id long, q_vec array<double>, floor double, reach int"))
    blocks = max(1, -(-(asking.agg(F.sum(F.size("q_vec"))).first()[0] or 0) // cells))
    if blocks > 1:
        asking = cut(asking.repartitionByRange(blocks, F.col("reach").desc(), "q_id").select("*", F.spark_partition_id().alias("block")))
    else:
        asking = asking.withColumn("block", F.lit(0))
    reach = asking.groupBy("block").agg(F.max("reach").alias("reach"), F.count("*").alias("n")).toArrow()  # a row per block of queries
    met = {int(p): [int(b) for b, r in zip(reach.column("block").to_numpy(), reach.column("reach").to_numpy()) if r > place] for place, p in enumerate(parts)}
    where = spark.createDataFrame([(p, place, b) for place, p in enumerate(map(int, parts)) if (b := met[p])], "part int, place int, blocks array<int>")
    left = dealt.join(F.broadcast(where), "part").select("id", "vec", "place", F.explode("blocks").alias("block"))  # a row per range
    right = asking.where("reach > 0").select("q_id", "q_vec", "floor", "block", F.explode(F.sequence(F.lit(0), F.col("reach") - 1)).alias("place"))
    found = left.groupBy("place", "block").cogroup(right.groupBy("place", "block")).applyInArrow(_meet(k, rotation, cells), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
