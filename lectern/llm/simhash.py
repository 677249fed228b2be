"""SimHash near-duplicates by Burkhard-Keller trees.

Fingerprints of word shingles are computed in one pass; equal ones are one row from then on.
Fingerprints that differ in at most r bits agree on one of r + 1 blocks of bits, so each is
dealt to one group per block value that another fingerprint shares. A group with more rows than a tree takes is
dealt again, by blocks of the bits that its block leaves, of which again one must agree; only groups that are
still too large after three such steps are split into parts, and each pair of parts is searched apart, so no task
gets an unbounded group. A tree (children keyed by integer Hamming distance to the parent) holds a group; its
queries are the rows of the group, which follow only edges within the radius. Small groups share a task, as a
forest. A task passes on one edge per row (to the smallest of its local component), not all pairs. Components are
joined up over all tasks.

The trees aren't sent by the driver, since fingerprints grow with the data: a group's tree is
built in the task that gets the group.

``near_duplicates`` takes 64 bits and a radius in bits. ``keep_one`` takes a similarity: distinct shingles give
512 bits, of which two texts differ in the share that the angle between their sets makes up, and the radius is what
that similarity makes on average and one standard deviation more. At that radius blocks of bits would hold
all texts, so there groups are texts that agree on a pair of smallest shingle hashes, of seven pairs; texts of
similarity 0.8 share one of them but for one in a thousand.

Nulls: a null text has no words; a null id stays null and never names a component unless all
ids in it are null. No words: fingerprint zero, linked like any other. Very long texts: all their shingles, hashed
65,536 at a time. Repeated rows and ties: the same component; of rows alike in id and text any one stays. Empty
table: empty result. Other columns are ignored, or kept as they are by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh_name, fresh_path, in_files
from .components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STEP = 1 << 16


def _shingles(text: bytes | None, words_per_shingle: int):
    """Arrays of the XXH64 of each shingle, repeats included, a bounded number at a time."""
    import xxhash

    words = (text or b"").translate(_LOWER).split()
    if not words:
        return
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: len(words) - k])).tolist()
    ends = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _STEP):
        yield np.array([digest(joined[s:e], 42) for s, e in zip(starts[at : at + _STEP], ends[at : at + _STEP])], dtype=np.uint64)


def _ones(h: np.ndarray) -> np.ndarray:
    """How often each bit is set, the highest first."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1).sum(axis=0, dtype=np.int32)


def fingerprint(text: bytes | None, words_per_shingle: int = 3) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in _shingles(text, words_per_shingle):
        n += len(h)
        ones += _ones(h)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


_WORDS, _BANDS, _PER_BAND = 8, 7, 2
_ODD = np.random.default_rng(11).integers(0, 2**63, _WORDS + _BANDS * _PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A fresh 64-bit hash of each for each multiplier."""
    x = h[:, None] * times
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def wide_fingerprint(text: bytes | None, words_per_shingle: int = 5) -> tuple[bytes, list[int]]:
    """(512 bits over the distinct shingles, a value for each pair of their smallest hashes)."""
    n, ones, least = 0, np.zeros(64 * _WORDS, np.int64), np.full(_BANDS * _PER_BAND, 2**64 - 1, np.uint64)
    parts = list(_shingles(text, words_per_shingle))
    h = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    for at in range(0, len(h), _STEP):
        x = _mixed(h[at : at + _STEP], _ODD)
        n += len(x)
        ones += _ones(np.ascontiguousarray(x[:, :_WORDS]))
        least = np.minimum(least, x[:, _WORDS:].min(axis=0))
    pairs = least.reshape(_BANDS, _PER_BAND)
    values = _mixed(pairs[:, 0] ^ (pairs[:, 1] * np.uint64(0x9E3779B97F4A7C15)), _ODD[:1])[:, 0]
    return np.packbits(2 * ones > n).tobytes(), values.view(np.int64).tolist()


def radius_of(similarity: float, bits: int = 64 * _WORDS) -> int:
    """Bits in which texts of that Jaccard similarity differ on average, and one standard deviation."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + math.sqrt(bits * share * (1 - share)))


def _fingerprints(words_per_shingle: int):
    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), words_per_shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(id, fp) per row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("body"))
    return rows.mapInArrow(_fingerprints(words_per_shingle), "id long, fp long")


def _rows(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.uint64)
    return codes if codes.ndim == 2 else codes[:, None]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class BKTree:
    """Burkhard-Keller tree over codes of 64 bits or rows of several times 64, built and searched a level at a time; with ``group``, a tree per group."""

    def __init__(self, codes: np.ndarray, group: np.ndarray | None = None):
        self.codes = _rows(codes)
        n = len(codes)
        self.span = 64 * self.codes.shape[1] + 1
        _, first, of = np.unique(np.zeros(n, int) if group is None else group, return_index=True, return_inverse=True)
        self.root = first[of.ravel()]  # by code: where its group's tree begins
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        waiting = np.flatnonzero(self.root != np.arange(n))
        at = self.root[waiting]  # the node each waiting code stands at
        while len(waiting):
            d = _apart(self.codes[waiting], self.codes[at])
            slot = at * self.span + d
            _, first, which = np.unique(slot, return_index=True, return_inverse=True)
            child = waiting[first]  # the first to take an edge becomes the child
            parent[child], edge[child] = at[first], d[first]
            stay = np.ones(len(waiting), bool)
            stay[first] = False
            waiting, at = waiting[stay], child[which][stay]
        kids = np.flatnonzero(parent >= 0)
        slots = parent[kids] * self.span + edge[kids]
        order = np.argsort(slots, kind="stable")
        self.kids, self.slots = kids[order], slots[order]

    def within(self, queries: np.ndarray, radius: int, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query position, node) for each code within the radius, from the root given for each query."""
        queries = _rows(queries)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64) if root is None else root
        if not len(self.codes):
            q, node = q[:0], node[:0]
        while len(q):
            d = _apart(queries[q], self.codes[node])
            hit = d <= radius
            found.append((q[hit], node[hit]))
            lo = np.searchsorted(self.slots, node * self.span + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.slots, node * self.span + np.minimum(d + radius, self.span - 1), side="right")
            many = hi - lo
            q = np.repeat(q, many)
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            node = self.kids[np.repeat(lo, many) + step]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _join(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins components by pairs of rows, which aren't kept; ``of``, by row: the first row of its component."""
    a, b = of[a], of[b]
    apart = a != b
    a, b = a[apart], b[apart]
    now = np.arange(len(of))
    while len(a):
        was = now.copy()
        np.minimum.at(now, a, now[b])
        np.minimum.at(now, b, now[a])
        if (was == now).all():
            break
    of[:] = now[of]


def _shard_edges(radius: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        node = rows["node"].to_numpy().astype(np.int64)
        codes = np.frombuffer(b"".join(rows["code"]), np.uint64).reshape(len(rows), -1)
        group = rows.groupby(["block", "value"], sort=False).ngroup().to_numpy()
        if (rows["i"].iat[0] == rows["j"].iat[0]) or rows["tree"].all():
            grown = asking = np.arange(len(codes))
        else:
            grown, asking = np.flatnonzero(rows["tree"].to_numpy()), np.flatnonzero(~rows["tree"].to_numpy())
        tree = BKTree(codes[grown], group[grown])
        begins = dict(zip(group[grown].tolist(), tree.root.tolist()))
        root = np.array([begins.get(g, -1) for g in group[asking].tolist()], np.int64)
        asking, root = asking[root >= 0], root[root >= 0]
        of, step = np.arange(len(codes)), max(1, 256 // codes.shape[1])
        for at in range(0, len(asking), step):
            q, n = tree.within(codes[asking[at : at + step]], radius, root[at : at + step])
            _join(of, asking[at : at + step][q], grown[n])
        low = node.copy()  # smallest node of the local component, at the component's first row
        np.minimum.at(low, of, node)
        low = low[of]
        out = low != node
        return pd.DataFrame({"a": node[out], "b": low[out]})

    return run


def _met(keyed: DataFrame, rows: int) -> DataFrame:
    """Rows (node, code, block, value), ``rows`` at most, whose value another row shares, with ``n``, the rows that do."""
    shared = keyed.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
    return cut(keyed.join(shared, ["block", "value"]), rows)


def _in_groups(near: DataFrame, radius: int, tree_rows: int) -> DataFrame:
    """Edges (a, b) that join up what lies within the radius in a group; ``near``: node, code, block, value, n."""
    shards = max(1, -(-near.count() // tree_rows))
    parts = F.ceil(F.col("n") / tree_rows).cast("int")
    dealt = near.withColumn("parts", parts).withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    hot = F.col("parts") > 1
    shard = F.when(hot, F.struct("block", "value")).otherwise(F.struct(F.lit(-1).alias("block"), F.pmod(F.xxhash64("block", "value"), F.lit(shards)).alias("value")))
    dealt = dealt.select("node", "code", "block", "value", "p", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    dealt = dealt.select("shard", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") <= F.col("q")).alias("tree"), "node", "code", "block", "value")
    return dealt.groupBy("shard", "i", "j").applyInPandas(_shard_edges(radius), "a long, b long")


def _cuts(free: int, blocks: int) -> list[int]:
    """The bits of ``free`` in so many masks, one after the other."""
    bits = [b for b in range(64) if free >> b & 1]
    ends = [len(bits) * k // blocks for k in range(blocks + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(ends, ends[1:])]


def links(codes: DataFrame, radius: int = 2, tree_rows: int = 4096, steps: int = 3) -> DataFrame:
    """Edges (a, b) that join up what lies within the radius; ``codes``: distinct fp."""
    whole = (1 << 64) - 1
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    rows = codes.select(F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("code"))
    masks, edges = [0], []
    rows, n = rows.withColumn("block", F.lit(0)), codes.count()
    for step in range(steps):
        finer = [[m | c for c in _cuts(whole & ~m, radius + 1)] for m in masks]
        lists = F.get(F.array(*[F.array(*[F.lit(signed(m)) for m in x]) for x in finer]), F.col("block"))
        keys = F.transform(lists, lambda m, k: F.struct((F.col("block") * (radius + 1) + k).alias("block"), F.col("node").bitwiseAND(m).alias("value")))
        near = _met(rows.select("node", "code", F.explode(keys).alias("key")).select("node", "code", "key.block", "key.value"), n * (radius + 1))
        masks = [m for x in finer for m in x]
        if step + 1 == steps:
            edges.append(_in_groups(near, radius, tree_rows))
            break
        edges.append(_in_groups(near.where(F.col("n") <= tree_rows), radius, tree_rows))
        rows = near.where(F.col("n") > tree_rows).select("node", "code", "block")
        n = rows.count()
        if not n:
            break
    return reduce(DataFrame.unionByName, edges)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words_per_shingle: int = 3, tree_rows: int = 4096) -> DataFrame:
    """(id, fp, component) per row: component is the smallest id that links reach."""
    rows = cut(fingerprints(docs, id_col, text_col, words_per_shingle))
    codes = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    n = rows.count()
    codes = cut(codes, n)
    roots = components(links(codes.select("fp"), radius, tree_rows), n * (radius + 1))
    of = codes.join(roots, codes["fp"] == roots["u"], "left").select("fp", "first_id", F.coalesce("v", "fp").alias("root"))
    named = of.groupBy("root").agg(F.min("first_id").alias("component"))
    return in_files(rows.join(of.join(named, "root").select("fp", "component"), "fp").select("id", "fp", "component"), n)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words_per_shingle: int = 5, tree_rows: int = 4096) -> DataFrame:
    """``docs`` with one row of each group of texts that are alike by ``similarity``: the smallest id (null after all others), of repeats any one.

    The documents are written to the shared folder with a fingerprint and a row number, so that the rows
    that go can be told whatever repeats; only those rows' numbers meet the texts again.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    code, bands, row = (fresh_name(n, docs.columns) for n in ("_simhash", "_bands", "_row"))

    def run(batches):
        for b in batches:
            found = [wide_fingerprint(v.as_py(), words_per_shingle) for v in b.column(at).cast(pa.binary())]
            yield b.append_column(code, pa.array([c for c, _ in found], pa.binary())).append_column(bands, pa.array([v for _, v in found], pa.list_(pa.int64())))

    schema = T.StructType([*docs.schema.fields, T.StructField(code, T.BinaryType()), T.StructField(bands, T.ArrayType(T.LongType()))])
    path = fresh_path(spark, "simhash")
    docs.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    rows = stored.select(F.col(row).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(code).alias("code"), F.col(bands).alias("bands"))
    order = F.struct(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), "row", "bands")
    codes = rows.groupBy("code").agg(F.min(order).alias("first"))
    n = rows.count()
    codes = cut(codes.select("code", F.col("first.row").alias("node"), "first.bands", F.struct("first.no_id", "first.id", "first.row").alias("first")), n)
    near = _met(codes.select("node", "code", F.posexplode("bands").alias("block", "value")), n * _BANDS)
    roots = components(_in_groups(near, radius_of(similarity), tree_rows), n * _BANDS)
    of = codes.join(roots, codes["node"] == roots["u"], "left").select("code", "first", F.coalesce("v", "node").alias("root"))
    stays = of.groupBy("root").agg(F.min("first").alias("least"))
    stays = of.join(stays.select("root", F.col("least.row").alias("stays")), "root").select("code", "stays")
    gone = rows.join(stays, "code").where("row != stays").select(F.col("row").alias("_gone"))
    return stored.join(gone, stored[row] == gone["_gone"], "left_anti").select(*[f"`{c}`" for c in docs.columns])
