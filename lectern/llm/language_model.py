"""Language-model scores by context-tree weighting over bytes.

A text is its bytes, lower-cased in ASCII, and one end byte that no UTF-8 text holds. Each byte is
eight binary decisions; the tree of contexts holds, for each run of up to ``depth`` preceding bytes
and each place in the decisions, how often either way was taken. A node's Krichevsky-Trofimov
estimate and the product over its children are mixed by halves at all depths, which gives each
byte a code length.

Counts cover every training text, and every context seen is a node, so the tree grows with the corpus and
is neither gathered nor broadcast. Texts are dealt into blocks of bounded size, kept compressed. Each block lists its
distinct grams (a context of ``depth`` bytes and the next byte) and words with their training counts, in shards:
grams by the two nearest context bytes, words by a hash. A shard adds up the lists and works out its nodes of depth 2
and more; the root and the nodes of depth 1, 257 at most, are worked out on the driver. Each list is then answered
with its grams' code lengths and its words' counts, in the list's order, which a block knows again from its texts.
A context without training counts says one half at each place. Shards grow in number with the corpus up to 4096;
beyond ``split_blocks`` blocks the lists of a shard are added up in steps, and answered in several tasks.

Nulls: a null text is empty (one end token); a null id counts as empty text for its fold. Very long texts: read
in segments of a megabyte, scored as a whole. Repeated rows (ties): scored each, counted each. No training texts: every byte
costs eight bits, all words are unknown. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import fold_of, fresh_path

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
END = 0xFF
_SEGMENT = 1 << 20


def segments(texts, depth: int):
    """(buffer, predicted, text number): batches of about a megabyte; contexts of ``depth`` bytes precede each segment."""
    parts, where, owner, size = [], [], [], 0
    pad = bytes([END]) * depth
    for n, text in enumerate(texts):
        body = text + bytes([END])
        for at in range(0, len(body), _SEGMENT):
            piece = body[at : at + _SEGMENT]
            before = (pad + body[:at])[-depth:] if at < depth else body[at - depth : at]
            parts.append(before + piece)
            where.append((size + depth, size + depth + len(piece)))
            owner.append(n)
            size += depth + len(piece)
            if size >= _SEGMENT:
                yield np.frombuffer(b"".join(parts), np.uint8), where, owner
                parts, where, owner, size = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), where, owner


def _places(where) -> np.ndarray:
    lengths = np.array([b - a for a, b in where])
    starts = np.array([a for a, _ in where])
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def gram_codes(buffer: np.ndarray, where, depth: int) -> np.ndarray:
    """Context and byte as one number for each predicted place: the byte lowest, then from the nearest context byte."""
    at = _places(where)
    code = buffer[at].astype(np.int64)
    for d in range(1, depth + 1):
        code |= buffer[at - d].astype(np.int64) << (8 * d)
    return code


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of 255 places (1 to 255, in heap order) from counts of 256 bytes."""
    zeros, ones = np.zeros(counts.shape), np.zeros(counts.shape)
    for level in range(8):
        halves = counts.reshape(len(counts), 1 << level, 2, 128 >> level).sum(-1)
        zeros[:, 1 << level : 2 << level], ones[:, 1 << level : 2 << level] = halves[:, :, 0], halves[:, :, 1]
    return zeros, ones


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - math.log(math.pi)


class ContextTree:
    """``log10[node, byte]`` with the whole mixture applied, and ``child[node, byte]`` (0: none; node 1: root)."""

    def __init__(self, depth: int, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """rows[d]: contexts of d bytes (nearest lowest), following bytes, counts, of the contexts that are nodes."""
        self.depth = depth
        nodes = [np.unique(c) for c, _, _ in rows]
        if not len(nodes[0]):
            nodes = [np.zeros(1, np.int64)] + [np.zeros(0, np.int64)] * depth
        first = 1 + np.concatenate(([0], np.cumsum([len(n) for n in nodes])))
        counts, parent = [], [np.zeros(0, int)]
        self.child = np.zeros((first[-1], 256), np.int32)
        for d, (ctx, sym, n) in enumerate(rows):
            table = np.zeros((len(nodes[d]), 256))
            np.add.at(table, (np.searchsorted(nodes[d], ctx), sym), n)
            counts.append(table)
            if d:
                up = np.searchsorted(nodes[d - 1], nodes[d] & ((1 << (8 * (d - 1))) - 1))
                parent.append(up)
                self.child[first[d - 1] + up, nodes[d] >> (8 * (d - 1))] = first[d] + np.arange(len(nodes[d]))
        stop: list[np.ndarray] = [np.zeros(0)] * (depth + 1)  # weight of a node's own estimate
        below = None  # log of the weighted probability of each node one deeper
        rest = [c.copy() for c in counts]
        for d in range(depth, -1, -1):
            own = _log_kt(*_decisions(counts[d]))
            if d == depth:
                stop[d], below = np.ones_like(own), own
                continue
            np.subtract.at(rest[d], parent[d + 1], counts[d + 1])
            split = _log_kt(*_decisions(rest[d]))
            np.add.at(split, parent[d + 1], below)
            stop[d] = 1 / (1 + np.exp(np.clip(split - own, -700, 700)))
            below = np.logaddexp(own, split) - math.log(2)
        self.log10 = np.full((first[-1], 256), -8 * math.log10(2), np.float32)
        mixed, left = np.zeros((1, 256)), np.ones((1, 256))
        for d in range(depth + 1):
            zeros, ones = _decisions(counts[d])
            above, weight = (mixed[parent[d]], left[parent[d]]) if d else (mixed, left)
            mixed = above + weight * stop[d] * (ones + 0.5) / (zeros + ones + 1)
            left = weight * (1 - stop[d])
            zeros, ones = _decisions(rest[d])
            one = np.clip(mixed + left * (ones + 0.5) / (zeros + ones + 1), 1e-12, 1 - 1e-12)
            out = np.zeros((len(one), 256))
            for level in range(8):
                at = (256 | np.arange(256)) >> (8 - level)
                bit = (np.arange(256) >> (7 - level)) & 1
                out += np.log10(np.where(bit, one[:, at], 1 - one[:, at]))
            self.log10[first[d] : first[d + 1]] = out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        total = np.zeros(len(texts))
        for buffer, where, owner in segments(texts, self.depth):
            at = _places(where)
            node = best = np.ones(len(at), np.int32)
            for d in range(1, self.depth + 1):
                node = self.child[node, buffer[at - d]]
                best = np.where(node > 0, node, best)
            cost = self.log10[best, buffer[at]].astype(np.float64)
            lengths = np.array([b - a for a, b in where])
            np.add.at(total, owner, np.add.reduceat(cost, np.cumsum(lengths) - lengths))
        return total


def _bytes(column) -> list[bytes]:
    return [(t.as_py() or b"").translate(_LOWER) for t in column]


_CHUNK = 1 << 20
CHUNKS = "block long, ids array<{kind}>, held array<boolean>, lengths array<long>, body binary"


def squeeze(body: bytes) -> bytes:
    import zstandard

    return zstandard.compress(body, 3)


def unsqueeze(body: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(body) if body else b""


def _chunks(block_bytes: int, id_type: pa.DataType):
    """Rows (id, held, body) as chunks of about a megabyte; a block is consecutive chunks of a task, of about ``block_bytes`` bytes."""

    def chunk(block, rows):
        ids, held, texts = zip(*rows)
        lists = [pa.array([list(x)], pa.list_(t)) for x, t in ((ids, id_type), (held, pa.bool_()), ([len(t) for t in texts], pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists, pa.array([squeeze(b"".join(texts))], pa.binary())], ["block", "ids", "held", "lengths", "body"])

    def run(batches):
        block, filled, rows, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = (t.as_py() or b"").translate(_LOWER)
                if rows and (size + len(text) > _CHUNK or filled + size + len(text) > block_bytes):
                    yield chunk(block, rows)
                    filled, rows, size = filled + size, [], 0
                    if filled + len(text) > block_bytes:
                        block, filled = block + 1, 0
                rows.append((i, h, text))
                size += len(text) + 1
        if rows:
            yield chunk(block, rows)

    return run


def _texts(lengths: list[int], body: bytes) -> list[bytes]:
    whole, at, out = unsqueeze(body), 0, []
    for n in lengths:
        out.append(whole[at : at + n])
        at += n
    return out


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """By the two nearest context bytes."""
    return (((grams >> 8) & 0xFFFF) * 2654435761 >> 16) % shards


def word_shards(words: list[bytes], shards: int) -> dict[int, list[bytes]]:
    """Words, which ascend, by shard."""
    out: dict[int, list[bytes]] = {}
    for w in words:
        out.setdefault(zlib.crc32(w) % shards, []).append(w)
    return out


def planes(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, which compress well."""
    return squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def of_planes(body: bytes, kind: str = "<i8") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unsqueeze(body), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_grams(codes: np.ndarray) -> bytes:
    """Ascending codes by their differences."""
    return planes(np.diff(codes, prepend=0).astype("<i8"))


def unpack_grams(body: bytes) -> np.ndarray:
    return np.cumsum(of_planes(body))


def _summed(grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([np.zeros(0, np.int64), *[c for c, _ in grams]]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([np.zeros(0), *[n for _, n in grams]]), len(codes)).astype(np.int64)


LISTS = "block long, shard int, grams binary, counts binary, words binary, tallies binary"


def _lists(block, codes: np.ndarray, counts: np.ndarray, words: dict[bytes, int], shards: int) -> pa.RecordBatch:
    """A row per shard: its grams and words, ascending, with their counts."""
    shard = shard_of(codes, shards)
    order = np.argsort(shard, kind="stable")
    kinds, first = np.unique(shard[order], return_index=True)
    of_grams = dict(zip(kinds.tolist(), np.split(order, first[1:])))
    of_words = word_shards(sorted(words), shards)
    both = sorted(of_grams.keys() | of_words.keys())
    rows = [[pack_grams(codes[x]), planes(counts[x])] if (x := of_grams.get(k)) is not None else [None, None] for k in both]
    more = [[squeeze(b" ".join(w)), planes(np.array([words[x] for x in w], "<i8"))] if (w := of_words.get(k)) else [None, None] for k in both]
    columns = [pa.array(list(c), pa.binary()) for c in zip(*[r + m for r, m in zip(rows, more)])] if both else [pa.array([], pa.binary())] * 4
    return pa.RecordBatch.from_arrays([pa.array([block] * len(both), pa.int64()), pa.array(both, pa.int32()), *columns], ["block", "shard", "grams", "counts", "words", "tallies"])


def _count(depth: int, shards: int):
    """Each block's distinct grams and words with their training counts, summed in the task and passed on when they fill a bounded table."""

    def run(batches):
        words, grams, now = Counter(), [], None
        for b in batches:
            for block, held, lengths, body in zip(*(c.to_pylist() for c in b.columns)):
                if now is not None and (now != block or len(words) > 2_000_000 or (grams and len(grams[0][0]) > 4_000_000)):
                    yield _lists(now, *_summed(grams), words, shards)
                    words, grams = Counter(), []
                now, texts = block, _texts(lengths, body)
                for unseen in (False, True):
                    part = [t for t, h in zip(texts, held) if bool(h) == unseen]
                    for t in part:
                        if unseen:
                            words.update(dict.fromkeys(t.split(), 0))
                        else:
                            words.update(t.split())
                    for buffer, where, _ in segments(part, depth):
                        codes, n = np.unique(gram_codes(buffer, where, depth), return_counts=True)
                        grams.append((codes, n * (not unseen)))
                        if sum(len(c) for c, _ in grams[1:]) > 2_000_000:
                            grams = [_summed(grams)]
        if now is not None:
            yield _lists(now, *_summed(grams), words, shards)

    return run


def _kt_rows(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The estimate by rows of pairs; equal pairs, which are most, are worked out once."""
    pairs, at = np.unique(np.stack([zeros, ones], 1), axis=0, return_inverse=True)
    return _log_kt(pairs[:, 0].astype(float), pairs[:, 1].astype(float))[at.ravel()]


def _bit_keys(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each gram and level: context above place (1 to 255), and the bit taken there."""
    sym, level = grams & 255, np.arange(8)[:, None]
    return (grams >> 8 << 8) | (256 | sym) >> (8 - level), (sym >> (7 - level)) & 1


def below_top(grams: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(8 values per gram: the probability of the bit taken, by the mixture from depth 2 down; keys of depth 1 and place; log of the
    weighted probability of their nodes of depth 2). ``grams``: all that share their two nearest context bytes with any of them."""
    keys, bits = _bit_keys(grams)
    nodes, at, zeros, ones = {}, {}, {}, {}
    key, inner = keys.ravel(), np.concatenate([counts] * 8)
    for d in range(depth, 1, -1):
        if d == depth:
            nodes[d], at[d] = np.unique(key, return_inverse=True)
            n0 = np.bincount(at[d], inner * (1 - bits.ravel()), len(nodes[d]))
            n1 = np.bincount(at[d], inner * bits.ravel(), len(nodes[d]))
        else:
            nodes[d], at[d] = np.unique(nodes[d + 1] & ((1 << (8 * (d + 1))) - 1), return_inverse=True)
            n0, n1 = np.bincount(at[d], zeros[d + 1], len(nodes[d])), np.bincount(at[d], ones[d + 1], len(nodes[d]))
        zeros[d], ones[d] = n0, n1
    stop, below = {}, None
    for d in range(depth, 1, -1):
        own = _kt_rows(zeros[d], ones[d])
        if d == depth:
            stop[d], below = np.ones_like(own), own
            continue
        split = np.bincount(at[d], below, len(nodes[d]))
        stop[d] = 1 / (1 + np.exp(np.clip(split - own, -700, 700)))
        below = np.logaddexp(own, split) - math.log(2)
    one, zero, left = np.zeros(len(nodes[2])), np.zeros(len(nodes[2])), np.ones(len(nodes[2]))
    for d in range(2, depth + 1):
        if d > 2:
            one, zero, left = one[at[d - 1]], zero[at[d - 1]], left[at[d - 1]]
        share = left * stop[d] / (zeros[d] + ones[d] + 1)
        one, zero, left = one + share * (ones[d] + 0.5), zero + share * (zeros[d] + 0.5), left * (1 - stop[d])
    taken = np.where(bits.ravel() == 1, one[at[depth]], zero[at[depth]]).reshape(8, -1).T
    up, where = np.unique(nodes[2] & 0xFFFF, return_inverse=True)
    return taken, up, np.bincount(where, below, len(up))


def _sums(table: pa.Table) -> tuple[np.ndarray, np.ndarray, Counter]:
    """All grams (ascending) and words of a shard's lists with counts; lists are added up a few million grams at a time."""
    held, size, words = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0, Counter()
    for x, n, w, m in zip(*(table.column(c) for c in ("grams", "counts", "words", "tallies"))):
        if x.is_valid:
            held.append((unpack_grams(x.as_py()), of_planes(n.as_py())))
            size += len(held[-1][0])
        if size > 2_000_000:
            held, size = [_summed(held)], 0
        if w.is_valid:
            words.update(dict(zip(unsqueeze(w.as_py()).split(), of_planes(m.as_py()).tolist())))
    return *_summed(held), words


def _merge(table: pa.Table) -> pa.Table:
    """A shard's lists as one."""
    codes, counts, words = _sums(table)
    kinds = sorted(words)
    row = {"block": [None], "shard": table.column("shard")[:1].to_pylist(), "grams": [pack_grams(codes)], "counts": [planes(counts)], "words": [squeeze(b" ".join(kinds))], "tallies": [planes(np.array([words[w] for w in kinds], "<i8"))]}
    types = {"block": pa.int64(), "shard": pa.int32()}
    return pa.table({c: pa.array(v, types.get(c, pa.binary())) for c, v in row.items()})


UPWARD = "key long, n long, below double, tokens long, kinds long"


def _upward(depth: int):
    def run(table: pa.Table) -> pa.Table:
        """What the top needs of a shard, by depth-1 context and byte (n) or place (below), and a row of word totals."""
        codes, counts, words = _sums(table)
        _, up, below = below_top(codes, counts, depth)
        pair, at = np.unique(codes & 0xFFFF, return_inverse=True)
        n = np.bincount(at, counts, len(pair)).astype(np.int64)
        rows = [(k, x, None, None, None) for k, x in zip(pair.tolist(), n.tolist())] + [(k, None, x, None, None) for k, x in zip(up.tolist(), below.tolist())]
        rows.append((None, None, None, sum(words.values()), sum(x > 0 for x in words.values())))
        types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], ["key", "n", "below", "tokens", "kinds"])

    return run


def top_tree(grams: np.ndarray, counts: np.ndarray, up: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By depth-1 context and place: the mixture's share of a one and of a zero down to depth 1, and the weight left for what is deeper.

    ``grams``: context byte above next byte, with counts; ``up``, ``below``: sums over the nodes of depth 2."""
    table, split = np.zeros((256, 256)), np.zeros((256, 256))
    np.add.at(table, (grams >> 8, grams & 255), counts)
    np.add.at(split, (up >> 8, up & 255), below)
    one = zero = np.zeros((1, 256))
    left = np.ones((1, 256))
    levels = []
    for n in (table, table.sum(0, keepdims=True)):
        zeros, ones = _decisions(n)
        own = _log_kt(zeros, ones)
        levels.append((zeros, ones, 1 / (1 + np.exp(np.clip(split - own, -700, 700)))))
        split = (np.logaddexp(own, split) - math.log(2)).sum(0, keepdims=True)
    for zeros, ones, stop in reversed(levels):
        share = left * stop / (zeros + ones + 1)
        one, zero, left = one + share * (ones + 0.5), zero + share * (zeros + 0.5), left * (1 - stop)
    return one, zero, left


def gram_costs(grams: np.ndarray, taken: np.ndarray, top: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context."""
    keys, bits = _bit_keys(grams)
    at, (one, zero, left) = ((keys >> 8) & 255, keys & 255), top
    p = np.where(bits == 1, one[at], zero[at]) + left[at] * taken.T
    return np.log10(np.clip(p, 1e-12, 1 - 1e-12)).sum(0)


ANSWERS = "block long, shard int, costs binary, tallies binary"


def _answers(lists: pa.Table, codes: np.ndarray, costs: np.ndarray, words: dict[bytes, int]) -> pa.Table:
    """For each block of a shard's lists the costs of its grams and the counts of its words, in ascending order of these."""
    by_block: dict[int, list[int]] = {}
    for k, block in enumerate(lists.column("block").to_pylist()):
        by_block.setdefault(block, []).append(k)
    out = []
    grams, kinds = lists.column("grams"), lists.column("words")
    for block, rows in by_block.items():
        mine = np.unique(np.concatenate([np.zeros(0, np.int64), *[unpack_grams(grams[k].as_py()) for k in rows if grams[k].is_valid]]))
        own = sorted({w for k in rows if kinds[k].is_valid for w in unsqueeze(kinds[k].as_py()).split()})
        out.append((block, planes(costs[np.searchsorted(codes, mine)]), planes(np.array([words[w] for w in own], "<i8"))))
    shard = lists.column("shard")[0].as_py() if out else 0
    return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([shard] * len(out), pa.int32()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], ["block", "shard", "costs", "tallies"])


def block_scores(chunks: list[list[bytes]], answers: dict[int, tuple[np.ndarray, np.ndarray]], depth: int, shards: int) -> tuple[list[np.ndarray], dict[bytes, int]]:
    """(log10 probability of each text and its end, by chunk; training counts of the words of all) of a whole block."""
    met, grams = [], [np.zeros(0, np.int64)]
    for texts in chunks:
        for buffer, where, owner in segments(texts, depth):
            codes, at = np.unique(gram_codes(buffer, where, depth), return_inverse=True)
            lengths = np.array([b - a for a, b in where])
            met.append((codes, at.astype(np.int32).ravel(), lengths, owner))
            grams.append(codes)
            if sum(map(len, grams[1:])) > 2_000_000:
                grams = [np.unique(np.concatenate(grams))]
        met.append(None)
    codes = np.unique(np.concatenate(grams))
    shard = shard_of(codes, shards)
    costs = np.zeros(len(codes))
    words: dict[bytes, int] = {}
    of_words = word_shards(sorted({w for texts in chunks for t in texts for w in t.split()}), shards)
    order = np.argsort(shard, kind="stable")
    kinds, first = np.unique(shard[order], return_index=True)
    for k, rows in zip(kinds.tolist(), np.split(order, first[1:])):
        costs[rows] = answers[k][0]
    for k, own in of_words.items():
        words.update(zip(own, answers[k][1].tolist()))
    out, total, chunk = [], np.zeros(len(chunks[0]) if chunks else 0), 0
    for part in met:
        if part is None:
            out.append(total)
            chunk += 1
            total = np.zeros(len(chunks[chunk]) if chunk < len(chunks) else 0)
            continue
        own, at, lengths, owner = part
        cost = costs[np.searchsorted(codes, own)][at]
        np.add.at(total, owner, np.add.reduceat(cost, np.cumsum(lengths) - lengths))
    return out, words


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, depth: int = 5, block_bytes: int = 16 << 20, shard_bytes: int = 2 << 20, split_blocks: int = 512) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    if not 2 <= depth <= 6:
        raise ValueError("depth must be from 2 to 6")
    field = docs.schema[id_col]
    kind = field.dataType.simpleString()
    body = F.col(f"`{text_col}`").cast("binary")
    held = fold_of(F.col(f"`{id_col}`"), folds) == held_fold
    path = fresh_path(spark, "language-model-texts")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), held.alias("held"), body.alias("body"))
    rows.mapInArrow(_chunks(block_bytes, to_arrow_type(field.dataType)), CHUNKS.format(kind=kind)).write.parquet(path)
    chunks = spark.read.schema(CHUNKS.format(kind=kind)).parquet(path)
    sizes = chunks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("bytes"), F.sum(F.size(F.filter("held", lambda x: ~x))).alias("ends"), F.count_distinct("block").alias("blocks")).first()
    ends, shards = sizes.ends or 0, min(4096, max(64, (sizes.bytes or 0) // shard_bytes))
    splits = max(1, -(-sizes.blocks // split_blocks))
    path = fresh_path(spark, "language-model-lists")
    chunks.select("block", "held", "lengths", "body").mapInArrow(_count(depth, shards), LISTS).write.parquet(path)
    lists = spark.read.schema(LISTS).parquet(path).withColumn("split", F.pmod(F.xxhash64("block"), F.lit(splits)).cast("int"))
    sums = lists
    if splits > 1:  # lists are added up a part at a time
        path = fresh_path(spark, "language-model-sums")
        lists.groupBy("shard", "split").applyInArrow(_merge, LISTS).write.parquet(path)
        sums = spark.read.schema(LISTS).parquet(path)
    upward = sums.groupBy("shard").applyInArrow(_upward(depth), UPWARD)
    upward = upward.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "below", "tokens", "kinds")]).toArrow()  # 65,536 keys and a row of totals
    totals = upward.filter(pc.is_null(upward.column("key")))
    upward = upward.filter(pc.is_valid(upward.column("key")))
    key, n, below = (upward.column(c).to_numpy() for c in ("key", "n", "below"))
    tokens, known_kinds = (pc.sum(totals.column(c)).as_py() or 0 for c in ("tokens", "kinds"))
    train_tokens, kinds = tokens + ends, known_kinds + (ends > 0)
    floor = math.log10(train_tokens + kinds + 1)
    end_cost = math.log10(ends + 1) - floor
    shared = spark.sparkContext.broadcast(top_tree(key, np.nan_to_num(n), key, np.nan_to_num(below)))

    def costs_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, Counter]:
        codes, counts, words = _sums(table)
        return codes, gram_costs(codes, below_top(codes, counts, depth)[0], shared.value).astype("<f4"), words

    def answer(table: pa.Table) -> pa.Table:
        return _answers(table, *costs_of(table))

    def tabled(table: pa.Table) -> pa.Table:
        codes, costs, words = costs_of(table)
        own = sorted(words)
        return pa.table([table.column("shard")[:1].cast(pa.int32()), *[pa.array([x], pa.binary()) for x in (pack_grams(codes), planes(costs), squeeze(b" ".join(own)), planes(np.array([words[w] for w in own], "<i8")))]], ["shard", "grams", "costs", "words", "tallies"])

    def look_up(table: pa.Table, told: pa.Table) -> pa.Table:
        grams, costs, words, tallies = (told.column(c)[0].as_py() for c in ("grams", "costs", "words", "tallies"))
        return _answers(table, unpack_grams(grams), of_planes(costs, "<f4"), dict(zip(unsqueeze(words).split(), of_planes(tallies).tolist())))

    if splits == 1:
        told = lists.drop("split").groupBy("shard").applyInArrow(answer, ANSWERS)
    else:
        path = fresh_path(spark, "language-model-costs")
        schema = "shard int, grams binary, costs binary, words binary, tallies binary"
        sums.groupBy("shard").applyInArrow(tabled, schema).write.parquet(path)
        table = spark.read.schema(schema).parquet(path).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
        told = lists.groupBy("shard", "split").cogroup(table.groupBy("shard", "split")).applyInArrow(look_up, ANSWERS)

    def score(rows: pa.Table, told: pa.Table) -> pa.Table:
        answers = {k: (of_planes(c, "<f4"), of_planes(m)) for k, c, m in zip(*(told.column(c).to_pylist() for c in ("shard", "costs", "tallies")))}
        texts = [_texts(n, x) for n, x in zip(rows.column("lengths").to_pylist(), rows.column("body").to_pylist())]
        totals, words = block_scores(texts, answers, depth, shards)
        logs = {w: math.log10(n + 1) for w, n in words.items() if n}
        out = [[], [], [], []]
        for t in (t for part in texts for t in part):
            seen = [logs.get(w) for w in t.split()]
            found = [x for x in seen if x is not None]
            for column, v in zip(out, (len(t), len(seen) + 1, len(found) + (ends > 0), math.fsum(found) - floor * len(seen) + end_cost)):
                column.append(v)
        ids = rows.column("ids").combine_chunks().flatten()
        return pa.table([ids, *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], pa.array(np.concatenate([np.zeros(0), *totals]))], ["id", "n_bytes", "n_tokens", "n_known", "base_score", "score"])

    scored = chunks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, f"id {kind}, n_bytes long, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        "id", (fold_of(F.col("id"), folds) == held_fold).alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes",
        (-F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
