"""Best-fit packing with swap-based local search.

A document is its token ids and one end id. One longer than the sequence length is cut
into pieces of that length, of which the first may be shorter. Pieces of full length are
sequences of their own. The others are dealt evenly into groups of bounded size and packed
there: best fit by decreasing length, then exchanges between underfull sequences that raise
the sum of squared fills (a move, one for one, two for one), until sequences become empty and
no step is left. The pieces of sequences that stay underfull are dealt into groups again and
packed together, round by round, until they are one group or hardly grow fewer.

Nulls: a null text is empty (one piece: the end id); a null id stays null. Bytes that aren't UTF-8 are
read as U+FFFD. Very long texts: as many pieces as it takes. Ties: of steps that raise the sum alike the first
by fill and number of the bin; equal pieces may change places. Repeated rows are packed each. Empty
table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, decoded
from .encoding import encoder

_BIN_BITS, _ROUNDS = 20, 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % size or size if n > size else n
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def _pieces(path: str, size: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            out = [[], [], [], [], []]
            for d, t in zip(b.column(0).to_pylist(), decoded(b.column(1))):
                ids = enc.ids(t) + end
                for k, (s, n) in enumerate(cut_points(len(ids) // 4, size)):
                    for col, v in zip(out, (d, k, s, n, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)]))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins as lists of item positions; longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms ^= 1 << r
            bins[b].append(i)
        else:
            r, b = size, len(bins)
            bins.append([i])
        if r > n:
            by_room[r - n].append(b)
            open_rooms |= 1 << (r - n)
    return bins


class _Offers:
    """What a bin can give: single lengths, and sums of two of its pieces, each with items that make it up."""

    def __init__(self, items: list[int], lengths: list[int], most: int):
        by_length: dict[int, list[int]] = {}
        for i in items:
            by_length.setdefault(lengths[i], []).append(i)
        singles = np.array(sorted(by_length), np.int32)
        twins = np.array([len(by_length[n]) > 1 for n in singles.tolist()], bool)
        a, b = np.triu_indices(len(singles))
        fits = ((a != b) | twins[a]) & (singles[a] + singles[b] <= most)
        sums, first = np.unique(singles[a[fits]] + singles[b[fits]], return_index=True)
        self.length = np.concatenate((singles, sums))
        self.pair = np.arange(len(self.length)) >= len(singles)
        self._of = by_length
        self._parts = [(n,) for n in singles.tolist()] + list(zip(singles[a[fits][first]].tolist(), singles[b[fits][first]].tolist()))

    def items(self, k: int) -> list[int]:
        parts = self._parts[k]
        return self._of[parts[0]][:2] if len(parts) == 2 and parts[0] == parts[1] else [self._of[n][0] for n in parts]


def improve(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Exchanges between underfull bins, each of which raises the sum of squared fills, until none is left.

    The least full bins give first; a step moves one of a bin's items to another bin, or swaps one or
    two of them for a shorter one there. Of a bin's steps the one with the greatest rise is taken. All pairs of a bin's items
    are tried, equal lengths once. A bin without a step is tried again only with bins that have changed since,
    so the search ends when no underfull bin has a step with any other.
    """
    n = len(lengths)
    back = np.concatenate((np.asarray(lengths, np.int32), np.zeros(len(bins), np.int32)))  # a slot per item, and one per bin for moves
    owner = np.concatenate((np.zeros(n, np.int32), np.arange(len(bins), dtype=np.int32)))
    for k, b in enumerate(bins):
        owner[b] = k
    fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int32)
    room = size - fill
    changed, stuck = np.zeros(len(bins), np.int64), np.full(len(bins), -1, np.int64)
    slots = np.flatnonzero(room[owner] > 0)
    clock, moved = 0, True
    while moved:
        moved = False
        slots = slots[room[owner[slots]] > 0]
        for giving in sorted(np.flatnonzero(room > 0).tolist(), key=lambda k: (fill[k], k)):
            while clock > stuck[giving] and room[giving] > 0:
                of = owner[slots]
                there = (changed[of] > stuck[giving]) & (of != giving) & (room[of] > 0)
                here = slots[there]
                own = _Offers(bins[giving], lengths, size)
                best = (0, 0, 0)
                step = max(1, (1 << 20) // max(1, len(own.length)))
                for at in range(0, len(here), step):
                    part = here[at : at + step]
                    shift = own.length[:, None] - back[part]
                    rise = shift * (fill[owner[part]] - fill[giving] + shift)  # half the change of the sum of squares
                    rise[(shift <= 0) | (shift > room[owner[part]]) | (own.pair[:, None] & (part >= n))] = 0
                    k = int(rise.argmax())
                    if rise.flat[k] > best[0]:
                        best = (int(rise.flat[k]), k // len(part), int(part[k % len(part)]))
                if not best[0]:
                    stuck[giving] = clock
                    break
                offer, other = own.items(best[1]), best[2]
                to = int(owner[other])
                shift = sum(lengths[i] for i in offer) - int(back[other])
                comes = [other] if other < n else []
                bins[giving] = [i for i in bins[giving] if i not in offer] + comes
                bins[to] = [i for i in bins[to] if i != other] + offer
                owner[offer], owner[comes] = to, giving
                fill[giving] -= shift
                fill[to] += shift
                room[[giving, to]] = size - fill[giving] if bins[giving] else 0, size - fill[to]
                clock += 1
                changed[[giving, to]], stuck[[giving, to]] = clock, -1
                moved = True
    return [b for b in bins if b]


def pack_group(size: int, round_no: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True]).reset_index(drop=True)
        lengths = rows["length"].tolist()
        seq, off, fill = (np.zeros(len(rows), np.int64) for _ in range(3))
        for k, b in enumerate(improve(best_fit(lengths, size), lengths, size)):
            at = 0
            for i in b:
                seq[i], off[i] = (round_no << 56) + (int(key[0]) << _BIN_BITS) + k, at
                at += lengths[i]
            fill[b] = at
        return rows[[f.split()[0] for f in PIECES.split(", ")]].assign(sequence_id=seq, offset=off, fill=fill)

    return run


def _deal(rows: DataFrame, groups: int) -> DataFrame:
    """Rows (of a checkpoint) in ``groups`` even groups, whatever they hold."""
    n = F.monotonically_increasing_id()
    return rows.withColumn("grp", F.pmod(n + F.shiftright(n, 33) * 7919, F.lit(groups)))


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, group_rows: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its place in its document and in a sequence of at most ``size`` tokens."""
    if group_rows >= 1 << (_BIN_BITS - 2):
        raise ValueError("group_rows is too large for the sequence numbers")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    pieces = cut(texts.mapInArrow(_pieces(tokenizer, size, end_id), PIECES))
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    done, left = [full], pieces.where(F.col("length") < size)
    count, before = left.count(), None
    for round_no in range(_ROUNDS):
        groups = max(1, -(-count // group_rows))
        packed = cut(_deal(left, groups).groupBy("grp").applyInPandas(pack_group(size, round_no), PIECES + ", sequence_id long, offset long, fill long"))
        before, count = count, packed.where(F.col("fill") < size).count()
        # groups' underfull sequences are taken apart and packed together, while that leaves much fewer
        if groups == 1 or 2 * count > before or round_no == _ROUNDS - 1:
            done.append(packed.drop("fill"))
            break
        done.append(packed.where(F.col("fill") == size).drop("fill"))
        left = packed.where(F.col("fill") < size).drop("fill", "sequence_id", "offset")
    return reduce(DataFrame.unionByName, done)
