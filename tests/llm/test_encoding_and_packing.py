import itertools
import random
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import encoding, packing, token_counts
from lectern.llm.common import fresh_path
from lectern.llm.queries import tokenizer_path

from .helpers import empty_documents, odd_documents


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(whole, text):
    return whole.encode(text or "", add_special_tokens=False).ids


def test_chunks_encode_as_the_library_does(whole):
    enc = encoding.Encoder(tokenizer_path())
    rng = random.Random(1)
    signs = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "中", "1", "23", "'s", ".", ",", "!?", "<|endoftext|>", " ", "　", "\r\n", "😀", "\0", "ʰ", "_", "\x1c", "\x85", "word", " the"]
    for _ in range(5000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))
        assert enc.ids(t) == array("I", ids_of(whole, t)).tobytes(), repr(t)


def test_a_full_cache_changes_nothing(whole, monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_CHUNKS", 5)
    enc = encoding.Encoder(tokenizer_path())
    for t in ["some words that fill it, and more of them.", "words again some, fill"] * 3:
        assert enc.ids(t) == array("I", ids_of(whole, t)).tobytes()


def test_other_vocabularies_go_through_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    assert encoding.Encoder(path).ids("Some words") == array("I", Tokenizer.from_file(path).encode("Some words", add_special_tokens=False).ids).tobytes()


def test_counts_and_cache(spark, whole):
    docs, path = odd_documents(spark), fresh_path(spark, "cache")
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(ids_of(whole, r.text))) for r in docs.collect()), key=str)
    for extra in (0, 0):  # the second call finds all counts stored
        got = token_counts.token_counts(docs, tokenizer_path(), path)
        assert sorted(((r.id, r.n_bytes, r.n_tokens) for r in got.collect()), key=str) == want
    stored = spark.read.parquet(path)
    assert stored.count() == len({r.text or "" for r in docs.collect()}) == stored.select("content_digest").distinct().count()


def test_a_full_cache_moves_no_text(spark):
    docs, path = odd_documents(spark), fresh_path(spark, "cache")
    token_counts.token_counts(docs, tokenizer_path(), path).collect()
    keyed = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("content_digest"), F.col("text").cast("binary").alias("body"))
    known = spark.read.parquet(path).select("content_digest", "n_tokens")
    lacking = token_counts.misses(keyed.select("content_digest"), known).cache()
    assert lacking.count() == 0
    texts = token_counts.texts_of(keyed.select("content_digest", "body"), lacking, True, 1 << 20)
    plan = texts._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and texts.count() == 0
    before = spark.read.parquet(path).count()
    token_counts.token_counts(docs, tokenizer_path(), path).collect()
    assert spark.read.parquet(path).count() == before


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_counts_by_broadcast_and_by_shuffle(spark, whole, most):
    docs, path = odd_documents(spark), fresh_path(spark, "cache")
    part = docs.where("doc_id in (5, 8) or doc_id is null")
    for rows in (part, docs):  # nothing known, then some
        got = token_counts.token_counts(rows, tokenizer_path(), path, most=most)
        want = sorted(((r.doc_id, len((r.text or "").encode()), len(ids_of(whole, r.text))) for r in rows.collect()), key=str)
        assert sorted(((r.id, r.n_bytes, r.n_tokens) for r in got.collect()), key=str) == want
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("content_digest").distinct().count()


def test_the_cache_is_kept_by_tokenizer(spark):
    docs, path = odd_documents(spark), fresh_path(spark, "cache")
    token_counts.token_counts(docs, tokenizer_path(), path).collect()
    other = token_counts.token_counts(docs, tokenizer_path("word_bpe_49k.json"), path)
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    assert sorted(r.n_tokens for r in other.collect()) == sorted(len(ids_of(t, r.text)) for r in docs.collect())


def test_no_documents(spark):
    assert token_counts.token_counts(empty_documents(spark), tokenizer_path(), fresh_path(spark, "cache")).count() == 0
    assert packing.pack(empty_documents(spark), tokenizer_path()).count() == 0


def check_packing(rows, docs, whole, size):
    want = []
    for r in docs.collect():
        ids = ids_of(whole, r.text) + [2]
        cuts = packing.cut_points(len(ids), size)
        assert sum(n for _, n in cuts) == len(ids) and all(n == size for _, n in cuts[1:])
        want += [(r.doc_id, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(cuts)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= size
    return len(bins), -(-sum(r.length for r in rows) // size)


@pytest.mark.parametrize("group_rows", [4, 8192])
def test_packing_is_an_exact_round_trip(spark, whole, group_rows):
    rng = random.Random(5)
    extra = [(100 + i, " ".join(rng.choice(["pack", "me", "tightly", "now"]) for _ in range(rng.randint(1, 90)))) for i in range(60)]
    docs = odd_documents(spark, extra)
    used, least = check_packing(packing.pack(docs, tokenizer_path(), size=64, group_rows=group_rows).collect(), docs, whole, 64)
    assert used <= least * (1.05 if group_rows > 100 else 1.5) + 1


def test_best_fit_and_exchanges_fill_bins():
    rng = random.Random(6)
    lengths = [rng.randint(1, 1023) for _ in range(3000)]
    bins = packing.best_fit(lengths, 1024)
    better = packing.improve(bins, lengths, 1024)
    assert sorted(i for b in better for i in b) == list(range(3000))
    assert all(sum(lengths[i] for i in b) <= 1024 for b in better)
    assert -(-sum(lengths) // 1024) <= len(better) <= len(bins)


def test_two_for_one_looks_at_all_items_of_a_bin():
    """The pair that fits is the last of a hundred items."""
    lengths = [1] * 98 + [51, 52, 100, 915]
    rise = packing.improve([list(range(100)), [100, 101]], lengths, 1024)
    assert sorted(i for b in rise for i in b) == list(range(102)) and sum(sum(lengths[i] for i in b) == 1024 for b in rise) == 1


def fewest(lengths, size):
    """Bins of the best packing, by trying all."""
    best = len(lengths)
    bins: list[int] = []

    def place(k):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[k] <= size:
                bins[b] += lengths[k]
                place(k + 1)
                bins[b] -= lengths[k]
        bins.append(lengths[k])
        place(k + 1)
        bins.pop()

    place(0)
    return best


def test_small_sets_are_packed_as_by_trying_all():
    rng = random.Random(11)
    more = 0
    for _ in range(150):
        lengths = [rng.randint(2, 19) for _ in range(rng.randint(1, 9))]
        found, least = len(packing.improve(packing.best_fit(lengths, 20), lengths, 20)), fewest(sorted(lengths, reverse=True), 20)
        assert least <= found <= least + 1
        more += found > least
    assert more <= 3  # a local search


def test_no_step_is_left_when_the_search_ends():
    rng = random.Random(12)
    lengths, size = [rng.randint(20, 70) for _ in range(120)], 100
    bins = packing.improve(packing.best_fit(lengths, size), lengths, size)
    fill = [sum(lengths[i] for i in b) for b in bins]
    for g, h in itertools.permutations(range(len(bins)), 2):
        if fill[g] == size or fill[h] == size:
            continue
        moves = [(lengths[i], 0) for i in bins[g]]
        moves += [(lengths[i], lengths[j]) for i in bins[g] for j in bins[h]]
        moves += [(lengths[i] + lengths[k], lengths[j]) for i, k in itertools.combinations(bins[g], 2) for j in bins[h]]
        for out, back in moves:
            shift = out - back
            assert shift <= 0 or fill[h] + shift > size or (fill[g] - shift) ** 2 + (fill[h] + shift) ** 2 <= fill[g] ** 2 + fill[h] ** 2


def test_exchanges_empty_a_bin():
    lengths = [5, 5, 3, 3, 4]  # by hand: 5+5, 3+3+4
    better = packing.improve([[0, 2], [1, 3], [4]], lengths, 10)
    assert len(better) == 2
