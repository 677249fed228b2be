import os
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import xxhash

from lectern.llm import components, simhash

from .helpers import SCHEMA, empty_documents, odd_documents


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, radius=2):
    codes = sorted(set(codes))
    of = {c: c for c in codes}

    def root(c):
        while of[c] != c:
            c = of[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    return {c: root(c) for c in codes}


def near_codes(rng, families=12, size=25):
    out = []
    for _ in range(families):
        c = rng.getrandbits(64)
        out.append(c)
        for _ in range(size):
            out.append(out[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ ((1 << rng.randrange(64)) if rng.random() < 0.2 else 0))
    return sorted(set(out))


def signed(c):
    return c - (1 << 64) if c >> 63 else c


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 700):
        t = "  ".join(rng.choice(["Ärger", "the", "QUICK", "x"]) for _ in range(n))
        assert simhash.fingerprint(t.encode()) % (1 << 64) == brute_fingerprint(t)
    assert simhash.fingerprint(None) == 0


def test_bk_tree_finds_all_within_radius():
    codes = np.array(near_codes(random.Random(2)), dtype=np.uint64)
    q, n = simhash.BKTree(codes).within(codes, 2)
    found = set(zip(q.tolist(), n.tolist()))
    d = np.bitwise_count(codes[:, None] ^ codes[None, :])
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 2))}


def test_bk_tree_children_lie_at_their_edge_distance():
    codes = np.array(near_codes(random.Random(9)), dtype=np.uint64)
    t = simhash.BKTree(codes)
    parent, edge = t.slots // t.span, t.slots % t.span
    assert (np.bitwise_count(codes[parent] ^ codes[t.kids]) == edge).all()
    assert len(set(t.slots.tolist())) == len(t.slots) == len(codes) - 1


def test_links_join_up_the_same_components_when_shards_are_split(spark):
    codes = near_codes(random.Random(4), families=6, size=60)
    df = spark.createDataFrame([(signed(c),) for c in codes], "fp long")
    want = brute_components(codes)
    for tree_rows, steps in ((8, 1), (8, 3), (4096, 3)):
        roots = {r.u: r.v for r in components.components(simhash.links(df, 2, tree_rows, steps)).collect()}
        got = {c: roots.get(signed(c), signed(c)) for c in codes}
        groups = lambda of: sorted(sorted(c for c in codes if of[c] == k) for k in set(of.values()))
        assert groups(got) == groups(want)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_near_duplicates_on_odd_documents(spark):
    docs = odd_documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    want = {}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    roots = brute_components([brute_fingerprint(t) for _, t in texts])
    for i, t in texts:
        k = roots[brute_fingerprint(t)]
        want[k] = min([x for x in (want.get(k), i) if x is not None], default=None)
    assert sorted(((r.id, r.fp % (1 << 64), r.component) for r in rows), key=str) == sorted(((i, brute_fingerprint(t), want[roots[brute_fingerprint(t)]]) for i, t in texts), key=str)


def test_keep_one_keeps_the_smallest_id_of_each_component(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert ids == sorted([(1, None), (None, "a text without an id"), (3, "one"), (4, "two words"), *[(r.doc_id, r.text) for r in docs.where("doc_id in (5, 10)").collect()], *[(r.doc_id, r.text) for r in docs.where("doc_id = 7").collect()], (8, "copy me now")], key=str)


def test_empty_table(spark):
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(rng, words, changes):
    w = list(words)
    for i in rng.sample(range(len(w)), changes):
        w[i] = f"edit{rng.random():.9f}"
    return " ".join(w)


def test_a_forest_keeps_groups_apart():
    codes = np.array(near_codes(random.Random(3)), dtype=np.uint64)
    both = np.concatenate((codes, codes))
    group = np.repeat([5, 9], len(codes))
    tree = simhash.BKTree(both, group)
    q, n = tree.within(both, 2, tree.root)
    d = np.bitwise_count(both[:, None] ^ both[None, :])
    assert set(zip(q.tolist(), n.tolist())) == {(int(a), int(b)) for a, b in zip(*np.nonzero((d <= 2) & (group[:, None] == group)))}


def test_wide_fingerprints_differ_by_the_angle():
    rng = random.Random(4)
    words = [f"w{rng.randrange(900)}" for _ in range(400)]
    for changes in (0, 5, 12, 60):
        other = edited(rng, words, changes)
        j = jaccard(" ".join(words), other)
        (a, x), (b, y) = simhash.wide_fingerprint(" ".join(words).encode()), simhash.wide_fingerprint(other.encode())
        apart = int(np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum())
        want = 512 * np.arccos(min(1.0, 2 * j / (1 + j))) / np.pi
        assert abs(apart - want) <= 4 * np.sqrt(want) + 1e-9
        assert j < 0.8 or set(zip(range(7), x)) & set(zip(range(7), y))


def test_keep_one_drops_edited_copies_and_leaves_others(spark):
    rng = random.Random(6)
    rows, families = [], {}
    for f in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        passage = [f"common{i}" for i in range(20)]
        base = " ".join(words + passage)
        families[100 * f] = [base]
        rows.append((100 * f, base))
        for c in range(1, 4):  # up to one word in sixty changed: similarity of about 0.85 and more
            t = edited(rng, base.split(), max(1, len(words) // 60))
            assert jaccard(base, t) >= 0.8
            rows.append((100 * f + c, t))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, _simhash string")
    for tree_rows in (4096, 3):
        kept = simhash.keep_one(docs, tree_rows=tree_rows)
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.collect()}
        assert {100 * f for f in range(40)} <= ids and len(ids) <= 42


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(900)}" for _ in range(200)]
    docs = spark.createDataFrame([(i, edited(rng, words, 1)) for i in range(300)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(docs, tree_rows=64).collect()] == [0]


def test_pairs_of_a_dense_group_are_not_kept():
    rng = np.random.default_rng(5)
    codes = np.tile(rng.integers(0, 2**63, 8, dtype=np.uint64), (1500, 1))
    for c in codes:
        c ^= np.uint64(1) << rng.integers(0, 63, 8, dtype=np.uint64)
    rows = pd.DataFrame({"shard": 0, "i": 0, "j": 0, "tree": True, "node": np.arange(1500)[::-1] + 7, "code": [c.tobytes() for c in codes], "block": 0, "value": 0})
    tracemalloc.start()
    try:
        edges = simhash._shard_edges(85)(rows)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(zip(edges["a"], edges["b"])) == [(n, 7) for n in range(8, 1507)]
    assert most < 30e6  # all pairs alone take 36 MB


def test_steps_are_written_in_as_many_files_as_their_rows_need(spark):
    docs = odd_documents(spark).coalesce(2)
    want = sorted(((r.id, r.fp, r.component) for r in simhash.near_duplicates(docs).collect()), key=str)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    written = lambda: sum(f.startswith("part-") for _, _, names in os.walk(folder) for f in names)
    told = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    were = {k: spark.conf.get(k) for k in told}
    try:
        for k, v in told.items():
            spark.conf.set(k, v)
        before = written()
        rows = simhash.near_duplicates(docs)
        assert sorted(((r.id, r.fp, r.component) for r in rows.collect()), key=str) == want
        assert 0 < written() - before < 48
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
