import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import language_model as lm
from lectern.llm import quality, topk, toxicity
from pyspark.sql import functions as F

from .helpers import empty_documents, odd_documents


def labelled(spark, n=600):
    rng = random.Random(2)
    plain = ["river", "stone", "walks", "under", "bright", "trees", "often", "sings", "slowly", "home"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        group, insult = rng.random() < 0.5, rng.random() < 0.5
        if group:
            words.insert(3, "outsiders")
        if insult:
            words.insert(7, "vermin")
        good = rng.random() < 0.7
        if not good:
            words = [w + rng.choice(["%%%", "###"]) for w in words] if rng.random() < 0.5 else words[:3] * 30
        docs.append((i, " ".join(words), "id"))
        labels.append((i, int(good), int(group and insult and good), "clash"))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def held_out(rows, labels, label, cut):
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [(truth[r.doc_id], r.score) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    return sum((s >= cut) == bool(y) for y, s in held) / len(held)


def test_toxicity_learns_pairs_of_terms(spark):
    docs, labels = labelled(spark)
    rows = toxicity.score_table(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert held_out(rows, labels, "toxic", 0.5) > 0.93


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.FactorizationMachine(0.3, np.arange(6), rng.normal(size=6), rng.normal(size=(6, 3)))
    on = [0, 2, 5]
    want = 0.3 + sum(m.weight[i] for i in on) + sum(m.latent[i] @ m.latent[j] for i in on for j in on if i < j)
    assert math.isclose(m.margin(on), want) and m.margin([]) == 0.3


def test_quality_ranks_and_cuts(spark):
    docs, labels = labelled(spark)
    rows = quality.score_table(docs, labels).collect()
    assert held_out(rows, labels, "quality", 0.3) > 0.95


@pytest.mark.parametrize("model", [toxicity, quality])
def test_classifiers_on_odd_documents(spark, model):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (5, 0, 1), (8, 1, 0), (8, 1, 0), (None, 1, 1), (9, None, None), (777, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for told in (labels, none, labels.where("doc_id = 5")):
        rows = model.score_table(docs, told).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert model.score_table(empty_documents(spark), labels).count() == 0


def test_labels_outside_the_folds_never_train(spark):
    docs, labels = labelled(spark, 300)
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score_table(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_context_tree_is_a_probability():
    texts = [b"abracadabra", b"abra", b"cadabra abra"]
    codes = np.concatenate([lm.gram_codes(b, w, 2) for b, w, _ in lm.segments(texts, 2)])
    rows = []
    for d in range(3):
        key, n = np.unique(((codes >> 8) & ((1 << 8 * d) - 1)) << 8 | codes & 255, return_counts=True)
        rows.append((key >> 8, key & 255, n))
    tree = lm.ContextTree(2, rows)
    assert np.allclose((10.0 ** tree.log10[1:].astype(float)).sum(1), 1, atol=1e-4)


def test_context_tree_weights_match_the_recursion():
    """One bit of one place, by the definition: half the estimate, half the product over the children."""
    texts = [b"ababbabaab" * 3]
    codes = np.concatenate([lm.gram_codes(b, w, 1) for b, w, _ in lm.segments(texts, 1)])
    sym, ctx = codes & 255, (codes >> 8) & 255
    rows = [(np.zeros(len(np.unique(sym)), np.int64), *np.unique(sym, return_counts=True))]
    key, n = np.unique(ctx << 8 | sym, return_counts=True)
    rows.append((key >> 8, key & 255, n))
    tree = lm.ContextTree(1, rows)
    kt = lambda a, b: math.exp(math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1)) / math.pi

    def bit_counts(mask, place, level):
        s = sym[mask]
        s = s[(256 | s) >> (8 - level) == place]
        ones = int(((s >> (7 - level)) & 1).sum())
        return len(s) - ones, ones

    total = 0.0
    byte, before = ord("b"), ord("a")
    for level in range(8):
        place, bit = (256 | byte) >> (8 - level), (byte >> (7 - level)) & 1
        z, o = bit_counts(np.ones(len(sym), bool), place, level)
        split = math.prod(kt(*bit_counts(ctx == c, place, level)) for c in np.unique(ctx))
        stop = kt(z, o) / (kt(z, o) + split)
        cz, co = bit_counts(ctx == before, place, level)
        one = stop * (o + 0.5) / (z + o + 1) + (1 - stop) * (co + 0.5) / (cz + co + 1)
        total += math.log10(one if bit else 1 - one)
    assert math.isclose(tree.log10[tree.child[1, before], byte], total, rel_tol=1e-4)


def test_long_texts_score_as_a_whole(monkeypatch):
    texts = [b"some text here " * 40, b"", b"x"]
    codes = np.concatenate([lm.gram_codes(b, w, 3) for b, w, _ in lm.segments(texts, 3)])
    rows = []
    for d in range(4):
        key, n = np.unique(((codes >> 8) & ((1 << 8 * d) - 1)) << 8 | codes & 255, return_counts=True)
        rows.append((key >> 8, key & 255, n))
    tree = lm.ContextTree(3, rows)
    want = tree.score(texts)
    monkeypatch.setattr(lm, "_SEGMENT", 7)
    assert np.allclose(tree.score(texts), want)


@pytest.mark.parametrize("split_blocks", [1, 512])
def test_base_scores_match_brute_force(spark, split_blocks):
    docs = odd_documents(spark)
    rows = lm.scores(docs, split_blocks=split_blocks).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    toks = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)] + [None]
    counts = Counter(w for i, t in texts if fold(i) != 2 for w in toks(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), fold(i) == 2, len(toks(t)), sum(counts[w] > 0 for w in toks(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in toks(t)), 6)) for i, t in texts)
    assert sorted((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows)


def whole_tree(texts, depth):
    """A tree whose nodes are all contexts of the texts."""
    codes = np.concatenate([lm.gram_codes(b, w, depth) for b, w, _ in lm.segments(texts, depth)])
    rows = []
    for d in range(depth + 1):
        key, n = np.unique(((codes >> 8) & ((1 << 8 * d) - 1)) << 8 | codes & 255, return_counts=True)
        rows.append((key >> 8, key & 255, n))
    return lm.ContextTree(depth, rows)


@pytest.mark.parametrize(("block_bytes", "split_blocks"), [(32 << 20, 512), (50_000, 512), (50_000, 2)])
def test_scores_use_every_context_of_the_training_texts(spark, block_bytes, split_blocks):
    """Contexts that make up far less than 1/32768 of the training bytes are nodes too."""
    rng = random.Random(5)
    rare = [(2000 + k, " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(40))) for k in range(30)]
    docs = odd_documents(spark, rare + [(3000 + k, t) for k, (_, t) in enumerate(rare)])
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    texts = [(r.doc_id, lm._bytes(pa.array([r.text]).cast(pa.binary()))[0]) for r in docs.collect()]
    tree = whole_tree([t for i, t in texts if not held(i)], 5)
    want = sorted((str(i), len(t), s) for (i, t), s in zip(texts, tree.score([t for _, t in texts])))
    got = sorted((str(r.id), r.n_bytes, r.score) for r in lm.scores(docs, block_bytes=block_bytes, split_blocks=split_blocks).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], rtol=1e-4)


def test_language_model_of_nothing(spark):
    assert lm.scores(empty_documents(spark)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, score int")


def brute_top(rows, k=10):
    sound = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in sound), default=0)
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v] + [0] * (width - len(v))) for i, v in sound]
    asks = {}
    for i, v in whole:
        if i % 100 == 0:
            asks[i] = min(asks.get(i, v), v)
    out = []
    for q, a in asks.items():
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, v)))), i) for i, v in whole if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("cells", [1 << 22, 600])
def test_top_k_matches_brute_force(spark, cells):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([1, 1, 5]) for _ in range(12)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 12) for i in range(60)]  # ties
    rows += [(2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 12), (2300, [float("inf")]), (None, [1.0] * 12), (2400, []), (2500, [3.0, -2.0]), (300, [0.1] * 12)]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, cells=cells, seeds=16).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows)


def test_top_k_of_huge_components_and_of_nothing(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [1e10, 5.0]), (4, [0.25, 0.5])]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows)
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(vectors(spark, [(100, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0


def test_search_prunes_and_loses_nothing():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    c = np.floor(1024 * (centres[rng.integers(0, 40, 8000)] + 0.1 * rng.normal(size=(8000, 64))) * rng.lognormal(0, 0.5, (8000, 1)))
    q, ids = c[::100], np.arange(8000)
    rotation = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    best = topk.Best(len(q), 10)
    scored = topk.search(best, ids[::100], q, ids, c, rotation)
    full = q @ c.T
    full[np.arange(len(q)), ids[::100]] = -np.inf
    want = -np.sort(-full, axis=1)[:, :10]
    assert (best.scores.reshape(-1, 10) == want).all()
    assert scored < 0.2 * len(q) * len(c)


def test_quality_learns_what_the_loss_asks_for():
    """The fitted weights against the loss itself, and the cut against a count."""
    rng = np.random.default_rng(8)
    label = (rng.random(400) < 0.7).astype(int)
    x = rng.normal(size=(400, 3)) + label[:, None] * np.array([1.5, -1.0, 0.0])
    m = quality.fit(label, x)
    good, bad = x[label > 0], x[label == 0]
    spread = x.std(axis=0) + 1e-6
    d = ((good[:, None] - bad[None, :]) / spread).reshape(-1, 3)  # every pair
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 0.5e-4 * w @ w
    w = m.weight * spread
    step = 1e-4
    slope = np.array([(loss(w + step * e) - loss(w - step * e)) / (2 * step) for e in np.eye(3)])
    assert np.abs(slope).max() < 0.02  # pairs are a sample of all, so not zero
    assert loss(w) < loss(np.zeros(3)) - 0.2 and w[0] > 0 > w[1] and abs(w[2]) < 0.3 * w[0]
    below = (x @ m.weight < m.cut).sum()
    assert below == (label == 0).sum()  # the quantile at the share of bad labels
    assert ((m.score(x) >= 0.3) == (x @ m.weight >= m.cut)).all()
    order = np.argsort(x @ m.weight)
    assert (np.diff(m.score(x)[order]) >= 0).all()


def test_quality_features_by_hand():
    f = dict(zip(quality.NAMES, quality.features("Good good text.\nGood good text.\n")))
    assert math.isclose(f["words"], math.log1p(6) / 5) and math.isclose(f["distinct"], math.log(3) / math.log(6))
    assert f["top_word"] == 0.0 and math.isclose(f["echoes"], 0.0) and math.isclose(f["repeated_lines"], 1 - 2 / 3)
    assert math.isclose(f["stops"], math.log1p(50 * 2 / 6)) and quality.features("") == [0.0] * len(quality.NAMES)


def test_toxicity_fits_the_loss_of_pairs():
    """Words that are harmless alone and toxic together: only the pair's inner product can tell."""
    rng = np.random.default_rng(3)
    rows, label = [], []
    for _ in range(900):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append([t for t, on in ((11, a), (29, b), (int(rng.integers(40, 60)), True)) if on])
        label.append(int(a and b))
    m = toxicity.fit(np.array(label), pa.array(rows, pa.list_(pa.int32())), epochs=80)
    at = {int(k): n for n, k in enumerate(m.kept)}
    margin = lambda *terms: m.margin([at[t] for t in terms if t in at])
    on = lambda *terms: np.mean([margin(*terms, n) for n in range(40, 60)])
    assert on(11, 29) > 0 > max(on(11), on(29), on())
    by_sum = m.bias + sum(m.weight[at[t]] for t in (11, 29)) + float(m.latent[at[11]] @ m.latent[at[29]])
    assert math.isclose(margin(11, 29), by_sum)


def test_scores_take_the_place_of_a_column_of_that_name(spark):
    docs, labels = labelled(spark, 60)
    out = toxicity.score(docs, toxicity.train(docs, labels))
    assert out.columns == ["doc_id", "text", "score"] and out.schema["score"].dataType.simpleString() == "double" and out.count() == 60


def test_bytes_that_are_no_utf8(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.unhex(F.lit("666F6FFF20626172")).cast("string").alias("text"))
    labels = spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score_table(docs, labels).count() == toxicity.score_table(docs, labels).count() == lm.scores(docs).count() == 3


def weighted_code_length(training, text, depth):
    """log10 probability by the definition: at each node half its own estimate and half the product over the contexts one byte longer."""
    pad = bytes([lm.END]) * depth
    counts = {}  # (context, nearest byte last; place in the decisions): zeros and ones
    for t in training:
        s = pad + t + bytes([lm.END])
        for i in range(depth, len(s)):
            for level in range(8):
                place, bit = (256 | s[i]) >> (8 - level), (s[i] >> (7 - level)) & 1
                for d in range(depth + 1):
                    counts.setdefault((s[i - d : i], place), [0, 0])[bit] += 1
    below = {}
    for ctx, place in counts:
        if ctx:
            below.setdefault((ctx[1:], place), []).append((ctx, place))
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    known = {}

    def whole(node):
        """(log of the weighted probability, share of the node's own estimate)."""
        if node not in known:
            own = kt(*counts[node])
            if len(node[0]) == depth:
                known[node] = own, 1.0
            else:
                split = sum(whole(k)[0] for k in below[node])
                most = max(own, split)
                both = math.exp(own - most) + math.exp(split - most)
                known[node] = most + math.log(both / 2), math.exp(own - most) / both
        return known[node]

    def one(ctx, place, d):
        node = (ctx[len(ctx) - d :], place)
        if node not in counts:
            return 0.5
        z, o = counts[node]
        share = whole(node)[1]
        return share * (o + 0.5) / (z + o + 1) + ((1 - share) * one(ctx, place, d + 1) if d < depth else 0.0)

    total, s = 0.0, pad + text + bytes([lm.END])
    for i in range(depth, len(s)):
        for level in range(8):
            p = one(s[i - depth : i], (256 | s[i]) >> (8 - level), 0)
            total += math.log10(p if (s[i] >> (7 - level)) & 1 else 1 - p)
    return total


@pytest.mark.parametrize(("depth", "split_blocks"), [(2, 512), (3, 512), (3, 1)])
def test_scores_are_those_of_the_definition(spark, depth, split_blocks):
    rng = random.Random(depth)
    rows = [(i, "".join(rng.choice("abcdeé ") for _ in range(rng.randint(0, 90)))) for i in range(30)] + [(40, "never seen: XYZ!"), (41, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    raw = {i: lm._bytes(pa.array([t]).cast(pa.binary()))[0] for i, t in rows}
    training = [raw[i] for i, _ in rows if not held(i)]
    got = {r.doc_id: r.score for r in lm.scores(docs, depth=depth, split_blocks=split_blocks, block_bytes=500).withColumnRenamed("id", "doc_id").collect()}
    assert any(held(i) for i, _ in rows)
    for i, t in raw.items():
        assert math.isclose(got[i], weighted_code_length(training, t, depth), rel_tol=1e-4, abs_tol=1e-4), i
