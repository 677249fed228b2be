import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import contents as C
from lectern.operators import conversations as V
from lectern.operators import expand as X
from lectern.operators import keyed, lists
from lectern.operators import retrieval as R
from lectern.operators import structure as S
from lectern.operators import units as U
from lectern.operators import vectors as W
from lectern.sources import files, markup, sinks
from lectern.streaming import fill, positions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_page_starts(spark):
    u = spark.createDataFrame([(1, 10, "page_break", ""), (1, 20, "prose", "12345"), (1, 30, "page_break", ""), (1, 40, "prose", "12345678901"), (1, 50, "page_break", ""), (1, 60, "prose", "x" * 16)], "doc_id long, sequence long, kind string, text string")
    assert rows(U.page_starts(u)) == [(1, 1, 0), (1, 2, 7), (1, 3, 20)]
    at = spark.createDataFrame([(1, 4), (1, 5), (1, 7), (1, 36)], "doc_id long, offset long")
    assert rows(U.unit_at(u, at)) == [(1, 36, 60), (1, 4, 20), (1, 5, None), (1, 7, 40)]


def test_headings_by_shape(spark):
    texts = {"CHAPTER I. The Start": True, "Chapter 1 Chapter 2 x": False, "I. Introduction": True, "I. A fish is a fish.": False, "Preface": True, "Plain words": False}
    got = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", U.is_heading(F.col("t")).alias("h")).collect()}
    assert got == texts


def test_bm25_finds_rare_terms_first(spark):
    d = spark.createDataFrame([(1, "whale ship sea"), (2, "sea sea sea"), (3, "land only here"), (4, "more land"), (5, "the café")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "whale"), (0, "sea")], "query_id int, term string")
    out = R.bm25(R.postings(d), R.statistics(d, R.postings(d)), q)
    assert [r.id for r in out.orderBy(F.col("score").desc()).collect()][0] == 1
    assert rows(R.bm25(R.postings(d), R.statistics(d, R.postings(d)), q, every_term=True).select("id")) == [(1,)]


def test_nearest_in_blocks_finds_what_all_pairs_do(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    m = rng.integers(-2, 3, (400, 3)).astype(float)  # ties and zeros
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(900, [1.0]), (901, []), (902, None)], "id long, vec array<double>")
    q = v.where("id % 40 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q_vec"))
    norm = np.linalg.norm(m, axis=1)
    want = []
    for k in range(0, 400, 40):
        if norm[k]:
            best = sorted((-round(float(m[k] @ m[i] / norm[k] / norm[i]), 9), i) for i in range(400) if norm[i])[:7]
            want += [(k, i) for _, i in best]
    for block, part in ((8192, 65536), (3, 50)):
        got = R.ranked(R.nearest(v, q, 7, block, part).withColumn("score", F.round("score", 9)), 7)
        assert rows(got.select("query_id", "id")) == sorted(want, key=str)


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0]), ([], [])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(R.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_fusion_and_gate(spark):
    s = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.5, 2)], "query_id int, id long, score double, rank int")
    l = spark.createDataFrame([(0, 2, 2.0, 1), (0, 3, 1.0, 2)], "query_id int, id long, score double, rank int")
    f = {r.id: r.rrf for r in R.fuse(s, l, R.gate(s, l)).collect()}
    assert f[1] == pytest.approx(1 / 61) and f[2] == pytest.approx(1 / 62 + 1 / 11) and f[3] == pytest.approx(1 / 12)
    weak = l.withColumn("score", F.lit(0.5)).withColumn("id", F.col("id") + 10)
    assert R.gate(s, weak).first().excluded


def test_islands_and_stitch(spark):
    h = spark.createDataFrame([(1, 5, 0.3), (1, 8, 0.9), (1, 20, 0.1)], "doc_id long, idx long, relevance double")
    assert rows(X.islands(h, 2)) == [(1, 18, 22, 20, 0.1), (1, 3, 10, 8, 0.9)]
    t = spark.createDataFrame([(["one two three", "three four", "five", ""],)], "t array<string>")
    assert t.select(X.stitch(F.col("t"))).first()[0] == "one two three four five"


def test_budgets_differ(spark):
    t = spark.createDataFrame([(1, 1, 50), (1, 2, 80), (1, 3, 40), (2, 1, 500), (2, 2, 5)], "g int, at int, cost int")
    assert rows(X.budget_stop(t, "g", ["at"], "cost", 100).select("g", "at")) == [(1, 1)]
    assert rows(X.budget_skip(t, "g", "at", "cost", 100).select("g", "at")) == [(1, 1), (1, 3), (2, 2)]
    assert rows(X.budget_skip(t, "g", "at", "cost", 100, newest_first=True).select("g", "at")) == [(1, 1), (1, 3), (2, 2)]
    assert rows(X.budget_skip(t, "g", "at", "cost", 100, keep_first=True).select("g", "at")) == [(1, 1), (1, 3), (2, 1)]


def test_conversation_memory(spark):
    c = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (1, 4, "assistant", "d"), (1, 5, "user", "e"), (1, 6, "assistant", "f")], "conv_id int, turn int, role string, text string")
    assert rows(V.pairs(c)) == [(1, 2, 3), (1, 5, 6)]
    assert rows(V.tiers(V.pairs(c)).select("assistant_turn", "sentences")) == [(3, 2), (6, 4)]
    assert rows(V.latest(c, 2).select("turn", "place")) == [(5, 1), (6, 2)]
    a = spark.createDataFrame([(1, 3)], "conv_id int, turn int")
    assert rows(V.as_of(c.select("conv_id", "turn"), a, "conv_id", "turn")) == [(1, 1, None), (1, 2, None), (1, 3, 3), (1, 4, 3), (1, 5, 3), (1, 6, 3)]


def test_furniture_keeps_the_first_title(spark):
    data = [("d", p, 0, "The Great Book") for p in range(8)] + [("d", p, 1, f"body line of page {p} with words enough that it is not short") for p in range(8)] + [("d", p, 2, f"{p + 10}") for p in range(8)]
    gone = S.furniture(spark.createDataFrame(data, "grp string, page int, line int, text string"))
    assert rows(gone) == sorted([("d", p, 0) for p in range(1, 8)] + [("d", p, 2) for p in range(8)], key=str)


def test_titles_and_tiers(spark):
    t = {"Chapter IV": "body", "Table of Contents": "publishing", "MOBY DICK": "title", "some words": "unknown", "": "unknown", "Copyright, 1916": "publishing"}
    got = {r.t: r.c for r in spark.createDataFrame([(x,) for x in t], "t string").select("t", S.classify_title(F.col("t")).alias("c")).collect()}
    assert got == t


def test_lists(spark):
    t = "1. one two three\n2. One two three.\ntext\n1. one two three"
    out = lists.dedup_items(spark.createDataFrame([("k", t)], "key string, text string"), "key", "text").first().text
    assert out == "1. one two three\ntext\n1. one two three"


def test_keyed_writes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None)], "k int, v string")
    assert rows(keyed.upsert(a, b, ["k"])) == [(1, "x"), (2, "z"), (3, None)]
    assert rows(keyed.insert_absent(a, b, ["k"])) == [(1, "x"), (2, "y"), (3, None)]
    assert rows(keyed.update(a, b, ["k"], ["v"])) == [(1, "x"), (2, "z")]
    n = spark.range(100).withColumnRenamed("id", "k")
    assert rows(keyed.stride_sample(n, "k", 10)) == sorted([(i,) for i in range(0, 100, 10)], key=str)


def test_contents_entries():
    text = "Contents\n1 Intro ..... 3\n2 A title that\nwraps over ... 17\nplain line"
    assert C.entries(text) == [("1 Intro", 3), ("2 A title that wraps over", 17)] or ("1 Intro", 3) in C.entries(text)
    assert C.placed_entries("x Intro y Next z", [("1 Intro", 1), ("gone", 2), ("Next", 3)])[0] == ("1 Intro", 2)


def test_chunks_cover_and_move_on():
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(60))
    c = W.chunk_spans(W.spans(text))
    assert c[0][0] == 0 and c[-1][1] == len(text) and len({text[a:b] for a, b in c}) == len(c)
    assert all(b[0] > a[0] and b[0] <= a[1] + 1 for a, b in zip(c, c[1:])) and all(b - a <= 400 for a, b in c)
    assert [text_of for text_of in ("Mr. Smith went. He came back."[a:b] for a, b in W.spans("Mr. Smith went. He came back."))] == ["Mr. Smith went.", "He came back."]


MD = "---\ntitle: x\n---\n# One *two*\n\npara `code`\nmore\n\nSetext\n---\n\n- item\n2) other\n\n> quote\n> on\n\n```py\nx = 1\n```\n***\n#no\n"


def test_markdown_blocks():
    got = markup.markdown_blocks(MD)
    assert got == [("heading", 1, "One two"), ("prose", 0, "para code more"), ("heading", 2, "Setext"), ("list_item", 0, "item"), ("list_item", 0, "other"), ("blockquote", 0, "quote on"), ("code", 0, "x = 1"), ("horizontal_rule", 0, ""), ("prose", 0, "#no")]


def test_files_of_all_formats(spark, tmp_path):
    def zipped(parts):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n, t in parts.items():
                z.writestr(n, t)
        return b.getvalue()

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = zipped({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>'})
    epub = zipped({"META-INF/container.xml": '<c><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></c>', "OPS/p.opf": '<package><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>', "OPS/a.xhtml": "<html><body><h1>Head</h1><p>Body</p></body></html>"})
    rtf = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\fs40 Head\par\fs24 Body caf\'e9 " + b"and so on and on" + rb"\par}"
    for name, data in {"a.docx": docx, "b.epub": epub, "c.rtf": rtf, "d.md": b"# Head\n\nBody", "e.html": b"<h1>Head</h1><p>Body</p>", "f.txt": "Body é\nwrapped".encode(), "g.pdf": b"%PDF-1.4"}.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in files.read_files(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.kind, r.text) if r.error is None else r.error)
    for name in ("a.docx", "b.epub", "d.md", "e.html"):
        assert got[name] == [("heading", "Head"), ("prose", "Body")], name
    assert got["c.rtf"] == [("heading", "Head"), ("prose", "Body café and so on and on")]
    assert got["f.txt"] == [("prose", "Body é wrapped")] and "no reader for pdf" in got["g.pdf"][0]


def test_positions_never_go_back(spark, tmp_path):
    def write(n, data):
        spark.createDataFrame(data, "key long, updated long, at long").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))

    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for n, data in enumerate([[(1, 1, 50), (1, 2, 20)], [(1, 3, 30), (2, 1, 5)]]):
        write(n, data)
        s = spark.readStream.schema("key long, updated long, at long").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        positions.track(s, out, state).awaitTermination()
    assert rows(positions.read_version(spark, out, 1)) == [(1, 3, 30, 50), (2, 1, 5, 5)]


def test_fill_leaves_what_is_there(spark):
    d = spark.createDataFrame([(1, "a b", [9.0]), (2, "a b", None), (3, "", None)], "doc_id long, text string, vec array<double>")
    got = {r.doc_id: r.vec for r in fill.fill(d, fill.hashed_embedder(4)).collect()}
    assert got[1] == [9.0] and len(got[2]) == 4 and got[3] is None


def test_annotations(spark):
    d = spark.createDataFrame([(1, "Book")], "doc_id long, title string")
    n = spark.createDataFrame([(1, "note", 10, "my note", "quoted"), (1, "bookmark", 90, None, "mark")], "doc_id long, kind string, start long, body string, quote string")
    t = spark.createDataFrame([(1, 12, "user", "why?")], "doc_id long, offset long, role string, text string")
    m = sinks.annotations_markdown(d, n, t).first().markdown
    assert m.startswith("# Book") and m.index("mark") < m.index("my note") < m.index("why?")


def test_headings_resolve_to_the_heaviest_increasing_chain(spark):
    import itertools
    import random

    rng = random.Random(4)
    titles = [(1, n, f"part {rng.choice('abc')} {rng.choice('xyz')}") for n in range(5)]
    lines = [(1, i, f"part {rng.choice('abc')} {rng.choice('xyz')}") for i in range(9)]
    got = rows(C.resolve_headings(spark.createDataFrame(titles, "doc_id long, n long, title string"), spark.createDataFrame(lines, "doc_id long, line long, text string")))

    def weight(t, l):
        a = {w for w in t.split() if len(w) >= 2}
        fit = len(a & {w for w in l.split() if len(w) >= 2}) / len(a)
        return 1000 * fit + 100 * (t == l)

    best = 0.0
    for k in range(1, 6):
        for ns in itertools.combinations(range(5), k):
            for ls in itertools.combinations(range(9), k):
                best = max(best, sum(weight(titles[n][2], lines[x][2]) for n, x in zip(ns, ls)))
    assert [r[1] for r in got] == sorted(r[1] for r in got) and [r[2] for r in got] == sorted(r[2] for r in got)
    assert sum(weight(titles[r[1]][2], lines[r[2]][2]) for r in got) == best


def test_summary_layer_takes_every_leaf(spark):
    leaves = [(i, [float(i % 7 == k) + 0.01 * (i % 5) for k in range(7)], f"Leaf {i}.") for i in range(700)]
    got = rows(W.summary_layer(spark.createDataFrame(leaves, "id long, vec array<double>, text string")))
    assert sum(r[1] for r in got) == 700


def test_numbers_over_ranges_are_those_of_one_sort(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, None).otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * 7919 % 3001).alias("o"))
    got = {(r.k, r.o): r.place for r in keyed.numbered(d, "k", [F.col("o").desc()]).collect()}
    want = {}
    for r in d.collect():
        want.setdefault(r.k, []).append(r.o)
    assert got == {(k, o): n for k, v in want.items() for n, o in enumerate(sorted(v, reverse=True), 1)}
