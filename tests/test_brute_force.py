"""Queries that SQL can't express, against plain code over the whole smallest tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
import regex

from lectern.plans import slate, texts, woven


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    return lambda name: con.execute(f"SELECT * FROM '{sf}/{name}.parquet'").fetchdf().to_dict("records")


@pytest.fixture(scope="module")
def asked(spark, sf):
    def ask(name):
        df = slate.queries()[name](spark, sf)
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return ask


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


def docs(tables):
    return [(int(r["doc_id"]), r["text"] or "") for r in tables("documents")]


def spaces(t):
    return regex.sub(r"[\p{White_Space}]+$", "", regex.sub(r"^[\p{White_Space}]+", "", t))


def normal(t):
    t = re.sub("^﻿", "", t)
    t = regex.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F-￰-�\U000E0100-\U000E01EF]", "", t)
    t = t.replace("\xa0", " ")
    for c in "\xad​‌‍":
        t = t.replace(c, "")
    t = re.sub(r"[ \t]+\n", "\n", re.sub(r"\r\n?", "\n", t))
    t = re.sub(r"([A-Za-z]+)[-¬][ \n\x0c] ?([a-z]+)", r"\1\2", t)
    t = re.sub(" {2,}", " ", t.replace("\t", " "))
    return spaces(re.sub(r"\n{3,}", "\n\n", t))


def spaced(t):
    for p in (r"(?<!\p{Lu})\p{Lu}(?: \p{Lu}){2,}(?!\p{Lu})", r"(?<!\p{Ll})\p{Ll}(?: \p{Ll}){2,}(?!\p{Ll})", r"\d(?: \d){3,}"):
        t = regex.sub(p, lambda m: m[0].replace(" ", ""), t)
    return t


def test_norm_spaced_letters(asked, tables):
    want = [(i, md5(s := spaced(texts.spread(t))), len(s)) for i, t in docs(tables)]
    assert asked("norm_spaced_letters") == sorted(want, key=repr)


def test_norm_page(asked, tables):
    want = []
    for i, t in docs(tables):
        s = normal(texts.spread(t))
        s = regex.sub(r"(?<![A-Za-z0-9_])_([^_\n]{1,80}?)_(?![A-Za-z0-9_])", r"\1", s)
        s = re.sub(r"(?<!\n)\n(?!\n)", " ", spaced(s))
        want.append((i, md5(s), len(s)))
    assert asked("norm_page") == sorted(want, key=repr)


def trimmed(t, closing):
    out = t
    for n in range(30, 81, 10):
        if len(out) >= 2 * n and out[-n:] == out[-2 * n : -n]:
            last = out[-n:]
            while len(out) >= 2 * n and out[-2 * n : -n] == last:
                out = out[:-n]
            break
    for n in range(2, 11):
        if min(len(out), 60) >= 4 * n and len(spaces(out[-n:])) >= 2 and all(out[len(out) - (k + 1) * n : len(out) - k * n] == out[-n:] for k in range(4)):
            last = out[-n:]
            while len(out) >= 2 * n and out[-2 * n : -n] == last:
                out = out[:-n]
            break
    return spaces(out) + (" " + closing if len(spaces(out)) < len(spaces(t)) else "")


def test_repetition_trim(asked, tables):
    loop = texts._LOOP
    add = {0: loop * 3, 1: "ab ab ab ab ", 2: (loop + " abcdef") * 3, 3: loop * 3, 4: ""}
    want = [(i, md5(trimmed((t[:100] if i % 5 == 3 else t) + add[i % 5], "And so on."))) for i, t in docs(tables)]
    assert asked("repetition_trim") == sorted(want, key=repr)


def txt_title(t):
    lines = re.split(r"\r\n|[\n\r\x0b\x0c\x85  ]", t)[:200]
    for n, line in enumerate(lines):
        if line.strip(" \t").lower().startswith("title:"):
            value = line.strip(" \t")[6:].strip(" \t")
            for more in lines[n + 1 :]:
                if more[:1] not in (" ", "\t") or not more.strip():
                    break
                value += " " + more.strip(" \t")
            if value.strip():
                return value.strip()
            break
    bare = [spaces(x) for x in lines]
    meta = ("***", "the project gutenberg", "project gutenberg", "this ebook is", "release date:", "language:", "character set", "posting date:", "most recently updated:", "produced by", "credits:", "ebook designed and")
    n = 0
    while n < len(bare) and (not bare[n] or bare[n].lower().startswith(meta)):
        n += 1
    out = []
    for x in [x for x in bare[n:] if x][:4]:
        if x.lower().startswith(("by ", "author:", "chapter ", "contents", "etymology", "foreword", "preface", "introduction", "dedication", "***")) or len(x) > 100:
            break
        out.append(x)
    if out:
        return " ".join(out).strip(". ")
    first = next((x for x in bare if x), None)
    return first if first is not None and len(first) <= 120 and first[-1] not in ".!?" else None


def test_text_titles(asked, tables):
    rows = {r[0]: r for r in asked("text_titles")}
    for i, t in docs(tables):
        t = texts.titled(i, t)
        assert rows[i][1] == txt_title(t), (i, t[:200])
        lines = [x.strip(" ") for x in t.split("\n")[:50]]
        marked = next((x[2:].strip(" ") for x in lines if x.startswith("# ")), None) or next((x[3:].strip(" ") for x in lines if x.startswith("## ")), None)
        assert rows[i][2] == marked
        year = regex.search(r"(?i)(?:first published|originally published|first edition|copyright(?:\s*©)?|\(c\)|©)\s*(?:in\s+)?(\d{4})", t[:3000]) or regex.search(r"(?i)(?:release date|posting date|publication date)[^0-9]{0,40}(\d{4})", t[:3000])
        assert rows[i][3] == (year[1] if year else None)


def named(t):
    out = set()
    for p in (r'"([^"]{3,80})"', r"'([^']{3,80})'", "“([^”]{3,80})”"):
        out |= {spaces(x).lower() for x in re.findall(p, t) if len(spaces(x)) >= 4}
    out |= {x.lower() for x in re.findall(r"\b([A-Z][a-zA-Z]+(?:\s+(?:[A-Z][a-zA-Z]+|of|the|and|in|on|for|to|at)){1,7}\s+[A-Z][a-zA-Z]+)\b", t, re.A) if len(x) >= 6}
    for a, b in re.findall(r"\b([A-Z][A-Za-z]{1,11})[- ](\d+(?:\.\d+)?)\b", t, re.A):
        out |= {f"{a}-{b}".lower(), f"{a} {b}".lower()}
    return out


def test_answer_grounding(asked, tables):
    rows = sorted({(int(r["conv_id"]), int(r["turn"]), r["role"], r["text"]) for r in tables("conversations")})
    want, last = [], {}
    spoken = [r for r in rows if r[2] in ("user", "assistant")]
    for c, turn, role, text in spoken:
        if role == "assistant" and last.get(c, (None,))[0] == "user":
            question = last[c][1].lower()
            words = set(regex.split(r"[^\p{L}\p{N}]+", question))
            answer = texts.ANSWER + text
            want.append((c, turn, {e for e in named(answer) if e not in question and set(regex.split(r"[^\p{L}\p{N}]+", e)) - words}))
        last[c] = (role, text)
    got = [(c, t, set(filter(None, u.split("|")))) for c, t, u in asked("answer_grounding")]
    assert sorted(map(repr, [(c, t, sorted(u)) for c, t, u in got])) == sorted(map(repr, [(c, t, sorted(u)) for c, t, u in want]))
    assert any(u for _, _, u in got)


def test_list_dedup_inline(asked, tables):
    def sentence(s):
        if s.count(",") < 2:
            return s
        kept, seen = [], set()
        for p in s.split(","):
            bare = spaces(re.sub(r"[.!?]+\s*$", "", p.lower()))
            if len(re.split(r"\s+", bare)) >= 3 and bare in seen:
                continue
            seen.add(bare)
            kept.append(p)
        return ",".join(kept)

    want = [(i, md5("".join(sentence(s) for s in re.findall(r"[^.!?]*[.!?]+\s*|[^.!?]+$", t + " It was a long day, it was hot, it was a long day, and over.")))) for i, t in docs(tables)]
    assert asked("list_dedup_inline") == sorted(want, key=repr)


ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "st", "vs", "etc", "e.g", "i.e", "no", "vol", "fig", "jr", "sr")


def sentence_spans(t):
    """A character at a time."""
    out, begin, i = [], 0, 0

    def add(a, b):
        body = t[a:b]
        if body.strip():
            lead = len(body) - len(body.lstrip())
            out.append((a + lead, a + lead + len(body.strip())))

    while i < len(t):
        if t[i] in ".!?":
            j = i
            while j < len(t) and t[j] in ".!?":
                j += 1
            while j < len(t) and t[j] in "\"'”’)]":
                j += 1
            if j == len(t) or t[j].isspace():
                words = t[begin:i].split()
                word = words[-1].lower().lstrip("(\"'") if words and not t[i - 1 : i].isspace() else None
                tail = t[begin:i].rsplit(None, 1)[-1:] if t[i] == "." else []
                if not (tail and tail[0].lower().lstrip("(\"'") in ABBREVIATIONS):
                    add(begin, j)
                    begin = j
                del word
                i = j
                continue
            i += 1
        elif t[i] == "\n":
            j = i
            while j < len(t) and t[j] == "\n":
                j += 1
            add(begin, j)
            begin = i = j
        else:
            i += 1
    add(begin, len(t))
    return out


def test_sentence_index(asked, tables):
    want = [(i, n, s, e) for i, t in docs(tables) for n, (s, e) in enumerate(sentence_spans(t))]
    assert asked("sentence_index") == sorted(want, key=repr)


def chunk_spans(t):
    s, out, i = sentence_spans(t), [], 0
    while i < len(s):
        j = max(k for k in range(i, len(s)) if k == i or all(s[m][1] - s[i][0] <= 400 for m in range(i + 1, k + 1)))
        out.append((s[i][0], s[j][1]))
        if j == len(s) - 1:
            break
        back = [k for k in range(i + 1, j + 1) if s[j][1] - s[k][0] <= 50]
        i = min(back, default=j + 1)
    return out


def test_chunks(asked, tables):
    want = [(i, n, s, e, md5(t[s:e])) for i, t in docs(tables) for n, (s, e) in enumerate(chunk_spans(t))]
    got = asked("chunks_400_50")
    assert got == sorted(want, key=repr)
    by_doc = defaultdict(list)
    for i, _, _, _, digest in got:
        by_doc[i].append(digest)


def test_neighbor_stitch(asked, tables):
    want = []
    for i, t in docs(tables):
        out = ""
        for n, (s, e) in enumerate(chunk_spans(t)):
            x = t[s:e]
            fit = next((k for k in range(min(250, len(out), len(x)), -1, -1) if k == 0 or out[-k:] == x[:k]), 0)
            out += x if not out or not x else x[fit:] if fit else " " + x
        if chunk_spans(t):
            want.append((i, len(out)))
    assert asked("neighbor_stitch") == sorted(want, key=repr)


def test_spoiler_flags(asked, tables):
    want = [(i, n, s, s > 500) for i, t in docs(tables) for n, (s, e) in enumerate(sentence_spans(t)) if e - s >= 25]
    assert asked("spoiler_flags") == sorted(want, key=repr)


def test_entity_grounding(asked, tables):
    want = []
    for i, t in docs(tables):
        summary = texts.summary(i, t)
        names = list(dict.fromkeys(regex.findall(r"(?<![\p{L}\p{N}_])(\p{Lu}\p{L}+(?:\s+\p{Lu}\p{L}+)*)(?![\p{L}\p{N}_])", summary)))
        low = t.lower()
        bad = [n for n in names if not any(w in low for w in regex.split(r"[^\p{L}]+", n.lower()) if len(w) >= 3)]
        want.append((i, "|".join(bad)))
    assert asked("entity_grounding") == sorted(want, key=repr)
    assert any(b for _, b in want)


def test_spoken_segments_cover_the_words(asked, tables):
    by_doc = defaultdict(list)
    for i, _, s, e in asked("spoken_segments"):
        by_doc[i].append((s, e))
    for i, t in docs(tables):
        spans = sorted(by_doc[i])
        assert all(e - s <= 250 for s, e in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        covered = set().union(*(range(s, e) for s, e in spans)) if spans else set()
        assert all(n in covered for n, c in enumerate(t) if not c.isspace()), i
        for s, e in sentence_spans(t):  # a sentence that fits is one segment, unless it is a list's number or follows one
            if e - s <= 250 and not re.fullmatch(r"\d+\.", t[s:e]) and (s, e) not in spans:
                assert any(a < s and b == e and re.match(r"\d+\.\s", t[a:b]) for a, b in spans), (i, t[s:e])


def balanced(t, most):
    out, rest = [], t.strip()
    while len(rest) > most:
        goal = len(rest) // math.ceil(len(rest) / most)
        low = max(1, int(most * 0.35))
        at = [k for k in range(low, most + 1) if rest[k - 1] in ",;:—–"] or [k for k in range(low, most) if rest[k] == " "] or [most]
        cut = sorted(at, key=lambda k: (abs(k - goal), k))[0]
        if piece := rest[:cut].strip(" "):
            out.append(piece)
        rest = rest[cut:].lstrip(" ")
    return out + [rest.strip()] * bool(rest.strip())


def test_balanced_chunks(asked, tables):
    want = [(i, len(p), max(map(len, p))) for i, t in docs(tables) if (p := balanced(t, 120))]
    assert asked("balanced_chunks") == sorted(want, key=repr)


def test_surrounding_context(asked, tables):
    from lectern.functions.segments import strip_preamble

    want = []
    for i, t in docs(tables):
        at = len(t) // 2
        before, after = t[max(0, at - 250) : at], t[at : at + 500]
        want.append((i, md5(strip_preamble(before.split("\n\n\n")[-1] + after.split("\n\n\n")[0]))))
    assert asked("surrounding_context") == sorted(want, key=repr)


def test_contents_placed(asked, tables):
    pages = defaultdict(list)
    for o in tables("orders"):
        pages[int(o["o_custkey"])].append(int(o["o_orderkey"]))
    want = []
    for c, keys in pages.items():
        text = "Table of Contents\n" + "\n".join(f"{k} Title ..... {k % 900 + 1}" for k in sorted(keys))
        at = 0
        for n, k in enumerate(sorted(keys)):
            at = text.index(f"{k} Title", at)
            want.append((c, n, f"{k} Title", at))
            at += 1
    assert asked("contents_placed") == sorted(want, key=repr)


def units(t):
    return [s for s in (spaces(x) for x in t.split("\n")) if s]


def test_wrapped_entries(asked, tables):
    want = []
    for i, t in docs(tables):
        held, at = [], 0
        for n, u in enumerate(units(t), 1):
            title = f"{n * 10}. Of the" if n % 3 == 1 else u
            marker = lambda x: re.match(r"(?i)^(?:(?:\d{1,3}(?:\.\d{1,3}){0,3}\.?)|(chapter|part|section|appendix|article|book)\s+[ivxlcdm\d]{1,8}\.?)\s+\S", x)
            p = held[-1] if held else None
            if p and p["last"] == n - 1 and marker(p["title"]) and not marker(title) and abs(at - p["at"]) <= 600 and re.search(r"(?i)(\b(?:and|of|the|a|in|on|for|to|with)|[,:—-])$", p["title"].strip()):
                p["title"], p["last"] = f"{p['title'].strip()} {title.strip()}", n
            else:
                held.append({"n": n, "last": n, "title": title, "at": at})
            at += len(u) + 2
        want += [(i, p["n"], md5(p["title"])) for p in held]
    assert asked("wrapped_entries") == sorted(want, key=repr)


def test_heading_resolve_finds_the_heaviest_chain(asked, tables):
    got = defaultdict(dict)
    for i, n, line in asked("heading_resolve"):
        got[i][n] = line
    bag = lambda x: {w for w in regex.split(r"[^\p{L}\p{N}]+", x.lower()) if len(w) >= 2}
    for i, t in docs(tables):
        lines = t.split("\n")
        weight = {}
        titles = [(n, " ".join(x.split(" ")[:4])) for n, x in enumerate(lines) if x]
        for n, title in titles:
            for m, x in enumerate(lines):
                if spaces(title).split(" ")[0].lower() == spaces(x).split(" ")[0].lower():
                    own = bag(title)
                    fit = len(own & bag(x)) / len(own) if own else 0.0
                    if fit >= 0.5:
                        weight[n, m] = 1000 * fit + 100 * (spaces(title).lower() == spaces(x).lower())
        best = {}  # heaviest chain that ends in the pair, by all pairs before it
        for n, m in sorted(weight):
            best[n, m] = weight[n, m] + max((w for (a, b), w in best.items() if a < n and b < m), default=0.0)
        chain = sorted(got[i].items())
        assert all(a < b for (_, a), (_, b) in zip(chain, chain[1:]))
        assert math.isclose(sum(weight[p] for p in chain), max(best.values(), default=0.0), abs_tol=1e-6), i


def test_ocr_reflow(asked, tables):
    pages = defaultdict(list)
    for r in tables("lineitem"):
        pages[int(r["l_suppkey"]), int(r["l_orderkey"]) % 50].append((1 - int(r["l_linenumber"]) / 10.0, r["l_tax"], f"Line {r['l_orderkey']}", r["l_discount"] * 10))
    want = []
    for (d, p), boxes in pages.items():
        rows = []
        for y, x, text, reach in sorted(boxes, key=lambda b: (-b[0], b[1])):
            if rows and rows[-1]["y"] - y < 0.012:
                rows[-1]["parts"].append((x, text))
                rows[-1]["reach"] = max(rows[-1]["reach"], reach)
                rows[-1]["y"] = y
            else:
                rows.append({"y": y, "parts": [(x, text)], "reach": reach})
        out = ""
        for n, r in enumerate(rows):
            out += ("" if n == 0 else " " if rows[n - 1]["reach"] >= 0.74 else "\n\n") + " ".join(t for _, t in sorted(r["parts"]))
        want.append((d, p, md5(out)))
    assert asked("ocr_reflow") == sorted(want, key=repr)


def test_line_paragraphs(asked, tables):
    want = []
    for i, t in docs(tables):
        paras = []
        for n, line in enumerate(lines := t.split("\n")):
            was = lines[n - 1] if n else None
            fresh = was is None or (regex.search(r"[.!?][\"'”’]?$", was) and regex.match(r"\p{Lu}", line) and len(was) < 60)
            paras.append([line]) if fresh else paras[-1].append(line)
        want += [(i, n, md5(regex.sub(r"(\p{L})-\n(\p{Ll})", r"\1\2", "\n".join(p)).replace("\n", " "))) for n, p in enumerate(paras, 1)]
    assert asked("line_paragraphs") == sorted(want, key=repr)


def test_suspect_tokens(asked, tables):
    words = {w for _, t in docs(tables) for w in regex.split(r"[^\p{L}]+", t.lower()) if len(w) >= 2}
    want = set()
    for i, t in docs(tables):
        text = regex.sub(r"(\p{L}{3,}) (\p{L})(\p{L}{3,})", r"\1\2\3", t) + " ofTheKind"
        for raw in re.split(r"\s+", text):
            token = regex.sub(r"^\p{P}+|\p{P}+$", "", raw)
            fused = regex.fullmatch(r"\p{Lu}{8,}", token) or (regex.fullmatch(r"\p{L}{7,}", token) and regex.search(r"\p{Ll}\p{Lu}", token))
            low = token.lower()
            if fused and low not in words and any(low[:k] in words and low[k:] in words for k in range(2, len(low) - 1)):
                want.add((i, token))
    assert asked("suspect_tokens") == sorted(want, key=repr)


def shape(t):
    words = [w for w in re.split(r"\s+", re.sub(r"^[0-9IVXLC]+(?:[.\-][0-9A-Za-z]+)*[.:]?\s*", "", t)) if regex.search(r"\p{L}", w)]
    return sum(bool(regex.match(r"\P{L}*\p{Lu}", w)) for w in words) / len(words) if words else 0.0


def test_heading_scores(asked, tables):
    lines = defaultdict(list)
    for r in tables("lineitem"):
        lines[int(r["l_suppkey"])].append({"page": int(r["l_orderkey"]) % 50, "line": int(r["l_linenumber"]), "text": f"Line {r['l_orderkey']}", "font": math.floor(r["l_quantity"] / 5 + 0.5), "bold": r["l_returnflag"] == "R", "caps": r["l_linestatus"] == "O", "gap": r["l_discount"], "indent": r["l_tax"]})
    mid = lambda v: (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2 if (s := sorted(v)) else None
    want = {}
    for d, rows in lines.items():
        sizes = Counter(r["font"] for r in rows)
        body = max(sizes, key=lambda k: (sizes[k], k))
        seeds = [r for r in rows if r["font"] >= 1.15 * body and r["bold"]]
        if not seeds:
            continue
        near = lambda r, c: max(0.0, 1 - abs(r[c] - mid([s[c] for s in seeds])) / max(abs(mid([s[c] for s in seeds])), 1.0))
        share = lambda c: sum(s[c] for s in seeds) / len(seeds)
        placed = []
        for r in rows:
            score = 0.30 * near(r, "font") + 0.15 * (1 - abs(r["bold"] - share("bold"))) + 0.15 * (1 - abs(r["caps"] - share("caps"))) + 0.15 * near(r, "gap") + 0.15 * near(r, "indent") + 0.10 * shape(r["text"])
            if score >= 0.45:
                placed.append((r["page"], r["line"], r["text"], score))
        if not placed:
            continue
        high, good = -1, 0
        for page, line, _, _ in sorted(placed):
            good += page * 10 + line > high
            high = max(high, page * 10 + line)
        ratio = good / len(placed)
        want[d] = (len(placed), round(ratio, 5), round(len(placed) * ratio * (0.5 + 0.5 * sum(p[3] for p in placed) / len(placed)), 4))
    got = {r[0]: (r[1], round(r[2], 5), round(r[3], 4)) for r in asked("heading_scores")}
    assert got.keys() == want.keys()
    assert all(got[d][0] == want[d][0] and math.isclose(got[d][1], want[d][1], abs_tol=2e-5) and math.isclose(got[d][2], want[d][2], abs_tol=2e-3) for d in want)


def test_kmeans_is_a_fixed_point(spark, sf):
    """Each vector lies in the cluster of the nearest mean, and clusters are as many as asked for."""
    import numpy as np

    from lectern.operators import vectors as V
    from lectern.plans.search import vectors

    rows = V.kmeans(vectors(spark, sf)).collect()
    m = np.array([r.vec for r in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    c = np.array([r.cluster for r in rows])
    assert len(rows) == vectors(spark, sf).count() and len(set(c)) <= max(6, min(32, len(rows) // 20))
    means = np.array([m[c == k].mean(axis=0) for k in sorted(set(c))])
    means /= np.linalg.norm(means, axis=1)[:, None]
    nearest = np.array(sorted(set(c)))[(m @ means.T).argmax(axis=1)]
    assert (nearest == c).mean() > 0.98  # rounds are bounded


def test_html_units_hold_the_text_in_order(asked, tables, spark, sf):
    from lectern.sources import files

    got = defaultdict(list)
    for r in files.parse_column(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", "html").orderBy("page_id", "sequence").collect():
        got[r.page_id].append(r)
    for p in tables("pages"):
        body = re.sub(r"(?is)<(script|style|noscript|nav|template|head)\b.*?</\1\s*>", " ", p["html"])
        import html

        words = regex.findall(r"[\p{L}\p{N}]+", html.unescape(re.sub(r"<[^>]*>", " ", body)))
        told = regex.findall(r"[\p{L}\p{N}]+", " ".join(re.sub(r"^\d+\. ", "", r.text) if r.kind == "list_item" else r.text for r in got[int(p["page_id"])]))
        assert told == words
        heads = re.findall(r"(?is)<h([1-6])\b", body)
        assert [str(r.level) for r in got[int(p["page_id"])] if r.kind == "heading"] == heads


def test_html_offsets(asked, tables):
    rows = defaultdict(list)
    for i, _, title, level, at in asked("html_offsets"):
        rows[i].append((at, title, level))
    assert len(rows) == len(tables("pages"))
    for i, found in rows.items():
        assert "A Page of Words" in [t for _, t, _ in found] and not any("Some" in t or "Another" in t for _, t, _ in found)
