"""Text functions over documents, pages, conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import predicates as P
from ..functions import text as T
from . import woven as W
from .registry import query, read

_DIRTY = W.dirty_sql("text")
_SAID = W.in_turn_sql("turn", W.SAID, "text")


def _digest(spark, sf, step, table="documents", key="doc_id", column="text"):
    t = step(F.col(column) if isinstance(column, str) else column)
    return read(spark, sf, table).select(key, F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


def _sql(expr: str, table: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, md5(t) AS digest, length(t) AS n FROM (SELECT {key}, {expr} AS t FROM {table})"


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(round(length(text) / 2.5) AS INTEGER)) END AS tokens FROM documents")
def token_estimate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


#: The passes as SQL, each of a text.
_LINES = lambda t: f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_SPACES = lambda t: f"regexp_replace(replace({t}, chr(9), ' '), ' {{2,}}', ' ', 'g')"
_BLANKS = lambda t: rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
_TRAILING = lambda t: rf"regexp_replace({t}, '[ \t]+\n', chr(10), 'g')"
_HYPHENS = lambda t: rf"regexp_replace({t}, '([A-Za-z]+)[-¬][ \n\x0c] ?([a-z]+)', '\1\2', 'g')"
_INVISIBLE = lambda t: f"replace(replace(replace(replace(replace({t}, chr(160), ' '), chr(173), ''), chr(8203), ''), chr(8204), ''), chr(8205), '')"
_CONTROL = lambda t: rf"regexp_replace({t}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}\x{{E000}}-\x{{F8FF}}\x{{FFF0}}-\x{{FFFD}}\x{{E0100}}-\x{{E01EF}}]', '', 'g')"
_BOM = lambda t: f"CASE WHEN {t} LIKE chr(65279) || '%' THEN substr({t}, 2) ELSE {t} END"


@query(_sql(_LINES(_DIRTY)))
def norm_line_endings(spark, sf):
    return _digest(spark, sf, N.line_endings, column=W.dirty(F.col("text")))


@query(_sql(_SPACES(_DIRTY)))
def norm_spaces(spark, sf):
    return _digest(spark, sf, N.tabs_and_spaces, column=W.dirty(F.col("text")))


@query(_sql(_BLANKS(_DIRTY)))
def norm_blank_lines(spark, sf):
    return _digest(spark, sf, N.blank_lines, column=W.dirty(F.col("text")))


@query(_sql(_TRAILING(_DIRTY)))
def norm_trailing_ws(spark, sf):
    return _digest(spark, sf, N.trailing_space, column=W.dirty(F.col("text")))


@query(_sql(_HYPHENS(_DIRTY)))
def norm_hyphen_join(spark, sf):
    return _digest(spark, sf, N.join_hyphens, column=W.dirty(F.col("text")))


@query(_sql(_INVISIBLE(_DIRTY)))
def norm_invisible(spark, sf):
    return _digest(spark, sf, N.strip_invisible, column=W.dirty(F.col("text")))


@query(_sql(_CONTROL(_DIRTY)))
def norm_control(spark, sf):
    return _digest(spark, sf, N.strip_control, column=W.dirty(F.col("text")))


@query(_sql(_BOM(_DIRTY)))
def norm_bom(spark, sf):
    return _digest(spark, sf, N.strip_bom, column=W.dirty(F.col("text")))


@query(_sql("replace(text, '_', '-') || ' snake_case_name'"))
def norm_italics(spark, sf):
    """Emphasis put around words comes off; names with underscores stay."""
    t = F.concat(W.replaced(F.col("text"), [("_", "-"), (" the ", " _the_ "), (" de ", " _de_ ")]), F.lit(" snake_case_name"))
    return _digest(spark, sf, N.italics, column=t)


#: Letters and digits spread out, as glyph by glyph output has them.
_SPREAD = [(" the ", " T H E "), (" de ", " d e l a "), (" and ", " 1 8 5 0 2 "), (" la ", " X Y ")]


def spread(t: str) -> str:
    for was, new in _SPREAD:
        t = t.replace(was, new)
    return t


@query()
def norm_spaced_letters(spark, sf):
    return _digest(spark, sf, lambda t: N.spaced_digits(N.spaced_letters(t)), column=W.replaced(F.col("text"), _SPREAD))


def _universal_sql(t: str, unwrapped: bool) -> str:
    """The passes in order over documents without scene breaks, print headers, illustrations or emphasis."""
    steps = [_CONTROL, _INVISIBLE, _LINES, _TRAILING, _HYPHENS, _SPACES, _BLANKS, lambda x: rf"regexp_replace({x}, '^[\s\x{{0B}}\x{{85}}\x{{2000}}-\x{{200A}}\x{{3000}}]+|[\s\x{{0B}}\x{{85}}\x{{2000}}-\x{{200A}}\x{{3000}}]+$', '', 'g')"]
    with_ = f"WITH s0 AS (SELECT doc_id, substr({t}, 2) AS t FROM documents)"
    for n, step in enumerate(steps):
        with_ += f", s{n + 1} AS (SELECT doc_id, {step('t')} AS t FROM s{n})"
    last = f"s{len(steps)}"
    out = r"array_to_string(list_transform(string_split(t, chr(10) || chr(10)), lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ')), chr(10) || chr(10))" if unwrapped else "t"
    return with_ + f" SELECT doc_id, md5(t) AS digest, length(t) AS n FROM (SELECT doc_id, {out} AS t FROM {last})"


@query(_universal_sql(_DIRTY, True))
def norm_universal(spark, sf):
    return _digest(spark, sf, lambda t: N.normalize_universal(t, hard_wrapped=True), column=W.dirty(F.col("text")))


@query()
def norm_page(spark, sf):
    return _digest(spark, sf, N.normalize_page, column=W.replaced(F.col("text"), _SPREAD))


@query(_sql(r"array_to_string(list_transform(string_split(text, chr(10) || chr(10)), lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ')), chr(10) || chr(10))"))
def norm_unwrap(spark, sf):
    return _digest(spark, sf, N.unwrap_lines)


@query(_sql(r"trim(regexp_replace(text, '[\n ]+', ' ', 'g'))"))
def norm_compact(spark, sf):
    return _digest(spark, sf, N.compact)


@query(_sql(W.replaced_sql("text", [(" and ", "\n\nThe ship at sea\n\n"), (" und ", "\n\n")])))
def norm_illustrations(spark, sf):
    """Markers with a caption, and without one."""
    return _digest(spark, sf, N.illustration_markers, column=W.replaced(F.col("text"), [(" and ", "[Illustration: _The_ ship ·A. B.·\n at sea]"), (" und ", "[Illustration]")]))


@query(_sql("regexp_replace(" + W.replaced_sql("text", [("[", "("), ("\t", " "), (" and ", " [123] "), (" und ", " [7]  ")]) + ", ' {2,}', ' ', 'g')"))
def norm_brackets(spark, sf):
    t = W.replaced(F.col("text"), [("[", "("), (" and ", " [ 1 2\n3 ] 3.25 in "), (" und ", " [7] 12.5 in\t")])
    return _digest(spark, sf, lambda t: N.numeric_brackets(N.dimensions(t)), column=t)


@query(_sql(W.replaced_sql("text", [(" and ", " café naïve ’ "), (" und ", " über ")])))
def norm_mojibake(spark, sf):
    """Characters put in as their bytes are read wrongly come out right; others stay."""
    t = W.replaced(F.col("text"), [(" and ", " cafÃ© naÃ¯ve â€™ "), (" und ", " Ã¼ber ")])
    d = N.repair_mojibake(read(spark, sf, "documents").select("doc_id", t.alias("text")), "text")
    return d.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


@query(_sql(r"regexp_replace(regexp_replace(regexp_replace(" + _DIRTY + r", '(?is)Evaluation Only\.\s*Created with Aspose\.[A-Za-z]+\.[^.]*\.', ' ', 'g'), '(?is)(?:Generated|Created)\s+(?:by|with)\s+[Cc]alibre[^.\n]{0,80}\.', ' ', 'g'), ' {2,}', ' ', 'g')"))
def strip_watermarks(spark, sf):
    return _digest(spark, sf, T.strip_watermarks, column=W.dirty(F.col("text")))


@query(r"""
SELECT conv_id, turn, t = '' OR length(regexp_replace(t, '[^\p{L}]', '', 'g')) < 2 OR length(replace(t, left(t, 1), '')) = 0 AS noise
FROM (SELECT conv_id, turn, lower(regexp_replace(""" + _SAID + r""", '^\s+|\s+$', '', 'g')) AS t FROM conversations)""")
def noise_flag(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", P.is_noise(_said()).alias("noise"))


def _said():
    return W.in_turn(F.col("turn"), W.SAID, F.col("text"))


def _contains(column: str, phrases: list[str]) -> str:
    return " OR ".join(f"contains({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases)


@query(f"SELECT conv_id, turn, {_contains(f'lower({_SAID})', P.REFUSALS)} AS refusal FROM conversations")
def refusal_flag(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", P.is_refusal(_said()).alias("refusal"))


@query(f"SELECT conv_id, turn, {_contains(f'lower({_SAID})', P.RECOMMENDATIONS)} AS recommendation FROM conversations")
def recommendation_flag(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", P.is_recommendation(_said()).alias("recommendation"))


@query(rf"SELECT conv_id, turn, length(t) <= 80 AND ({_contains('t', P.DEICTICS)}) AS deictic FROM (SELECT conv_id, turn, lower(regexp_replace({_SAID}, '^\s+|\s+$', '', 'g')) AS t FROM conversations)")
def deictic_flag(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", P.is_deictic(_said()).alias("deictic"))


def _role_sql() -> str:
    """The first role in the order of asks and roles, else the first verb."""
    cases = [f"WHEN contains(t, '{(ask + role).replace(chr(39), chr(39) * 2)}') THEN '{role}'" for ask in P.ROLE_ASKS for role in P.ROLES]
    cases += [f"WHEN contains(t, 'who {v} ') THEN '{v[:-2]}'" for v in P.ROLE_VERBS]
    return f"SELECT conv_id, turn, CASE {' '.join(cases)} END AS role_asked FROM (SELECT conv_id, turn, lower({_SAID}) AS t FROM conversations)"


@query(_role_sql())
def role_asked(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", P.role_asked(_said()).alias("role_asked"))


@query(r"SELECT page_id, page_id % 3 <> 0 AND length(regexp_replace(left(t, 4096), '[^\x01-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) < 0.15 * length(left(t, 4096)) AS text_like FROM (SELECT page_id, CASE WHEN page_id % 3 = 1 THEN replace(html, 'e', chr(7) || chr(7)) ELSE html END AS t FROM pages)")
def text_like(spark, sf):
    """Pages as they are, with control characters, and with a NUL."""
    h, k = F.col("html"), F.col("page_id") % 3
    t = F.when(k == 0, F.concat(h, F.lit("\0"))).when(k == 1, F.replace(h, F.lit("e"), F.lit("\x07\x07"))).otherwise(h)
    return read(spark, sf, "pages").select("page_id", P.is_text_like(t).alias("text_like"))


@query("SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'rtf' WHEN 2 THEN 'zip' WHEN 3 THEN 'png' WHEN 4 THEN 'jpeg' WHEN 5 THEN 'gif' ELSE 'unknown' END AS format FROM pages")
def format_sniff(spark, sf):
    """Pages behind the first bytes of each format."""
    signs = ["255044462D312E37", "7B5C72746631", "504B0304", "89504E470D0A1A0A", "FFD8FFE0", "474946383961", ""]
    head = F.unhex(F.get(F.array(*[F.lit(x) for x in signs]), (F.col("page_id") % 7).cast("int")))
    return read(spark, sf, "pages").select("page_id", P.magic_format(F.concat(head, F.col("html").cast("binary"))).alias("format"))


@query("SELECT doc_id, regexp_matches(text, '[0-9]{4,}') AS hit, len(regexp_extract_all(text, '[0-9]{4,}')) AS n FROM documents")
def segment_match(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.col("text").rlike("[0-9]{4,}").alias("hit"), F.regexp_count("text", F.lit("[0-9]{4,}")).cast("long").alias("n"))


@query(r"SELECT DISTINCT p_name, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_partkey), '\p{N}+', '#', 'g'), '[^\p{L}#]+', ' ', 'g')) AS signature FROM part")
def page_signature(spark, sf):
    name = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    return read(spark, sf, "part").select("p_name", T.page_signature(name).alias("signature")).distinct()


_NUMBERS = [("12", True), (" 407 ", True), ("xiv", True), ("MCMXC", True), ("iiii", False), ("page 3", False), ("12a", False), ("", False), ("mmdccclxxxviii", False), ("IX.", False)]


@query("SELECT page_id, CASE page_id % 10 " + " ".join(f"WHEN {n} THEN {str(x).lower()}" for n, (_, x) in enumerate(_NUMBERS)) + " END AS lone FROM pages")
def lone_page_number(spark, sf):
    """Digits and strict roman numerals of up to seven letters, and what only looks like them."""
    return read(spark, sf, "pages").select("page_id", T.is_lone_page_number(W.in_turn(F.col("page_id"), [t for t, _ in _NUMBERS], F.lit(None))).alias("lone"))


@query(r"""
SELECT page_id, CASE WHEN title <> '' THEN title WHEN head <> '' THEN head END AS title FROM (
SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g') AS title,
regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') AS head FROM pages)""")
def html_title(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


_SITES = [("The Whale - Some Site", "The Whale"), ("Moby-Dick | Wikipedia", "Moby-Dick (Wikipedia article)"), ("A – B — Encyclopedia Britannica", "A – B (Britannica article)"), ("Plain", "Plain"), ("T - a very long name of a site that is no suffix", "T - a very long name of a site that is no suffix"), ("x" * 201, "A File")]
_FILES = [("pg1342-pride_and_prejudice.txt", "Pride And Prejudice"), ("2701-moby-dick-images.epub", "Moby Dick"), ("NASA_report_v2.html", "NASA Report V2"), ("84_cleaned.txt", "Cleaned"), (".txt", ".txt"), ("war--and__peace-12.md", "War And Peace"), ("pg12.txt", "Untitled")]


@query("SELECT page_id, CASE page_id % 10 " + " ".join(f"WHEN {n} THEN {W.literal(b)}" for n, (_, b) in enumerate(_SITES)) + " ELSE 'A File' END AS title FROM pages")
def html_title_resolved(spark, sf):
    """Titles behind sites' names; where there is none, or too long a one, the file's name tells."""
    raw = W.in_turn(F.col("page_id"), [a for a, _ in _SITES], F.lit("  "))
    page = F.concat(F.lit("<html><title>"), raw, F.lit("</title>"), F.lit("<p>x</p>"))
    return read(spark, sf, "pages").select("page_id", page.alias("h")).select("page_id", T.resolve_title(T.strip_site_suffix(T.html_title(F.col("h"))), F.lit("a_file.html")).alias("title"))


@query("SELECT page_id, CASE page_id % 10 " + " ".join(f"WHEN {n} THEN {W.literal(b)}" for n, (_, b) in enumerate(_FILES)) + " ELSE 'Page ' || page_id END AS title FROM pages")
def clean_filenames(spark, sf):
    own = F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(".html"))
    return read(spark, sf, "pages").select("page_id", T.clean_filename(W.in_turn(F.col("page_id"), [a for a, _ in _FILES], own)).alias("title"))


#: Openings of books before the documents, by the id's remainder.
_OPENINGS = [
    "Title: The Whale\n  or, the Ship\nAuthor: H. Body\n\n", "The Project Gutenberg eBook of Words\nRelease Date: May 1, 2004\n\n*** START ***\n\nMOBY-DICK;\n\nor, THE WHALE.\n\nBy A. Body\n",
    "# A Marked Title\nFirst published in 1851\n", "\n\nA short line\n## Second\nChapter 1\n", "title:\nProduced by Hand\nCopyright 1999\n",
]


def titled(i: int, t: str) -> str:
    return (_OPENINGS[i % 10] if i % 10 < len(_OPENINGS) else "") + t


@query()
def text_titles(spark, sf):
    t = F.concat(W.in_turn(F.col("doc_id"), _OPENINGS, F.lit("")), "text")
    return read(spark, sf, "documents").select("doc_id", t.alias("text")).withColumn("t", F.col("text")).select("doc_id", T.txt_title(F.col("t")).alias("title"), T.markdown_title(F.col("t")).alias("markdown_title"), T.bibliography(F.col("t"))["year"].alias("year"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(p_name || ' and ' || p_brand, ' and ', ','), '[,;&]'), lambda x: trim(x)), lambda x: length(x) >= 2), '|') AS authors FROM part")
def split_authors(spark, sf):
    raw = F.concat_ws(" and ", "p_name", "p_brand")
    return read(spark, sf, "part").select("p_partkey", F.array_join(T.split_authors(raw), "|").alias("authors"))


@query(r"""
SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)""")
def sentence_list(spark, sf):
    s = T.sentences(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


@query(r"""
WITH p AS (SELECT doc_id, regexp_split_to_array(replace(text, '. ', '.7 '), '\.[0-9]{1,3}\s+') AS p FROM documents)
SELECT doc_id, CAST(1 + len(list_filter(range(1, len(p)), lambda i: regexp_matches(p[i], '[^0-9\s.]$') AND regexp_matches(p[i + 1], '^\p{Lu}'))) AS INTEGER) AS n FROM p""")
def footnote_split(spark, sf):
    """Each sentence's full stop takes a footnote's number."""
    return read(spark, sf, "documents").select("doc_id", F.size(T.footnote_parts(F.replace("text", F.lit(". "), F.lit(".7 ")))).alias("n"))


_LOOP = "The same words come again now."  # 30 characters
_LOOPS = "(CASE doc_id % 5 WHEN 0 THEN text || repeat('" + _LOOP + "', 3) WHEN 1 THEN text || 'ab ab ab ab ' WHEN 2 THEN text || repeat('" + _LOOP + " abcdef', 3) WHEN 3 THEN left(text, 100) || repeat('" + _LOOP + "', 3) ELSE text END)"


def _looping():
    t, k = F.col("text"), F.col("doc_id") % 5
    return F.when(k == 0, F.concat(t, F.lit(_LOOP * 3))).when(k == 1, F.concat(t, F.lit("ab ab ab ab "))).when(k == 2, F.concat(t, F.lit((_LOOP + " abcdef") * 3))).when(k == 3, F.concat(F.left(t, F.lit(100)), F.lit(_LOOP * 3))).otherwise(t)


def _tail(size: int, back: int) -> str:
    return f"substr(t, length(t) - {size * back} + 1, {size})"


def _loops_sql() -> str:
    long = [f"(length(t) >= {3 * n} AND {_tail(n, 1)} = {_tail(n, 2)} AND {_tail(n, 2)} = {_tail(n, 3)})" for n in range(30, 81, 10)]
    short = [rf"(length(regexp_replace({_tail(n, 1)}, '^\s+|\s+$', '', 'g')) >= 2 AND {_tail(n, 1)} = {_tail(n, 2)} AND {_tail(n, 2)} = {_tail(n, 3)} AND {_tail(n, 3)} = {_tail(n, 4)})" for n in range(2, 11)]
    return f"SELECT doc_id, length(t) >= 200 AND ({' OR '.join(long + short)}) AS repetition FROM (SELECT doc_id, {_LOOPS} AS t FROM documents)"


@query(_loops_sql())
def repetition_flag(spark, sf):
    """A paragraph three times, a short string four times, a loop of another length, a text too short, and none."""
    return read(spark, sf, "documents").select("doc_id", _looping().alias("t")).select("doc_id", T.is_repetition(F.col("t")).alias("repetition"))


@query()
def repetition_trim(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", _looping().alias("t"))
    return d.select("doc_id", F.md5(T.trim_repetition(F.col("t"), "And so on.")).alias("digest"))


#: What an answer names before its own words.
ANSWER = 'It is "a secret name" by the House of Long Winters, on Gemma 4 and Qwen-3.5. '


def summary(i: int, t: str) -> str:
    """Every third document gets a name that it lacks."""
    return ("Zyxwv Qwertz said so. " if i % 3 == 0 else "") + t


@query()
def answer_grounding(spark, sf):
    """Names and quotes of an assistant's turn that the user's turn before it lacks."""
    from ..operators.conversations import pairs

    c = read(spark, sf, "conversations")
    p = pairs(c)
    u = c.select("conv_id", F.col("turn").alias("user_turn"), F.col("text").alias("question")).distinct()
    a = c.select("conv_id", F.col("turn").alias("assistant_turn"), F.col("text").alias("answer")).distinct()
    j = p.distinct().join(u, ["conv_id", "user_turn"]).join(a, ["conv_id", "assistant_turn"])
    return j.select("conv_id", "assistant_turn", F.array_join(T.ungrounded(F.concat(F.lit(ANSWER), "answer"), F.col("question")), "|").alias("ungrounded"))


@query("SELECT event_id, CAST(round((greatest(CAST(round(value) AS BIGINT), 0) / 5.0) / (155.0 * 1.0)) AS BIGINT) AS minutes FROM events WHERE value IS NOT NULL")
def reading_time(spark, sf):
    return read(spark, sf, "events").where("value is not null").select("event_id", T.reading_minutes(F.round("value").cast("long"), F.lit(100.0)).alias("minutes"))


@query("SELECT doc_id, md5('search_query: ' || text) AS query, md5('search_document: ' || text) AS document FROM documents")
def embed_prefix(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", F.md5(T.prefixed(t, "query")).alias("query"), F.md5(T.prefixed(t, "document")).alias("document"))


@query("SELECT doc_id, left(text, 250) AS head FROM documents")
def token_ceiling(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.trim_to_tokens(F.col("text"), 100).alias("head"))


_ROMANS = [("XIV", 14), ("MCMXC", 1990), ("iiii", None), ("ix", 9), ("MMMM", None), ("", None), ("CDXLIV", 444), ("words", None), ("mdc", 1600), ("MMMCMXCIX", 3999)]


@query("SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {n} THEN {'NULL' if b is None else b}" for n, (_, b) in enumerate(_ROMANS)) + " END AS value FROM documents")
def roman_numerals(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.roman_value(W.in_turn(F.col("doc_id"), [a for a, _ in _ROMANS], F.lit(None))).alias("value"))


@query("SELECT doc_id, substr(text, 101, 40) AS anchor_text, substr(text, 53, 48) AS before, substr(text, 141, 48) AS after FROM documents WHERE length(text) > 200")
def anchor_capture(spark, sf):
    a = T.anchor(F.col("text"), F.lit(100), F.lit(140))
    return read(spark, sf, "documents").where(F.length("text") > 200).select("doc_id", a["text"].alias("anchor_text"), a["before"].alias("before"), a["after"].alias("after"))


@query("""
WITH m AS (SELECT doc_id, text, 'New words put before it. ' || text AS t, substr(text, 101, 40) AS a, substr(text, 53, 48) AS b FROM documents WHERE length(text) > 200)
SELECT doc_id, CASE WHEN substr(t, 101, 40) = a THEN 100 ELSE position(b || a IN t) - 1 + 48 END AS at FROM m""")
def anchor_refine(spark, sf):
    """An anchor taken after 100 characters, looked for where it was after words were put before the text."""
    d = read(spark, sf, "documents").where(F.length("text") > 200)
    a = T.anchor(F.col("text"), F.lit(100), F.lit(140))
    moved = F.concat(F.lit("New words put before it. "), F.col("text"))
    return d.select("doc_id", T.refine_anchor(moved, F.lit(100), a["text"], a["before"], a["after"]).cast("long").alias("at"))


@query(r"""
WITH s AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents), c AS (SELECT *, regexp_replace(left(s, 48), '\s+\S*$', '') AS cut FROM s)
SELECT doc_id, CASE WHEN length(s) <= 48 THEN s WHEN length(cut) >= 24 THEN cut ELSE left(s, 48) END AS print FROM c""")
def anchor_fingerprint(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("print"))


@query("SELECT p_partkey, p_partkey % 3 < 2 AND regexp_matches(p_name, '[a-zA-Z0-9]') AS same FROM part")
def resegmentation(spark, sf):
    """A name with spaces and hyphens put in, with its spaces left out, and with a letter more."""
    n, k = F.col("p_name"), F.col("p_partkey") % 3
    new = F.when(k == 0, F.regexp_replace(F.upper(n), "([AEIOU])", "$1- ")).when(k == 1, F.replace(n, F.lit(" "), F.lit(""))).otherwise(F.concat(n, F.lit("s")))
    return read(spark, sf, "part").select("p_partkey", T.is_resegmentation(n, new).alias("same"))


@query(r"""
WITH w AS (SELECT p_partkey, p_name, p_type, list_filter(regexp_split_to_array(regexp_replace(p_name, '^[0-9IVXLC]+(?:[.\-][0-9A-Za-z]+)*[.:]?\s*', ''), '\s+'), lambda x: regexp_matches(x, '\p{L}')) AS w,
list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2)) AS own, regexp_split_to_array(lower(p_type), '[^\p{L}\p{N}]+') AS other FROM part)
SELECT p_partkey, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: regexp_matches(x, '^\P{L}*\p{Lu}'))) / len(w) ELSE 0 END, 6) AS shape,
round(CASE WHEN len(own) > 0 THEN len(list_intersect(own, other)) / len(own) ELSE 0 END, 6) AS overlap, regexp_matches(p_name, '^(?:(?i:chapter|part|section|article|schedule)\s+)?\d{1,3}(?:\.\d{1,3}){0,3}\.?\s+\p{L}') AS numbered FROM w""")
def title_shapes(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.round(T.title_shape(F.col("p_name")), 6).alias("shape"), F.round(T.title_overlap(F.col("p_name"), F.col("p_type")), 6).alias("overlap"), F.col("p_name").rlike(T.SECTION_NUMBER).alias("numbered"))
