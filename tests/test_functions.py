import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import html as H
from lectern.functions import normalize as N
from lectern.functions import predicates as P
from lectern.functions import segments as G
from lectern.functions import text as T


@pytest.fixture
def one(spark):
    return lambda f, *values: spark.createDataFrame([values], [f"c{i}" for i in range(len(values))]).select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first().r


@pytest.mark.parametrize(
    "step, text, want",
    [
        (N.strip_bom, "﻿a﻿", "a﻿"),
        (N.strip_invisible, "a b­c​d", "a bcd"),
        (N.line_endings, "a\r\nb\rc\n", "a\nb\nc\n"),
        (N.trailing_space, "a  \nb\t\nc ", "a\nb\nc "),
        (N.tabs_and_spaces, "a\t\tb   c", "a b c"),
        (N.join_hyphens, "inde-\npendent A-\nB", "independent A-\nB"),
        (N.blank_lines, "a\n\n\n\nb", "a\n\nb"),
        (N.italics, "an _odd_ word and snake_case and __init__", "an odd word and snake_case and __init__"),
        (N.asterism_lines, "a\n* * *\nb * c", "a\n\nb * c"),
        (N.unwrap_lines, "a\n b\n\nc", "a b\n\nc"),
        (N.spaced_letters, "C H A P T E R one t w o s", "CHAPTER one twos"),
        (N.spaced_digits, "in 1 8 6 5 it 1 2", "in 1865 it 1 2"),
        (N.numeric_brackets, "see [ 1 2 ] and [a]", "see [12] and [a]"),
        (N.dimensions, "to 27.64.135.48 in a 12.5 in b", "to 27.64.135.48 in a b"),
        (N.illustration_markers, "x [Illustration: A _fine_ day] y", "x \n\nA fine day\n\n y"),
        (N.strip_control, "a\x00b\x07\tc", "ab\tc"),
        (N.normalize, "﻿ a\r\nb  \n\n\n\nc  d ", "a\nb\n\nc d"),
        (T.speech_text, "12. say this", "say this"),
        (T.clean_filename, "pg1234-the_great-book-images.epub", "The Great Book"),
        (T.strip_site_suffix, "Whales - Wikipedia", "Whales (Wikipedia article)"),
        (T.strip_site_suffix, "Whales | The Daily", "Whales"),
        (T.page_signature, "Page 12 of 300", "page # of #"),
        (T.numeric_anchor, "DOCID: 3803783 12", "num:3803783"),
        (T.header_form, "Chapter  IV page 12", "Chapter <R> page <N>"),
        (T.header_form, "ción mid ñ ü. même éd", "ción <R> ñ ü. même éd"),
        (T.roman_value, "MCMXIV", 1914),
        (T.roman_value, "IIII", None),
        (T.token_estimate, "", 0),
        (T.token_estimate, "a", 1),
        (T.markdown_title, "x\n## Second\n# First", "First"),
        (T.fingerprint, "short", "short"),
        (P.role_asked, "Who is the editor of this?", "editor"),
        (P.role_asked, "who translated it", "translat"),
        (H.byline, '<h1>T</h1><h4 class="author">Written by A. Body</h4>', "A. Body"),
    ],
)
def test_text_functions(one, step, text, want):
    assert one(step, text) == want


@pytest.mark.parametrize(
    "test, text, want",
    [
        (P.is_noise, " ", True), (P.is_noise, "??", True), (P.is_noise, "aaaa", True), (P.is_noise, "why", False),
        (P.is_refusal, "Well, it DOESN'T SAY.", True), (P.is_refusal, "it says so", False),
        (P.is_deictic, "What is this?", True), (P.is_deictic, "what is this " + "x" * 80, False),
        (P.is_text_like, "plain", True), (P.is_text_like, "\x01\x02\x03a", False),
        (P.is_long_caps, "PHILOSOPHY", True), (P.is_mixed_case, "wordWord", True), (P.is_fused, "ABCDEFGH", True),
        (T.is_lone_page_number, "xix", True), (T.is_lone_page_number, "mill", False), (T.is_lone_page_number, "214", True),
        (T.is_repetition, "x" * 100 + "the same words come again and " * 4 + "x", False),
        (T.is_repetition, "y" * 50 + "the same words come again and again and so " * 8, False),
        (T.is_repetition, "The start of it. " * 3 + "z" * 120 + "abcdefghi " * 30, True),
    ],
)
def test_predicates(one, test, text, want):
    assert one(test, text) == want


def test_repetition_is_trimmed_in_time_that_grows_with_the_length(one):
    trim = lambda t: T.trim_repetition(t, "End.")
    assert one(trim, "it was 😀😁😀😁😀😁😀😁") == "it was 😀😁 End."
    begun = time.monotonic()
    assert one(trim, "b" + "a" * 200000) == "baa End."
    assert one(trim, "word and " * 20000 + "so") == "word and " * 20000 + "so"
    assert time.monotonic() - begun < 20


def test_bibliography_and_names(one):
    b = one(T.bibliography, "A Book\nby Jane Doe and John Roe\nCopyright © 1911")
    assert b.authors == ["Jane Doe", "John Roe"] and b.year == "1911"
    assert one(T.quoted_strings, 'he said "Good day" and “well now”') == ["good day", "well now"]
    assert one(T.versioned_names, "Falcon 9 flew") == ["falcon 9", "falcon-9"]
    assert one(T.ungrounded, 'It was "pure gold" in "red ink"', "red ink only") == ["pure gold"]


def test_anchors_are_found_again(one):
    text = "one two three four two five"
    a = one(lambda t: T.anchor(t, F.lit(4), F.lit(7), 4), text)
    assert (a.text, a.before, a.after) == ("two", "one ", " thr")
    assert one(lambda t: T.refine_anchor(t, F.lit(0), F.lit("two"), F.lit("four "), F.lit("")), text) == 19
    assert one(lambda t: T.refine_anchor(t, F.lit(18), F.lit("two"), F.lit("gone "), F.lit("")), text) == 19
    assert one(lambda t: T.context_line(t, F.lit("b")), "a\nxbx\nc") == "xbx"


def test_mojibake():
    assert N.repair_text("cafÃ© â€œhiâ€\x9d") == "café “hi”"
    assert N.repair_text("plain café") == "plain café" and N.repair_text(None) is None


def test_segments():
    assert G.balanced("a" * 10, 4) == ["aaa", "aaa", "aaaa"] or all(len(p) <= 4 for p in G.balanced("a" * 10, 4))
    assert "".join(G.balanced("one, two, three, four, five", 12)).replace(" ", "") == "one,two,three,four,five"
    text = "1. First thing. Dr. No came; " + "word " * 80 + "end."
    cut = G.spoken(text)
    assert text[cut[0][0] : cut[0][1]] == "1. First thing." and all(b - a <= 250 for a, b in cut)
    assert G.placeholders("a [[POSITION:page=3]] b") == [("text", "a"), ("visual", "3:"), ("text", "b")]
    assert G.anchors("x⟦#one⟧y⟦h2:T⟧z") == ("xyz", [("#one", 1), ("h2:T", 2)])
    assert G.splitmix(42, 2) == [13679457532755275413, 2949826092126892291]
    assert G.reflow_blob("A\nb\nC\nd") == "A b\n\nC d" and G.reflow_blob("a\nb") is None
