"""Secret scans, in DataFrame functions only.

Base: three patterns, leftmost and non-overlapping per kind. The method adds spans: candidate
strings (long runs of key characters that mix letters and digits) are read with a sliding window
whose Shannon entropy, over the alphabet of the string's character class, is kept by incremental
counts: one character enters, one leaves. Where a window reaches the class's threshold, the span of
such windows is a finding. Base findings and placeholder words are cut out of a string first, and each
part that remains is judged by itself, unless it is as a whole on the allow-list (UUIDs, words joined by signs).

Offsets are code points, ends exclusive. Nulls: a null text is empty; a null id stays null. Empty
text: no spans. Very long texts: read whole, in one row; the work grows with their length, and with the number of
matches times its square root. Ties: spans that start alike are ordered by kind, then end. Repeated rows: one result
each. Empty table: empty result. Other columns stay as they are, whatever their names; only one named like an
output column is replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name

#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # runs of 32 and more of [0-9a-f]+
KINDS = ["assign", "access", "hex", "entropy"]
#: Runs of key characters; possessive, so each is read once.
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}+"
#: Character classes: pattern of the whole string, alphabet, entropy in bits over a window.
CLASSES = [
    (r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdefABCDEF", 3.0),
    (r"^[A-Za-z0-9+/=_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 3.6),
]
#: Not secrets: placeholder words, and parts that are UUIDs or words or dates joined by signs (possessive, so that no long part takes the stack).
PLACEHOLDERS = r"(?i)(?:examples?|samples?|placeholders?|changeme|dummy|xxxx+|0123456789|abcdefgh)"
ALLOWED = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]*+(?:[-_/=+]++(?:[A-Za-z]{2,}+|[0-9]{1,4}+))*+[-_/=+]*+$",
]
WINDOW = 20


def _placed(sized: Column) -> Column:
    """Array of (start, end, body) from gaps and bodies in order; in about the square root of their number of pieces, so that none is long to append to."""
    found = "struct<start:int,end:int,body:string>"
    width = F.ceil(F.sqrt(F.size(sized))).cast("int")
    chunks = F.when(F.size(sized) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(sized) - 1) / width).cast("int")), lambda c: F.slice(sized, c * width + 1, width)))
    long = lambda x: x["gap"] + F.length(x["body"])
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + long(x)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(sums, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = acc["at"] + long(x)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["body"].alias("body")))).alias("out"))

    empty = F.array().cast(f"array<{found}>")
    spans = F.zip_with(chunks, starts, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"]))
    return F.coalesce(F.flatten(spans), empty)


def _spans(text: Column, pattern: str, kind: str, value_group: int | None = None, least: int = 0) -> Column:
    """Array of (start, kind, end, body) of the pattern's matches, from the pieces between them."""
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    sized = F.zip_with(F.slice(pieces, F.lit(1), F.size(matched)), matched, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("body")))
    found = F.get(F.transform(F.array(sized), _placed), 0)  # bound once, as it is used many times
    if value_group is not None:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
        pairs = F.filter(F.arrays_zip(found.alias("span"), values.alias("value")), lambda x: F.length(x["value"]) >= least)
        found = F.transform(pairs, lambda x: x["span"])
    elif least:
        found = F.filter(found, lambda x: F.length(x["body"]) >= least)
    rank = KINDS.index(kind)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["body"].alias("body")))


def window_entropy(body: Column, alphabet: str, threshold: float, width: int = WINDOW) -> Column:
    """(first, last): the span of the windows whose entropy reaches the threshold; null first if none does."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)])
    limit = (math.log2(width) - threshold) * width  # entropy >= threshold as a bound on the sum of c log c
    come = F.transform(F.split(body, ""), lambda c: F.instr(F.lit(alphabet), c))
    moves = F.transform(F.array(come), lambda c: F.zip_with(c, F.slice(F.concat(F.array_repeat(F.lit(0), width), c), F.lit(1), F.size(c)), lambda x, y: F.struct(x.alias("come"), y.alias("go"))))
    start = F.struct(
        F.array_repeat(F.lit(0), len(alphabet) + 1).alias("n"), F.lit(0.0).alias("s"), F.lit(1).alias("size"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )

    def step(acc: Column, x: Column) -> Column:
        counts = F.transform(acc["n"], lambda v, j: v + (j == x["come"]).cast("int") - (j == x["go"]).cast("int"))
        n, m = F.get(acc["n"], x["come"]), F.get(acc["n"], x["go"])
        enters = F.get(weight, n + 1) - F.get(weight, n)
        leaves = F.when(x["go"] > 0, F.get(weight, m) - F.get(weight, m - 1)).otherwise(0.0)
        s = acc["s"] + F.when(x["come"] == x["go"], 0.0).otherwise(enters - leaves)
        high = (acc["size"] >= width) & (s <= limit + 1e-9)
        return F.struct(counts.alias("n"), s.alias("s"), (acc["size"] + 1).alias("size"), F.when(high, F.coalesce(acc["first"], acc["size"] - width)).otherwise(acc["first"]).alias("first"), F.when(high, acc["size"]).otherwise(acc["last"]).alias("last"))

    return F.aggregate(F.get(moves, 0), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def find(docs: DataFrame, text_col: str = "text", base_col: str = "base", spans_col: str = "spans") -> DataFrame:
    """``docs`` with two more columns, base findings and all: arrays of (start, rank, end, body), sorted; rank is the kind's place in KINDS.

    Each pattern is tried only where a cheaper test says it may match. Candidates are read in a step of their own,
    so texts without any (most) never reach the fold.
    """
    none = F.array().cast("array<struct<start:int,rank:int,end:int,body:string>>")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    n_assign, n_access, n_hex, n_runs = (fresh_name(n, [*docs.columns, base_col, spans_col]) for n in ("_assign", "_access", "_hex", "_runs"))
    some = docs.withColumns({
        n_assign: F.when(text.rlike(ASSIGN), _spans(text, ASSIGN, "assign", 2, 8)).otherwise(none),
        n_access: F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, "access", None, 16)).otherwise(none),
        n_hex: F.when(text.rlike(r"[0-9a-f]{32}"), _spans(text, HEX, "hex")).otherwise(none),
        n_runs: F.when(text.rlike(r"[A-Za-z0-9+/=_-]{20}"), _spans(text, CANDIDATE, "entropy")).otherwise(none),
    })
    base = F.sort_array(F.concat(n_assign, n_access, n_hex))
    some = some.withColumn(base_col, base)

    def verdict(x: Column) -> Column:
        mixed = x["body"].rlike("[0-9]") & x["body"].rlike("[A-Za-z]")
        allowed = F.lit(False)
        for p in ALLOWED:
            allowed = allowed | x["body"].rlike(p)
        at = F.lit(None).cast("struct<first:int,last:int>")
        for pattern, alphabet, bits in reversed(CLASSES):
            at = F.when(x["body"].rlike(pattern), window_entropy(x["body"], alphabet, bits)).otherwise(at)
        return F.when(mixed & ~allowed, at)

    def remainder(r: Column) -> Column:
        """The parts of a run, of a window's length or more, between base findings and placeholder words."""
        words = F.when(r["body"].rlike(PLACEHOLDERS), _spans(r["body"], PLACEHOLDERS, "entropy")).otherwise(none)
        words = F.transform(words, lambda w: F.struct((r["start"] + w["start"]).alias("start"), (r["start"] + w["end"]).alias("end")))
        met = F.filter(base_col, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
        covers = F.concat(F.transform(met, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))), words)
        covers = F.concat(F.sort_array(covers), F.array(F.struct(r["end"].alias("start"), r["end"].alias("end"))))

        def step(acc: Column, c: Column) -> Column:
            part = F.struct(acc["at"].alias("start"), c["start"].alias("end"), F.substring(r["body"], acc["at"] - r["start"] + 1, c["start"] - acc["at"]).alias("body"))
            out = F.when(c["start"] - acc["at"] >= WINDOW, F.concat(acc["out"], F.array(part))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), out.alias("out"))

        parts = F.array().cast("array<struct<start:int,end:int,body:string>>")
        return F.aggregate(covers, F.struct(r["start"].alias("at"), parts.alias("out")), step, lambda acc: acc["out"])

    some = some.withColumn(n_runs, F.when(F.size(n_runs) > 0, F.flatten(F.transform(n_runs, remainder))).otherwise(F.array().cast("array<struct<start:int,end:int,body:string>>")))
    judged = F.transform(n_runs, lambda r: F.struct(r.alias("r"), verdict(r).alias("v")))
    high = F.filter(judged, lambda x: x["v"]["first"].isNotNull())
    added = F.transform(high, lambda x: F.struct((x["r"]["start"] + x["v"]["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("rank"), (x["r"]["start"] + x["v"]["last"]).alias("end"), F.substring(x["r"]["body"], x["v"]["first"] + 1, x["v"]["last"] - x["v"]["first"]).alias("body")))
    spans = F.when(F.size(n_runs) > 0, F.sort_array(F.concat(base_col, added))).otherwise(F.col(base_col))
    return some.withColumn(spans_col, spans).drop(n_assign, n_access, n_hex, n_runs)


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with each finding in the text replaced by ``mark``; overlapping ones by one."""
    text = F.col(f"`{text_col}`")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.when(x["start"] >= acc["at"], mark).otherwise(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), more.alias("out"))

    base, spans = (fresh_name(n, docs.columns) for n in ("_base", "_spans"))
    done = F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    found = find(docs, text_col, base, spans)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text)).drop(base, spans)
