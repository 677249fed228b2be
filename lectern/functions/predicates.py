"""Boolean columns over texts, questions and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewrite import any_of, trim_ws

# Kinds of units, phrases and words that decide a predicate.
PROSE_KINDS = ["prose", "heading", "blockquote", "list_item", "code", "table"]
REFUSALS = [
    "the document doesn't say", "the document does not say", "doesn't say", "does not say",
    "the document doesn't mention", "the document does not mention", "doesn't mention", "isn't mentioned", "is not mentioned",
    "not in the document", "not present in", "the document doesn't specify", "the document does not specify", "doesn't specify",
]
RECOMMENDATIONS = [
    "should i read", "should i get", "should i buy", "should i pick up", "is this worth reading", "is this worth your time",
    "is it worth reading", "is it worth my time", "would you recommend this", "would you recommend that", "do you recommend this",
    "do you recommend that", "is this a good read", "is this any good", "should i bother", "do i need to read",
]
DEICTICS = [
    "what does this mean", "what does that mean", "what does it mean", "what does this refer", "what does that refer", "what does it refer",
    "what is this", "what is that", "what is it", "what's this mean", "what's that mean", "what's it mean", "what's this referring",
    "what's that referring", "what does 'this'", "what does 'that'", "what does 'it'", "explain this", "explain that", "explain it",
    "what's this about", "what's that about", "huh",
]
ROLES = ["editor", "publisher", "illustrator", "translator", "narrator", "co-author", "co author", "ghostwriter", "typesetter", "designer", "photographer", "screenwriter", "director", "producer"]
ROLE_ASKS = ["who is the ", "who's the ", "who was the ", "whos the ", "name the ", "who are the "]
ROLE_VERBS = ["edited", "published", "illustrated", "translated", "narrated", "directed", "produced"]


def is_prose(kind: Column) -> Column:
    return kind.isin(PROSE_KINDS)


def is_noise(text: Column) -> Column:
    """Empty, fewer than two letters, or one character repeated."""
    t = F.lower(trim_ws(text))
    return (t == "") | (F.regexp_count(t, F.lit(r"\p{L}")) < 2) | t.rlike(r"(?s)^(.)\1*$")


def is_refusal(text: Column) -> Column:
    return any_of(F.lower(text), REFUSALS)


def is_recommendation(text: Column) -> Column:
    return any_of(F.lower(text), RECOMMENDATIONS)


def is_deictic(text: Column) -> Column:
    """Short, and asks what this, that or it is."""
    t = F.lower(trim_ws(text))
    return (F.length(t) <= 80) & any_of(t, DEICTICS)


def role_asked(question: Column) -> Column:
    """The role whose holder is asked for: a role term, or a verb without its ending; else null."""
    q = F.lower(question)
    asked = F.lit(None).cast("string")
    for v in reversed(ROLE_VERBS):
        asked = F.when(F.contains(q, F.lit(f"who {v} ")), v[:-2]).otherwise(asked)
    for ask in reversed(ROLE_ASKS):
        for role in reversed(ROLES):
            asked = F.when(F.contains(q, F.lit(ask + role)), role).otherwise(asked)
    return asked


def role_missing(question: Column, text: Column) -> Column:
    """Whether a role is asked for that the text never names."""
    role = role_asked(question)
    return role.isNotNull() & ~F.contains(F.lower(text), role)


def is_text_like(text: Column) -> Column:
    """No NUL, and under 15 % control characters among the first 4096."""
    head = F.substring(text, 1, 4096)
    control = F.regexp_count(head, F.lit(r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]"))
    return ~F.contains(text, F.lit("\x00")) & (control < 0.15 * F.length(head))


def magic_format(content: Column) -> Column:
    """Format by the first bytes of binary content."""
    h = F.hex(F.substring(content, 1, 8))
    signs = [("25504446", "pdf"), ("504B0304", "zip"), ("7B5C727466", "rtf"), ("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif")]
    out = F.lit("unknown")
    for sign, name in reversed(signs):
        out = F.when(h.startswith(sign), name).otherwise(out)
    return out


def is_fused(token: Column) -> Column:
    """The shape of words run together: eight capitals, or seven letters with a small one before a capital."""
    return token.rlike(r"^\p{Lu}{8,}$") | (token.rlike(r"^\p{L}{7,}$") & token.rlike(r"\p{Ll}\p{Lu}"))


def is_long_caps(token: Column) -> Column:
    return token.rlike(r"^\p{Lu}{9,}$")


def is_mixed_case(token: Column) -> Column:
    """Seven letters or more with a small one before a capital."""
    return token.rlike(r"^\p{L}{7,}$") & token.rlike(r"\p{Ll}\p{Lu}")
