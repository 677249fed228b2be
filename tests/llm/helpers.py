"""Documents with everything odd in them: nulls, empty and long texts, repeats, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, words string, base string"


def odd_documents(spark, extra=()):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épsilon", "zeta"]) for _ in range(n))
    long = say(30_000)
    texts = [(1, None), (2, ""), (None, "a text without an id"), (None, None), (3, "one"), (4, "two words"), (5, long), (6, long), (7, say(200)), (7, "the same id, another text"), (8, "copy me now"), (8, "copy me now"), (9, " \n\t "), (10, "naïve 😀 text\x00with\ttabs"), *extra]
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 5, 0.5, "clash", "clash") for i, t in texts], SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
