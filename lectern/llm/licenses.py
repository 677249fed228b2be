"""License scans by diagonal voting, in DataFrame functions only.

Rolling word k-gram hashes of the documents are joined to their positions in license templates.
Each match votes for the diagonal (place in the document less place in the template); votes are
summed by diagonal, neighbouring diagonals (words put in or left out) are merged, and a merged span
is verified: it is a license if enough of the template's k-grams stand in it, each counted once, however often the
text repeats it. Matches are checked word by word, so a
hash never decides. Short phrases are templates of their own, which must agree in full.

Nulls: a null text is empty; a null id stays null. No words: no places, score 0. Very long texts: read whole; a row's
matches are what grows. Ties: labels are sorted; of equal scores there is but one number. Repeated rows: one
result each. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .words import gram, rolling_grams, words

#: Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Common notices and their labels.
NOTICES = [
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
]
GRAM = 4


def template_rows() -> list[tuple]:
    """(template, label, phrase, grams, k, tpos, words) of each k-gram of a template."""
    rows = []
    for n, (text, label, phrase) in enumerate([(t, x, True) for t, x in PHRASES] + [(t, x, False) for t, x in NOTICES]):
        tokens = text.split()
        k = min(GRAM, len(tokens))
        rows += [(n, label, phrase, len(tokens) - k + 1, k, at, tokens[at : at + k]) for at in range(len(tokens) - k + 1)]
    return rows


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, phrase, grams, t_k, tpos, t_words, t_gram): a fixed table of a few hundred rows."""
    rows = template_rows()
    table = spark.createDataFrame(rows, "template int, label string, phrase boolean, grams int, k int, tpos int, t_words array<string>")
    of = F.lit(None).cast("long")
    for k in sorted({r[4] for r in rows}):
        of = F.when(F.col("k") == k, gram(F.col("t_words"), F.lit(0), k)).otherwise(of)
    return table.withColumn("t_gram", of).withColumnRenamed("k", "t_k")


def votes(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, n_words, template, label, phrase, grams, pos, tpos): matches, and a row without for each document."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), words(F.col("text")).alias("words"))
    sizes = sorted({min(GRAM, len(t.split())) for t, _ in PHRASES + NOTICES})
    at = rolling_grams(texts, sizes)
    same = (F.col("gram") == F.col("t_gram")) & (F.slice("words", F.col("pos") + 1, F.col("t_k")) == F.col("t_words"))
    joined = at.join(F.broadcast(templates(spark)), same, "left")
    first = (F.coalesce("pos", F.lit(0)) == 0) & (F.col("k") == sizes[0])
    return joined.where(F.col("template").isNotNull() | first).select("uid", "doc_id", F.size("words").cast("long").alias("n_words"), "template", "label", "phrase", "grams", F.when(F.col("template").isNotNull(), F.col("pos")).alias("pos"), "tpos")


def scan(docs: DataFrame, least_share: float = 0.6, gap: int = 3) -> DataFrame:
    """Per document: doc_id, n_words, base places and labels, all labels, score.

    A notice counts if ``least_share`` of its k-grams lie on diagonals that are ``gap`` words apart at most.
    """
    rows = votes(docs).withColumn("diagonal", F.col("pos") - F.col("tpos"))
    keys = ["uid", "doc_id", "n_words", "template", "label", "phrase", "grams"]
    summed = rows.groupBy(*keys, "diagonal").agg(F.collect_set("tpos").alias("at"))  # places of a template, which are few
    # phrases are exact: their diagonals are not merged
    line = Window.partitionBy("uid", "template").orderBy("diagonal")
    new = F.col("phrase") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > gap, F.lit(True))
    runs = summed.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(line))
    spans = runs.groupBy(*keys, "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("met"), F.min("diagonal").alias("start"))
    share = F.col("met") / F.col("grams")
    base = F.col("phrase") & (share == 1.0)
    found = base | (~F.col("phrase") & (share >= least_share))
    per = spans.groupBy("uid", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(found, share)), F.lit(0.0)).alias("score"),
    )
    return per.drop("uid")
