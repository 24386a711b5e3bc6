"""License scans by diagonal voting (DataFrame functions only).

Every run of k words of a text is hashed and joined with the runs of k words of the license
templates. A match at word p of the text and word t of a template votes for the diagonal p - t. Diagonals
of one template that lie close together are merged, and a merged span is verified by the share of the
template's words that the text really has at those places.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a run: short phrases vote by pairs, whole notices by fours.
SHORT, LONG = 2, 4
#: Templates of at least this many words vote by fours.
LONG_WORDS = 12
#: Most rows of a run table that is broadcast; a row is below 200 bytes.
BROADCAST_RUNS = 100_000
#: Share of a template's words that a span needs.
COVERAGE = 0.7

# Phrases whose places are counted, and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Short references and the opening words of well-known notices.
NOTICES = [
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under cc by 4", "cc-by"),
    ("creative commons attribution", "cc-by"),
    ("mozilla public license", "mpl"),
    ("bsd license", "bsd"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "mit",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "bsd",
    ),
    (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "apache",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        "gpl",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
]


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def templates_table(spark: SparkSession, templates: list[tuple[str, str, bool]]) -> DataFrame:
    """``(template, label, base, k, size, at, words)``: the runs of k words of templates ``(text, label, base)``.

    A template of one word votes by that word alone.
    """
    rows = []
    for i, (text, label, base) in enumerate(templates):
        words = template_words(text)
        k = LONG if len(words) >= LONG_WORDS else min(SHORT, len(words))
        for at in range(len(words) - k + 1 if words else 0):
            rows.append((i, label, base, k, len(words), at, words[at : at + k]))
    return spark.createDataFrame(rows, "template int, label string, base boolean, k int, size int, at int, run array<string>")


def words_of(text: Column) -> Column:
    """Words of digits, a-z and characters beyond ASCII, A-Z lowered.

    ``lower`` is far cheaper than ``translate`` and only differs in words with characters beyond ASCII, except for
    the two characters that it turns into ASCII letters.
    """
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce(text, F.lit(""))
    odd = text.contains("\u0130") | text.contains("\u212a")
    return F.array_remove(F.split(F.when(odd, F.translate(text, upper, low)).otherwise(F.lower(text)), SEPARATORS), "")


def scan_licenses(
    docs: DataFrame, templates: DataFrame, *, row: str = "doc_id", text: str = "text", coverage: float = COVERAGE
) -> DataFrame:
    """``(<row>, n_words, spans, best)`` for every row of ``docs``.

    ``spans``: verified spans as structs ``(first_word, last_word, label, base, template, score)``, sorted; ``score`` is the
    share of the template's words found there, which has to be all of a short template and ``coverage`` of a long one.
    ``best`` is the highest share anywhere, verified or not. A null or empty text has no words, no span and 0. Rows with equal
    values each give a row; a null row id stays null. Other columns are not read. Without templates no row has a span.

    A vote needs equal words, not only equal hashes. The run table is broadcast when it is counted to have at most
    ``BROADCAST_RUNS`` rows; beyond that the join shuffles. With it, only votes and one row for each text are shuffled.
    """
    ks = sorted(r[0] for r in templates.select("k").distinct().collect()) or [SHORT]
    source = docs.select(
        F.monotonically_increasing_id().alias("place"), F.col(row).alias("row"), words_of(F.col(text)).alias("words")
    ).withColumn("n", F.size("words"))
    names = [f"w{j}" for j in range(LONG)]
    # Word p and those after it, side by side; the first entry has none and carries the row itself through the join.
    blank = F.array(F.lit(None).cast("string"))
    shifted = [F.concat(blank, F.slice("words", j + 1, F.col("n"))) for j in range(LONG)]
    at = source.select("place", "row", "n", *(s.alias(name) for s, name in zip(shifted, names)))
    at = at.select("place", "row", "n", F.posexplode(F.arrays_zip(*names)).alias("p", "w"))
    at = at.select("place", "row", "n", (F.col("p") - 1).alias("p"), "w.*")
    runs = [F.when(F.col(names[k - 1]).isNotNull(), F.xxhash64(F.lit(k), *names[:k])) for k in ks]
    grams = at.select("*", F.posexplode(F.array(*runs)).alias("which", "gram")).filter("gram IS NOT NULL OR (p < 0 AND which = 0)")
    word = lambda j: F.get("run", F.lit(j))
    # Nulls do not change this hash, so a run of k words hashes as the text's.
    wanted = templates.select(
        "template", "label", "base", "k", "size", "at",
        F.xxhash64(F.col("k"), *map(word, range(LONG))).alias("wanted"), *(word(j).alias(f"t{j}") for j in range(LONG)),
    )
    if templates.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS:
        wanted = F.broadcast(wanted)
    agree = F.col("gram") == F.col("wanted")
    for j in range(LONG):
        agree = agree & (F.col(f"t{j}").isNull() | (F.col(names[j]) == F.col(f"t{j}")))
    votes = (
        grams.join(wanted, agree, "left")
        .filter("template IS NOT NULL OR p < 0")
        .select("place", "row", "n", "template", "label", "base", "k", "size", (F.col("p") - F.col("at")).alias("diagonal"), "at")
        .repartition("place")
    )
    same = ["place", "row", "n", "template", "label", "base", "k", "size"]
    diagonals = votes.groupBy(*same, "diagonal").agg(F.collect_list("at").alias("at"))
    # Diagonals a few words apart are one place with words put in or left out; short templates take no such liberty.
    order = Window.partitionBy("place", "template").orderBy("diagonal")
    slack = F.when(F.col("size") >= LONG_WORDS, F.col("size") / 10).otherwise(0)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > slack, F.lit(True))
    diagonals = diagonals.withColumn("apart", apart.cast("int")).withColumn("cluster", F.sum("apart").over(order))
    covered = F.flatten(F.transform("at", lambda a: F.sequence(a, a + F.col("k") - 1)))
    clusters = (
        diagonals.withColumn("covered", covered)
        .groupBy(*same, "cluster")
        .agg(
            F.min(F.col("diagonal") + F.array_min("covered")).alias("first_word"),
            F.max(F.col("diagonal") + F.array_max("covered")).alias("last_word"),
            F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("found"),
        )
        .withColumn("score", F.when(F.col("template").isNotNull(), F.col("found") / F.col("size")))
    )
    enough = F.col("score") >= F.when(F.col("size") >= LONG_WORDS, F.lit(coverage)).otherwise(1.0)
    span = F.struct("first_word", "last_word", "label", "base", "template", "score")
    return (
        clusters.groupBy("place", "row", "n")
        .agg(
            F.array_sort(F.collect_list(F.when(enough, span))).alias("spans"), F.coalesce(F.max("score"), F.lit(0.0)).alias("best")
        )
        .select(F.col("row").alias(row), F.col("n").cast("bigint").alias("n_words"), "spans", "best")
    )
