"""License scans by diagonal voting.

All rolling hashes of ``K`` words of every text are joined to the places of the templates'
hashes (and the words of a hit compared, so equal hashes alone prove nothing). A hit at word p
of a text and word t of a template votes for the diagonal p - t. Diagonals are aggregated with
the template's places they cover; neighbouring ones, at most ``SLACK`` of the template's length
apart, are merged, since words put in or left out shift the rest of a notice. A merged diagonal
is a license span if it covers at least ``COVERED`` of the template's windows and is not much
longer than the template.

The phrases are templates too. Theirs must be covered whole on one diagonal and never merge:
each such diagonal is one place where the phrase stands.

NULL text counts as empty. A text is told by its id and 128 hash bits: rows equal in both get
equal results, one each. Votes are combined before they are shuffled, and a group is one text's
votes for one template. The templates are the caller's list, so their table is small and is
broadcast. An id column of any type will do; other columns are left behind.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracktally.llm.common import add_columns, exact, saved, texts_of

#: Words of a rolling hash; no template may be shorter.
K = 3
COVERED = 0.5
#: Share of a template's words by which neighbouring diagonals may be apart.
SLACK = 0.1
#: A span may be so many times as long as its template.
LONGEST = 1.5
#: Places of a template that one vote's mask holds.
MASK_BITS = 60
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Odd factors of the words of a rolling hash.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Template(NamedTuple):
    label: str
    text: str
    phrase: bool = False


# The phrases and labels of the base.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)

# Sentences of public licenses and of the notices that name them.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("mit", "Released under the MIT License"),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_in(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


def rolling(words: list[str]) -> np.ndarray:
    """A hash for each window of K words."""
    if len(words) < K:
        return np.zeros(0, np.int64)
    hashed = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = len(words) - K + 1
    mark = np.zeros(n, np.uint64)
    for i in range(K):
        mark += hashed[i : i + n] * FACTORS[i]
    return (mark ^ (mark >> np.uint64(29))).view(np.int64)


def template_places(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """``template, label, phrase, length, slack, place, window, mark``, a row for each window of K words."""
    rows = []
    for i, t in enumerate(templates):
        words = words_in(t.text)
        if len(words) < K:
            raise ValueError(f"a template of under {K} words: {t.text!r}")
        slack = 0 if t.phrase else max(1, int(SLACK * len(words)))
        rows += [(i, t.label, t.phrase, len(words), slack, p, words[p : p + K], m) for p, m in enumerate(rolling(words).tolist())]
    return spark.createDataFrame(
        rows, "template int, label string, phrase boolean, length int, slack int, place int, window array<string>, mark long"
    )


def hits(docs: DataFrame, places: DataFrame, id: str, text: str) -> DataFrame:
    """``id, a, b, n_words``, once for each row with NULL template, and once for each hit."""
    plain = F.coalesce(exact(text), F.lit(""))
    base = docs.select(exact(id).alias("id"), F.xxhash64(plain).alias("a"), F.xxhash64(F.lit(1), plain).alias("b"), plain.alias("text"))

    def make():
        def run(column):
            words = [words_in(t) for t in texts_of(column)]
            marks = [rolling(w) for w in words]
            offsets = np.r_[0, np.cumsum([len(m) + 1 for m in marks])]
            # the first entry, without a hash, stands for the row
            flat = pa.array(np.concatenate([x for m in marks for x in (np.zeros(1, np.int64), m)] or [np.zeros(0, np.int64)]))
            return [words, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)]

        return run

    marked = add_columns(base, ["text"], "words array<string>, marks array<long>", make)
    each = marked.select("id", "a", "b", "words", F.size("words").cast("long").alias("n_words"), F.posexplode("marks").alias("nth", "mark"))
    met = each.join(F.broadcast(places), (each["mark"] == places["mark"]) & (each["nth"] > 0), "left")
    same = F.slice("words", F.greatest("nth", F.lit(1)), K) == F.col("window")
    return met.where((F.col("nth") == 0) | (F.col("template").isNotNull() & same)).select(
        "id", "a", "b", "n_words", "template", "place", (F.col("nth") - 1 - F.col("place")).alias("diagonal")
    )


def license_spans(found: DataFrame, places: DataFrame) -> DataFrame:
    """``id, a, b, label, phrase, start, end, score``: verified spans, from the hits."""
    about = places.select("template", "label", "phrase", "length", "slack").distinct()
    doc = ["id", "a", "b", "template"]
    votes = (
        found.where("template is not null")
        .groupBy(*doc, "diagonal", F.floor(F.col("place") / MASK_BITS).alias("part"))
        .agg(
            F.bit_or(F.expr(f"shiftleft(1L, place % {MASK_BITS})")).alias("mask"),
            F.min("place").alias("low"),
            F.max("place").alias("high"),
        )
        .join(F.broadcast(about), "template")
    )
    along = Window.partitionBy(*doc).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.col("slack")
    marked = votes.withColumn("new", F.coalesce(apart, F.lit(False)).cast("int"))
    merged = marked.withColumn("run", F.sum("new").over(along))
    covered = (
        merged.groupBy(*doc, "run", "part", "label", "phrase", "length")
        .agg(
            F.bit_or("mask").alias("mask"),
            F.min(F.col("diagonal") + F.col("low")).alias("start"),
            F.max(F.col("diagonal") + F.col("high") + K).alias("end"),
        )
        .groupBy(*doc, "run", "label", "phrase", "length")
        .agg(F.sum(F.bit_count("mask")).alias("windows"), F.min("start").alias("start"), F.max("end").alias("end"))
        .withColumn("score", F.col("windows") / (F.col("length") - (K - 1)))
    )
    whole = F.col("score") >= F.when(F.col("phrase"), 1.0).otherwise(COVERED)
    return covered.where(whole & (F.col("end") - F.col("start") <= LONGEST * F.col("length"))).select(
        "id", "a", "b", "label", "phrase", F.col("start").cast("long"), F.col("end").cast("long"), "score"
    )


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text", notices: Sequence[Template] = NOTICES) -> DataFrame:
    """``id, n_words, spans`` of every row; spans hold label, phrase, start, end (words) and score, by start."""
    places = template_places(docs.sparkSession, [*PHRASES, *notices])
    found = saved(hits(docs, places, id, text), "license-hits")
    spans = license_spans(found, places).groupBy(F.col("id").alias("i"), "a", "b").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "label", "phrase", "score"))).alias("spans")  # one text's
    )
    rows = found.where("template is null").select("id", F.col("a").alias("x"), F.col("b").alias("y"), "n_words")
    match = F.col("id").eqNullSafe(F.col("i")) & (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))
    none = F.array().cast("array<struct<start: bigint, end: bigint, label: string, phrase: boolean, score: double>>")
    return rows.join(spans, match, "left").select(F.col("id").alias(id), "n_words", F.coalesce("spans", none).alias("spans"))
