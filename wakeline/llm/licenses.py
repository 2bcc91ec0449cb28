"""License scans. DataFrame functions only.

Texts are cut into overlapping windows a little longer than a template, MinHash bands of the windows' five-word shingles
retrieve templates, and exact containment of the template's shingles in the window verifies the match.

With BANDS bands of ROWS samples, a window that contains a whole template is retrieved for sure or nearly so, and
one at the threshold of containment (Jaccard similarity about 0.64) with probability 1 - (1 - 0.64**2)**24 > 0.99999.

Only windows around anchor words are made. Anchors are words of a template that more than a fifth of its shingles
hold, so that no window without one can contain four fifths of the shingles: nothing is lost by it.

Windows of a template of m words begin at multiples of s = max(1, m // 8) and have m + s - 1 words, so every run of m words
lies in one. Words are runs of 0-9, a-z after lower-casing A-Z.

Defined results: null and empty texts match nothing; equal containments go to the first window; repeated rows are one
row of the result, with their id (a null id is an id); an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stage

SHINGLE_WORDS, PERCENT = 5, 80
BANDS, ROWS = 24, 2

#: Notices of public licences, by name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    import re

    return re.findall("[0-9a-z]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def template_shingles(words: list[str]) -> list[str]:
    size = min(SHINGLE_WORDS, len(words))
    return list(dict.fromkeys(" ".join(words[i : i + size]) for i in range(len(words) - size + 1)))


def anchors(shingles: list[str]) -> list[str]:
    """Words such that shingles without any are too few to reach the threshold, long words first."""
    need = len(shingles) - -(-len(shingles) * PERCENT // 100) + 1
    chosen: list[str] = []
    held: set[int] = set()
    for word in sorted({w for s in shingles for w in s.split()}, key=lambda w: (-len(w), w)):
        if len(held) >= need:
            break
        more = {i for i, s in enumerate(shingles) if word in s.split()} - held
        if more:
            chosen.append(word)
            held |= more
    return chosen


def _strings(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, n_shared, containment, start_word: the best window of every document and template that match.

    Templates need SHINGLE_WORDS words at least.
    """
    spark = docs.sparkSession
    known = {name: template_words(text) for name, text in templates.items()}
    if not known or min(map(len, known.values())) < SHINGLE_WORDS:
        raise ValueError(f"templates need {SHINGLE_WORDS} words")
    by_size: dict[int, list[str]] = {}
    for name, words in known.items():
        by_size.setdefault(len(words), []).append(name)
    of_size = {m: sorted({a for n in names for a in anchors(template_shingles(known[n]))}) for m, names in by_size.items()}
    every = sorted({a for x in of_size.values() for a in x})

    lower = F.translate(F.col(text_col), _UPPER, _LOWER)
    texts = docs.select(F.col(id_col).alias("doc_id"), lower.alias("text"))
    has = F.lit(False)
    for a in every:
        has = has | F.col("text").contains(a)
    words = texts.filter(has).select("doc_id", F.regexp_extract_all("text", F.lit("[0-9a-z]+"), F.lit(0)).alias("w"))
    hits = words.withColumn("at", F.expr(f"filter(transform(w, (x, i) -> if(array_contains({_strings(every)}, x), i, -1)), i -> i >= 0)")).filter("size(at) > 0")
    # of each size, the numbers of the windows that hold an anchor of that size's templates
    starts = []
    for m, own in of_size.items():
        s = max(1, m // 8)
        size = m + s - 1
        near = f"transform(filter(at, p -> array_contains({_strings(own)}, w[p])), p -> sequence(greatest(0, (p - {size} + 1 + {s - 1}) div {s}), p div {s}))"
        starts.append(f"transform(array_distinct(flatten({near})), g -> named_struct('m', {m}, 'start', cast(g * {s} as int), 'size', {size}))")
    windows = hits.select("doc_id", "w", F.explode(F.expr(f"concat({', '.join(starts)})")).alias("x")).select("doc_id", "x.m", "x.start", F.expr("slice(w, x.start + 1, x.size)").alias("w"))
    grams = f"array_distinct(transform(sequence(1, size(w) - {SHINGLE_WORDS - 1}), i -> concat_ws(' ', slice(w, i, {SHINGLE_WORDS}))))"
    cut = windows.filter(F.size("w") >= SHINGLE_WORDS).select("doc_id", "m", "start", F.expr(grams).alias("grams"))
    own = " ".join(f"when {m} then {_strings(sorted({g for n in names for g in template_shingles(known[n])}))}" for m, names in by_size.items())
    cut = cut.filter(F.expr(f"arrays_overlap(grams, case m {own} end)")).distinct()

    def banded(df: DataFrame) -> DataFrame:
        hashes = df.withColumn("h", F.expr("transform(grams, g -> xxhash64(g))"))
        sampled = hashes.withColumn("least", F.expr(f"transform(sequence(1, {BANDS * ROWS}), k -> array_min(transform(h, x -> xxhash64(k, x))))"))
        keys = f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(m, b, {', '.join(f'least[b * {ROWS} + {r}]' for r in range(ROWS))}))"
        return sampled.withColumn("key", F.explode(F.expr(keys))).drop("h", "least")

    named = spark.createDataFrame([(n, len(w), template_shingles(w)) for n, w in known.items()], "license string, m int, grams array<string>")
    # as many rows as templates times bands
    wanted = banded(named).select(F.col("m").alias("of"), "license", F.col("grams").alias("wanted"), "key")
    found = banded(cut).join(F.broadcast(wanted), "key").filter("m = of").select("doc_id", "start", "license", "grams", "wanted").distinct()
    shared = found.withColumn("n_shared", F.size(F.array_intersect("grams", "wanted"))).withColumn("n", F.size("wanted")).filter(f"100 * n_shared >= {PERCENT} * n")
    best = shared.groupBy("doc_id", "license").agg(F.max(F.struct("n_shared", (-F.col("start")).alias("minus"), "n")).alias("x"))
    return best.select("doc_id", "license", F.col("x.n_shared").cast("long").alias("n_shared"), (F.col("x.n_shared") / F.col("x.n")).alias("containment"), (-F.col("x.minus")).cast("long").alias("start_word"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _values() -> str:
    rows = []
    for name, text in TEMPLATES.items():
        w = template_words(text)
        rows += [f"('{name}', {len(w)}, '{g}', {len(template_shingles(w))})" for g in template_shingles(w)]
    return ", ".join(rows)


OP8_SQL = f"""
WITH templates_(license, m, g, n) AS (VALUES {_values()}),
words_ AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z]+') AS w FROM documents),
grams_ AS (SELECT doc_id, unnest(range(0, len(w) - {SHINGLE_WORDS - 1})) AS p, w FROM words_ WHERE len(w) >= {SHINGLE_WORDS}),
hits_ AS (SELECT DISTINCT d.doc_id, t.license, t.m, greatest(1, t.m // 8) AS s, t.n, t.g, d.p FROM (SELECT doc_id, p, list_aggregate(w[p + 1:p + {SHINGLE_WORDS}], 'string_agg', ' ') AS g FROM grams_) d JOIN templates_ t ON t.g = d.g),
windows_ AS (SELECT *, unnest(range(greatest(0, CAST(ceil((p + {SHINGLE_WORDS} - (m + s - 1)) / s::DOUBLE) AS BIGINT)), p // s + 1)) AS k FROM hits_),
shared_ AS (SELECT doc_id, license, n, k * s AS start_word, count(DISTINCT g) AS n_shared FROM windows_ GROUP BY doc_id, license, n, k * s),
best_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY n_shared DESC, start_word) AS r FROM shared_ WHERE 100 * n_shared >= {PERCENT} * n)
SELECT doc_id, license, n_shared, n_shared / n::DOUBLE AS containment, start_word FROM best_ WHERE r = 1
"""
