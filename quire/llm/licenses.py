"""License scans: MinHash bands over overlapping windows of a text retrieve templates, exact shingle containment verifies them.

A text's words (runs of letters and digits, in lower case) give five-word shingles. A template of up to 32 shingles is
looked for as a whole, a longer one by pieces of 32. For each size class L (2, 4, ... 32; a template or piece has more than L / 2
shingles, or is of the smallest class) the text is covered by windows of 2 L shingles every L, so that any L shingles in a row lie
within one. Each of `bands` bands has one hash function, the shingle's XXH64 xor a constant, and its smallest value as the key.
A window that holds the share `containment` of a template has a Jaccard similarity of at least 0.8 (L / 2) / (2 L + 0.1 L) = 0.19 with it,
and misses all of 24 bands with a probability of 0.6 % at most (0.99 ** n for most sizes, as few templates are that small for
their class). What is retrieved is verified by the shingles themselves over the text around the window. All of it is
DataFrame functions on the row of a document, without a shuffle of texts; templates are a parameter and bounded by it.

Texts that are null, empty or of fewer than five words match nothing. Rows with equal keys count as one document, and so do all
rows with a null key. Only `key` and `text` are read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import picked
from quire.llm.hosts import _with

WORDS, CONTAINMENT, BANDS = 5, 0.8, 24
CLASSES = (2, 4, 8, 16, 32)

#: Notices of public licenses.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: Column, start: Column, stop: Column, make) -> Column:
    """make() of the shingles that start at words from `start` up to before `stop`; none if the text is too short."""
    last = F.least(stop, F.size(words) - (WORDS - 1)) - 1
    return F.when(last >= start, F.transform(F.sequence(start, last), lambda i: make([F.get(words, i + j) for j in range(WORDS)])))


def _hashes(words: Column) -> Column:
    return F.coalesce(_shingles(words, F.lit(0), F.size(words), lambda w: F.xxhash64(*w)), F.array().cast("array<bigint>"))


def _strings(words: Column, start: Column, stop: Column) -> Column:
    return F.array_distinct(_shingles(words, start, stop, lambda w: F.concat_ws(" ", *w)))


def band_constants(bands: int) -> list[int]:
    """A constant for each band; their upper bits differ, so that bands look at different ends of the hashes."""
    found, x = [], 1
    for i in range(bands):
        x = x * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        upper = i * (1 << 64) // bands
        found.append((upper + (x >> 8)) % (1 << 64) - (1 << 63))
    return found


def compiled(spark, templates: dict[str, str], bands: int) -> tuple[list[tuple], dict[str, tuple[list[str], int]]]:
    """Of all templates, the rows (class, band, key, name), and of each its shingles and how many words it has."""
    rows = spark.createDataFrame([*templates.items()], "name string, t string").withColumn("w", license_words(F.col("t")))
    found = rows.select("name", F.size("w").alias("n"), _hashes(F.col("w")).alias("h"), _strings(F.col("w"), F.lit(0), F.size("w")).alias("s")).collect()
    keys, known = set(), {}
    for name, n, h, s in found:
        if not h:
            raise ValueError(f"template {name} has fewer than {WORDS} words")
        known[name] = (s, n)
        top = CLASSES[-1]
        for piece in [h] if len(h) <= top else [h[min(i, len(h) - top) :][:top] for i in range(0, len(h), top)]:
            size = next(c for c in CLASSES if len(piece) <= c)
            keys |= {(size, band, min(x ^ c for x in piece), name) for band, c in enumerate(band_constants(bands))}
    return sorted(keys), known


def _flipped(hashes: str, constant: int) -> Column:
    return F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(constant)))


def _finder(band: int, values: dict[int, list[int]]):
    """From a band's hashes of all shingles: the windows of each size class whose smallest is one of a template's keys."""

    def of_size(p: Column, size: int, keys: list[int]) -> Column:
        least = lambda s: F.array_min(F.slice(p, s + 1, 2 * size))
        every = F.when(F.size(p) > 0, F.sequence(F.lit(0), F.size(p) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(every, lambda s: least(s).isin(keys))
        return F.transform(starts, lambda s: F.struct(F.lit(size).alias("size"), F.lit(band).alias("band"), least(s).alias("value"), s.alias("at")))

    return lambda p: F.concat(*(of_size(p, size, keys) for size, keys in values.items()))


def matches(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """`key`, license, n_found, n_shingles: of each document, the templates of whose distinct shingles it holds the share `containment` or more near a place."""
    spark = docs.sparkSession
    keys, known = compiled(spark, TEMPLATES if templates is None else templates, bands)
    constants = band_constants(bands)
    # A key can only be the smallest of windows that hold its shingle, so other texts need no windows. The row numbers keep
    # Spark from working hashes and hits out again in filters of its own.
    chosen = F.lit(sorted({v ^ constants[b] for _, b, v, _ in keys}))
    rows = picked(docs, key, text).select("k", license_words(F.col("t")).alias("w"))
    rows = rows.select("k", "w", _hashes(F.col("w")).alias("h"), F.monotonically_increasing_id().alias("row")).filter(F.arrays_overlap("h", chosen) & (F.col("row") >= 0))
    hits = []
    for band, constant in enumerate(constants):
        values = {size: [v for s, b, v, _ in keys if (s, b) == (size, band)] for size in sorted({s for s, *_ in keys})}
        hits.append(_with(_flipped("h", constant), _finder(band, values)))
    numbered = rows.select("k", "w", F.concat(*hits).alias("hits"), F.monotonically_increasing_id().alias("row"))
    hit = numbered.filter("row >= 0").select("k", "w", F.explode("hits").alias("hit")).select("k", "w", "hit.*")
    table = spark.createDataFrame(keys, "size int, band int, value long, name string")
    shingles = spark.createDataFrame([(n, s, m) for n, (s, m) in known.items()], "name string, s array<string>, n int")
    retrieved = hit.join(F.broadcast(table), ["size", "band", "value"]).join(F.broadcast(shingles), "name")  # both are as large as the templates
    around = _strings(F.col("w"), F.greatest(F.col("at") - F.col("n"), F.lit(0)), F.col("at") + 2 * F.col("size") + F.col("n"))
    verified = retrieved.select("k", "name", F.size(F.array_intersect(around, "s")).cast("long").alias("n_found"), F.size("s").cast("long").alias("n_shingles"))
    out = verified.filter(F.col("n_found") >= F.lit(containment) * F.col("n_shingles")).groupBy("k", "name", "n_shingles").agg(F.max("n_found").alias("n_found"))
    return out.select(F.col("k").alias(key), F.col("name").alias("license"), "n_found", "n_shingles")
