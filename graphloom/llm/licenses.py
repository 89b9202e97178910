"""License scan with native column expressions only.

Texts and templates become sequences of 5-word shingles (A-Z lower-cased, signs taken as spaces).
Templates are grouped by size s, the power of two from their shingle count. For each size, a text
is covered by overlapping windows of 2 s shingles, one every s, so an occurrence lies whole in one.
A window that holds a template at the threshold t has a Jaccard similarity of at least
t * (s / 2) / (2 s) = 0.2 with it; with BANDS = 40 bands of one MinHash row each, the chance that
they share a band is at least 1 - 0.8 ** 40 = 0.9998 (and 1 - 0.6 ** 40 from half a window on).
Windows and templates that share a band are verified by exact shingle containment.

A template shorter than 5 words is one shingle of its own length, and texts are shingled at that
length too; its windows are made, banded and verified like the others. A template without words is an error.

Only windows that hold some template shingle are hashed: others contain nothing of any template.

The template table is a parameter of bounded size (``MAX_TEMPLATE_SHINGLES``), not data.

Null or empty texts match nothing; repeated rows with one doc_id (rows without one are taken as one
document) give one row per license. Very long texts are windowed whole; an empty table gives an empty
result; other columns are not read. Ties between windows go to the first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .quality import let

WIDTH = 5
THRESHOLD = 0.8
BANDS = 40
MAX_TEMPLATE_SHINGLES = 20_000

#: Wording of public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "all-rights-reserved": "Unauthorized copying of this file via any medium is strictly prohibited",
}

#: Further wordings of licenses, too short for a shingle of WIDTH words.
NOTICES = {"all-rights-reserved": "All rights reserved"}

_SIGNS = "\t\n\x0b\x0c\r.,;:!?\"'()[]{}<>*#/\\|_=+-"


def words(text: Column) -> Column:
    """The words of a text; one empty word for a text without words."""
    return F.split(F.btrim(F.translate(F.lower(F.coalesce(text, F.lit(""))), _SIGNS, " " * len(_SIGNS)), F.lit(" ")), " +")


def shingles(w: Column, width: int = WIDTH) -> Column:
    """Hashes of the ``width``-word shingles of an array of words, in order."""
    return F.when(F.size(w) < width, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(width)))))


def minhash(values: Column) -> Column:
    """BANDS minima of an array of hashes, each under its own hash function."""

    def least(seed: int) -> Column:
        return F.array_min(F.transform(values, lambda x: F.xxhash64(x, F.lit(seed))))

    return F.array(*(least(seed) for seed in range(BANDS)))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """``(license, width, size, n_template, elements, bands)`` of each template."""
    total = sum(len(re.findall(r"\S+", t)) for _, t in templates)
    if total > MAX_TEMPLATE_SHINGLES:
        raise ValueError(f"{total} words of templates; the bound is {MAX_TEMPLATE_SHINGLES}")
    if empty := [name for name, t in templates if not t.translate(str.maketrans(_SIGNS, " " * len(_SIGNS))).strip(" ")]:
        raise ValueError(f"templates without words: {empty}")
    table = spark.createDataFrame(sorted(templates), "license string, text string").withColumn("words", words(F.col("text")))
    table = table.withColumn("width", F.least(F.size("words"), F.lit(WIDTH)))
    own = F.coalesce(*(F.when(F.col("width") == k, shingles(F.col("words"), k)) for k in range(1, WIDTH + 1)))
    table = table.select("license", "width", F.array_distinct(own).alias("elements")).withColumn("n_template", F.size("elements"))
    size = F.pow(F.lit(2), F.ceil(F.log2("n_template"))).cast("int")
    return table.withColumn("size", size).withColumn("bands", minhash(F.col("elements")))


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, license, n_template, n_shared, containment, first_shingle)``: the best window of
    each license found in each document (``templates`` None: TEMPLATES and NOTICES)."""
    spark = docs.sparkSession
    known = template_table(spark, list(templates.items()) if templates else [*TEMPLATES.items(), *NOTICES.items()])
    # Bounded by MAX_TEMPLATE_SHINGLES: literals of the plan.
    rows = known.select("width", "size", "elements").collect()

    def covering(h: Column, common: Column, sizes: list[int]) -> Column:
        """The windows of these sizes that hold a template shingle. Window k of size s begins at
        k * s and ends 2 s later, so position i is in windows i / s and i / s - 1."""
        hits = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(common, x), i)), lambda i: i.isNotNull())

        def of_size(p: Column, s: int) -> Column:
            own = F.transform(p, lambda i: F.floor(i / s).cast("int"))
            numbers = F.array_distinct(F.concat(own, F.filter(F.transform(own, lambda k: k - 1), lambda k: k >= 0)))
            return F.transform(numbers, lambda k: F.struct(F.lit(s).alias("size"), (k * s).alias("start"), F.slice(h, k * s + 1, 2 * s).alias("window")))

        return let(hits, lambda p: F.concat(*(of_size(p, s) for s in sizes)))

    none = F.array().cast("array<struct<size:int,start:int,window:array<bigint>>>")

    def of_width(w: Column, width: int) -> Column:
        every = F.array(*(F.lit(x) for x in sorted({x for r in rows if r["width"] == width for x in r["elements"]})))
        sizes = sorted({r["size"] for r in rows if r["width"] == width})
        return let(shingles(w, width), lambda h: let(F.array_intersect(h, every), lambda c: F.when(F.size(c) == 0, none).otherwise(covering(h, c, sizes))))

    widths = sorted({r["width"] for r in rows})
    found = let(words(F.col("text")), lambda w: F.concat(*(of_width(w, k) for k in widths)))
    windows = docs.select("doc_id", F.explode(found).alias("w")).select("doc_id", "w.*")
    banded = windows.select("doc_id", "size", "start", "window", F.posexplode(minhash(F.col("window"))).alias("band", "value"))
    keys = known.select("license", "size", "n_template", "elements", F.posexplode("bands").alias("band", "value"))
    met = banded.join(F.broadcast(keys), ["size", "band", "value"])
    shared = met.withColumn("n_shared", F.size(F.array_intersect("window", "elements")))
    exact = shared.filter(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_template") - 1e-9))
    best = exact.groupBy("doc_id", "license").agg(F.max(F.struct("n_shared", (-F.col("start")).alias("back"), "n_template")).alias("b"))
    return best.select("doc_id", "license", F.col("b.n_template").cast("long").alias("n_template"), F.col("b.n_shared").cast("long").alias("n_shared"), (F.col("b.n_shared") / F.col("b.n_template")).alias("containment"), (-F.col("b.back")).cast("long").alias("first_shingle"))
