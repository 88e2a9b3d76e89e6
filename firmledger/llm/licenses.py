"""Licence notices in documents, found by MinHash bands over text windows and verified exactly (operator 3), native only.

Texts and templates are lower-cased words of letters and digits; a shingle is five words. Windows of 8, 16, 32 and 64 shingles
overlap by half, and each template belongs to the smallest size of which one window must hold it whole (longer templates are
cut into parts of that kind). A window's MinHash values, one per band, are joined with those of the templates. How many bands
a size needs follows from the lowest Jaccard similarity j that a window holding ``SIMILAR`` of a template can have: the chance
that no band agrees, (1 - j) ** bands, stays below ``MISS``. Joined templates are verified by exact containment of their
shingles in the document.

A window without a single shingle of any template has similarity 0 with all of them, so only windows around such shingles get
MinHash values; nothing that could match is skipped. The template table has a row per band and is bounded by the template list.

A null, empty or very short text matches nothing. Repeated rows give one row per licence; ties between licences are all
returned; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import with_stage

# Wording of public licence notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "mit-line": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software."
    ),
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
SHINGLE, SIMILAR, MISS = 5, 0.8, 1e-4
SIZES = (8, 16, 32, 64)


def shingles(text: Column | str) -> Column:
    """Hashes of all five-word windows of a text of normalised words held as an array."""
    return F.transform(
        F.when(F.size(text) >= SHINGLE, F.sequence(F.lit(0), F.size(text) - SHINGLE)).otherwise(F.array().cast("array<int>")),
        lambda at: F.xxhash64(*[F.get(text, at + k) for k in range(SHINGLE)]),
    )


def normal_words(text: Column | str) -> Column:
    plain = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.array_remove(F.split(plain, r"[^\p{L}\p{N}]+"), "")


def class_of(count: int) -> int:
    """Smallest window size of which one window, at steps of half a size, holds ``count`` shingles whole."""
    return next((size for size in SIZES if count <= size // 2 + 1), SIZES[-1])


def bands_of(size: int) -> int:
    """Bands that a window size needs."""
    smallest = 1 if size == SIZES[0] else size // 4 + 2
    shared = SIMILAR * smallest if smallest > 1 else 1.0
    return math.ceil(math.log(MISS) / math.log(1 - shared / (size + smallest - shared)))


def minhash(window: Column, bands: int) -> Column:
    """One value per band: the smallest of the shingles' hashes under the band's seed, hashed with its number."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(bands)),
        lambda band: F.xxhash64(band, F.array_min(F.transform(window, lambda s: F.xxhash64(s, band)))),
    )


def template_tables(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Shingles of each template (license, template), and band values of its parts (license, size, band)."""
    rows = spark.createDataFrame([], "license string, text string")
    if templates:
        listed = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in templates.items()])
        rows = spark.range(1).select(F.inline(listed))
    rows = rows.withColumn("words", normal_words("text")).select("license", shingles(F.col("words")).alias("all")).where(F.size("all") > 0)
    whole = rows.select("license", F.array_distinct("all").alias("template"))
    parts = None
    last = SIZES[-1] // 2 + 1
    for below, size in zip((0, *SIZES), SIZES, strict=False):
        fits = (F.size("all") > (below // 2 + 1 if below else 0)) & (F.size("all") <= size // 2 + 1)
        own = rows.where(fits).select("license", F.col("all").alias("part"))
        if size == SIZES[-1]:
            starts = F.sequence(F.lit(1), F.size("all") - last + 1, F.lit(last // 2))
            long = rows.where(F.size("all") > last)
            own = own.union(long.select("license", F.explode(F.transform(starts, lambda at: F.slice("all", at, F.lit(last)))).alias("part")))
        own = own.select("license", F.lit(size).alias("size"), F.explode(minhash(F.col("part"), bands_of(size))).alias("band"))
        parts = own if parts is None else parts.union(own)
    return whole, parts.distinct()


def license_notices(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per document and licence found: doc_id, license, containment."""
    spark = docs.sparkSession
    whole, bands = template_tables(spark, templates)
    # Bounded by the template list: some hundred numbers.
    listed = sorted({hash_ for row in whole.select("template").collect() for hash_ in row["template"]})
    known = F.array(*map(F.lit, listed)).cast("array<bigint>")
    rows = docs.select("doc_id", normal_words(F.col("text").cast("string")).alias("words"))
    rows = with_stage(rows, "all", shingles(F.col("words"))).select("doc_id", "all")
    rows = rows.where(F.arrays_overlap(F.col("all"), known))
    rows = with_stage(rows, "near", F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda at: F.array_contains(known, F.get("all", at))))
    rows = rows.withColumn("hits", F.array_intersect(F.col("all"), known))
    found = None
    for size in SIZES:
        step = size // 2
        # A shingle at place p lies in the windows that start at the steps at and before p.
        starts = F.array_distinct(F.flatten(F.transform("near", lambda at: F.array((at / step).cast("int"), F.greatest((at / step).cast("int") - 1, F.lit(0))))))  # noqa: B023
        own = rows.select("doc_id", "hits", "all", F.explode(starts).alias("start"))
        window = F.slice("all", F.col("start") * step + 1, F.lit(size))
        own = with_stage(own.select("doc_id", "hits", window.alias("window")), "band", F.lit(size)).drop("band")
        own = own.select("doc_id", "hits", F.lit(size).alias("size"), F.explode(minhash(F.col("window"), bands_of(size))).alias("band"))
        found = own if found is None else found.union(own)
    # The template bands are bounded by the list: a few thousand numbers.
    candidates = found.join(F.broadcast(bands), ["size", "band"]).select("doc_id", "license", "hits").dropDuplicates(["doc_id", "license", "hits"])
    candidates = candidates.join(F.broadcast(whole), "license")
    contained = F.size(F.array_intersect("template", "hits")) / F.size("template")
    return candidates.select("doc_id", "license", contained.alias("containment")).where(F.col("containment") >= SIMILAR).distinct()


def oracle_sql(templates: dict[str, str] = TEMPLATES) -> str:
    """The same containment of every template in every document, stated without windows, bands or hashes."""
    values = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in templates.items())
    split = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    grams = f"list_transform(range(1, greatest(len(words) - {SHINGLE - 2}, 1)), lambda i: list_slice(words, i, i + {SHINGLE - 1}))"
    return f"""
WITH t AS (SELECT license, unnest({grams}) AS shingle FROM (SELECT license, {split} AS words FROM (VALUES {values}) v(license, text)) x),
tt AS (SELECT DISTINCT license, shingle FROM t),
n AS (SELECT license, count(*) AS size FROM tt GROUP BY license),
d AS (SELECT DISTINCT doc_id, text, unnest({grams}) AS shingle FROM (SELECT doc_id, text, {split} AS words FROM documents) x),
m AS (SELECT d.doc_id, d.text, license, count(*) AS shared FROM d JOIN tt USING (shingle) GROUP BY d.doc_id, d.text, license)
SELECT DISTINCT doc_id, license, shared::DOUBLE / size AS containment FROM m JOIN n USING (license) WHERE shared::DOUBLE / size >= {SIMILAR}
"""
