"""License scans: MinHash bands retrieve templates for text windows, shingle containment decides.

A template of m shingles is compared with windows of 2m shingles that overlap by half, so one
window holds any occurrence whole. Template and window then have a Jaccard similarity of a half at
least, or nearly so if some words differ. Every band is one minimum: ``bands`` of them miss such a
window with a probability of at most ``(1 - similarity) ** bands``. Only shingles that are the minimum of some
template in some band can make a window collide, so a text without any of them is settled after
one pass over its shingles. What collides is verified on the shingles themselves.

Everything is made of built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices that name a license, as their authors word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-1.0", "made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("Artistic-2.0", "This program is free software; you may redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("Artistic", "licensed under the terms of the Artistic License"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BUSL-1.1", "Use of this software is governed by the Business Source License"),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("WTFPL", "Do What The Fuck You Want To Public License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    *((name, f"SPDX-License-Identifier: {name}") for name in (
        "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
        "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "EPL-1.0", "EPL-2.0",
        "Artistic-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-4.0",
    )),
]
#: Notices of under five words for callers who want them too; the query's SQL counts shingles of five words.
SHORT_TEMPLATES = [("MIT", "MIT License"), *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "ISC", "Zlib", "Unlicense", "WTFPL"))]

WIDTH = 5
BANDS = 24
LEAST = 0.8


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingles_of(text: Column, width: int = WIDTH) -> Column:
    """Shingles of ``width`` words of a text in order, as text; none if there are fewer words."""

    def shingles(words: Column) -> Column:
        count = F.size(words) - (width - 1)
        joined = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(width)])
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), joined)).otherwise(F.array().cast("array<string>"))

    # The words are the only element of an array, which makes them a name: they are split once, not for every shingle.
    return F.get(F.transform(F.array(words_of(text)), shingles), F.lit(0))


def template_table(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``template`` (number), ``license``, ``width``, ``shingles`` (distinct) and ``m``.

    A template of under five words has one shingle of its own length; one without words is an error.
    """
    rows = [(i, name, text) for i, (name, text) in enumerate(templates if templates is not None else TEMPLATES)]
    table = spark.createDataFrame(rows, "template int, license string, text string")
    words = F.size(words_of(F.col("text")))
    no_words = F.raise_error(F.concat(F.lit("no words in the template of "), "license"))
    shingles = F.when(words >= WIDTH, F.array_distinct(shingles_of(F.col("text")))).when(words > 0, F.array(F.concat_ws(" ", words_of(F.col("text")))))
    table = table.select("template", "license", F.least(words, F.lit(WIDTH)).alias("width"), F.when(words == 0, no_words).otherwise(shingles).alias("shingles"))
    return table.withColumn("m", F.size("shingles"))


def _hash(shingle: Column, band: int) -> Column:
    return F.xxhash64(shingle, F.lit(band))


def _minimum(shingles: str, band: int) -> Column:
    return F.array_min(F.transform(shingles, lambda s: _hash(s, band)))


def scan(df: DataFrame, templates: list[tuple[str, str]] | None = None, bands: int = BANDS, least: float = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``license``, ``containment`` and ``first_word`` for every row of ``df`` and license found in it.

    ``containment`` is the largest share of a template's shingles that one window holds, at least ``least``;
    ``first_word`` is where the first window that holds it starts, in words from 0. Null, empty and short texts
    have no windows and no rows; null ids stay null and name one row for all; repeated rows give one row. Of templates of
    one license the best counts. The templates are a bounded list: their tables are
    broadcast. Long texts are cut into windows, each a row of its own.
    """
    table = template_table(df.sparkSession, templates)
    widths = sorted(row["width"] for row in table.select("width").distinct().collect())
    if not widths:
        return df.select(F.col(id_column).cast("long").alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word")).limit(0)
    parts = [_scan(df, table.filter(F.col("width") == width), width, bands, least, id_column, text_column) for width in widths]
    verified = reduce(DataFrame.unionByName, parts)
    return verified.groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), F.min_by("start", F.struct(-F.col("containment"), "start")).alias("first_word")
    )


def _scan(df: DataFrame, table: DataFrame, width: int, bands: int, least: float, id_column: str, text_column: str) -> DataFrame:
    """``doc_id``, ``license``, ``containment`` and ``start`` of every window that holds a template of ``width``-word shingles."""
    minima = table.select("template", "m", "shingles", F.array(*[_minimum("shingles", b) for b in range(bands)]).alias("lows"))
    # A few rows for each template: driver and tasks hold them as literals.
    listed = minima.select(
        "m", F.filter("shingles", lambda s: F.exists(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.get("lows", b) == F.xxhash64(s, b))).alias("picks")
    ).collect()
    picks = sorted({s for row in listed for s in row["picks"]})
    sizes = sorted({row["m"] for row in listed})
    telling = F.array(*[F.lit(p) for p in picks])
    texts = df.select(F.col(id_column).cast("long").alias("doc_id"), shingles_of(F.col(text_column), width).alias("all_shingles"))
    texts = texts.filter(F.arrays_overlap("all_shingles", telling))
    # Windows of each template size: 2m shingles from every m-th on.
    window = lambda m: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("all_shingles") - 1) / m).cast("int"))),
        lambda i: F.struct(F.lit(m).alias("m"), (i * m).cast("long").alias("start"), F.slice("all_shingles", i * m + 1, 2 * m).alias("held")),
    )
    windows = texts.select("doc_id", F.explode(F.flatten(F.array(*[window(m) for m in sizes]))).alias("w")).select("doc_id", "w.*")
    windows = windows.filter(F.arrays_overlap("held", telling))
    low = F.array(*[_minimum("held", b) for b in range(bands)])
    banded = windows.select("doc_id", "m", "start", "held", F.posexplode(low).alias("band", "low"))
    keys = minima.select("template", "m", F.posexplode("lows").alias("band", "low"))
    found = banded.join(F.broadcast(keys), ["m", "band", "low"]).select("doc_id", "template", "start", "held").distinct()
    share = F.size(F.array_intersect("shingles", "held")) / F.col("m")
    verified = found.join(F.broadcast(table), "template").withColumn("containment", share).filter(F.col("containment") >= least)
    return verified.select("doc_id", "license", "containment", "start")
