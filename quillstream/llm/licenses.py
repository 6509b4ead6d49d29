"""License scan in DataFrame expressions only: MinHash bands over text windows, then exact shingle containment.

Words are runs of a-z, 0-9 and characters beyond ASCII of the lower-cased text. A window is two neighbouring 5-word shingles;
the windows of a text overlap in words and cover all its shingles, those of a template start at every word. Each of BANDS bands has one MinHash
row, so two windows with Jaccard similarity J share a band with probability 1-(1-J)**BANDS. A template of three or more shingles, if it
stands in a text, has a window in common with it (J = 1, certain); one of two shingles meets in two windows with J >= 1/3 and one of a
single shingle with J >= 1/2, which 16 bands find with a probability of 99.999 %.

A document holds a license when at least CONTAINMENT of the template's shingles are among its own; that is computed
exactly for the pairs of document and template that a band brought up. Only such documents are ever shuffled or joined: the test of a
text's windows against the bands of the fixed template list runs inside its row.

Defined results: null and short texts hold nothing; repeated rows and ids are scanned one by one; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

SHINGLE = 5
BANDS = 16
CONTAINMENT = 0.8
SPLIT = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

# Public license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def shingles(text: Column) -> Column:
    """Hashes of the 5-word shingles of a text, in order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    # the array of word hashes is made once, not for each shingle
    return F.flatten(
        F.transform(
            F.array(hashes),
            lambda h: F.when(
                F.size(h) >= SHINGLE,
                F.transform(F.sequence(F.lit(1), F.size(h) - (SHINGLE - 1)), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(SHINGLE)))),
            ).otherwise(F.array().cast("array<bigint>")),
        )
    )


def windows(grams: Column, step: int) -> Column:
    """Pairs of neighbouring shingles from every step-th one on; the last may stand alone."""
    return F.when(
        F.size(grams) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(grams), F.lit(step)),
            lambda i: F.struct(F.element_at(grams, i).alias("p"), F.element_at(grams, F.least(i + 1, F.size(grams))).alias("q")),
        ),
    ).otherwise(F.array().cast("array<struct<p:bigint,q:bigint>>"))


def band(window: Column, k: int) -> Column:
    """MinHash of a window under the k-th hash function."""
    return F.least(F.xxhash64(window["p"], F.lit(k)), F.xxhash64(window["q"], F.lit(k)))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(templates.items()), "license string, template string").select(
        "license", F.array_distinct(shingles(F.col("template"))).alias("t"), windows(shingles(F.col("template")), 1).alias("w")
    )


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, license, n_shared, n_shingles, containment), one row per license that a row holds."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    bands = table.select("license", F.explode("w").alias("w")).select(
        "license", F.posexplode(F.array(*(band(F.col("w"), k) for k in range(BANDS)))).alias("band", "key")
    ).distinct()
    keys: list[list[int]] = [[] for _ in range(BANDS)]
    for row in bands.select("band", "key").distinct().collect():  # of the fixed template list
        keys[row.band].append(row.key)
    if not any(keys):
        return spark.createDataFrame([], f"{id_col} long, license string, n_shared long, n_shingles long, containment double")

    def known(w: Column) -> Column:
        out = F.lit(False)
        for k in range(BANDS):
            out = out | band(w, k).isin(keys[k])
        return out

    base = docs.where(F.col(id_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), shingles(F.col(text_col)).alias("d")
    )
    hits = base.select("row", "id", "d", F.filter(windows(F.col("d"), 2), known).alias("hits")).where(F.size("hits") > 0)
    keys_of = F.flatten(F.transform("hits", lambda w: F.array(*(F.struct(F.lit(k).alias("band"), band(w, k).alias("key")) for k in range(BANDS)))))
    brought = hits.select("row", "id", "d", F.explode(F.array_distinct(keys_of)).alias("b"))
    by_license = bands.groupBy("band", "key").agg(F.collect_set("license").alias("licenses"))
    pairs = brought.select("row", "id", "d", "b.band", "b.key").join(F.broadcast(by_license), ["band", "key"])
    pairs = pairs.select("id", "d", F.explode("licenses").alias("license"), "row").join(F.broadcast(table.select("license", "t")), "license")
    shared = F.size(F.array_intersect("t", "d")).cast("long")
    found = pairs.select("row", "id", "license", shared.alias("n_shared"), F.size("t").cast("long").alias("n_shingles"))
    found = found.where(F.col("n_shared") >= CONTAINMENT * F.col("n_shingles")).groupBy("row", "id", "license").agg(F.max("n_shared").alias("n_shared"), F.max("n_shingles").alias("n_shingles"))
    return found.select(F.col("id").alias(id_col), "license", "n_shared", "n_shingles", F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _values() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in TEMPLATES.items())


ORACLE_SQL = f"""
WITH templates(license, body) AS (VALUES {_values()}),
tw AS (SELECT license, string_split(trim(regexp_replace(lower(body), '{SPLIT}', ' ', 'g')), ' ') AS w FROM templates),
ts AS (SELECT DISTINCT license, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT license, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM tw)),
size AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
dw AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '{SPLIT}', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM dw)),
hit AS (SELECT doc_id, license, count(*) AS k FROM ds JOIN ts USING (s) GROUP BY doc_id, license)
SELECT doc_id, license, CAST(k AS BIGINT) AS n_shared, CAST(n AS BIGINT) AS n_shingles, round(k / n, 6) AS containment
FROM hit JOIN size USING (license) WHERE k >= {CONTAINMENT} * n
"""
