"""License scans: which documents carry which license notice, in DataFrame operations only.

Words are runs of a-z and 0-9 of the lower-cased text, numbers all written as 0, so that versions do not matter; shingles
are `WORDS` consecutive words. Templates of up to L = 1, 2, 4, ... shingles form a size class, whose text windows hold 2L
consecutive shingles and start every L, so that every run of L shingles lies whole in some window.

Retrieval: each window has `HASHES` MinHash values, in bands of one row. A template that is contained to a share c in its
window has a Jaccard similarity s >= c / 4 with it (more than L / 2 of 2L shingles), so a band collides with probability
1 - (1 - s) ** HASHES: 0.999 for a whole template in the worst case, 0.995 at the threshold, and 0.9999 or more for
templates that nearly fill their class. Random text collides with nothing, since it shares no five words with a template.

Verification: exact. The share of the template's distinct shingles that the window holds must be `CONTAINED` or more.

Before all this, documents that cannot hold any template are dropped by a test without loss: for every template, anchor
words are chosen such that the shingles without any of them are fewer than the share asked for, so a text without an
anchor of the template cannot reach it. What is left is dealt out once by document, and all windows are built there
without another shuffle; band keys, not texts or windows, meet the templates in a join.

Edge cases: null or empty texts, and texts of fewer than `WORDS` words, hold nothing; so do templates of fewer words. One
row per (doc_id, license); a null doc_id is a value like others. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specaudit.session import cut

WORDS, HASHES, CONTAINED = 5, 24, 0.8

# Common wordings of license notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", re.sub("[0-9]+", "0", text.lower())) if w]


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), "[^a-z0-9]+"), lambda w: w != "")


def anchors(templates: list[tuple[str, str]], size: int = WORDS, contained: float = CONTAINED) -> list[str]:
    """Words of which a text that holds a template to the share asked for has one at least: long and rarely chosen anew."""
    chosen: list[str] = []
    for _, text in templates:
        own = words_of(text)
        shingles = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        free = {s for s in shingles if not any(w in chosen for w in s)}
        for w in sorted(set(own) - {"0"}, key=lambda w: (w not in chosen, -len(w), w)):
            if len(free) < contained * len(shingles) or not free:
                break
            if any(w in s for s in free):
                chosen.append(w)
                free = {s for s in free if w not in s}
    return chosen


def _hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def _shingles(text: Column, size: int) -> Column:
    w = words(text)
    pick = lambda ws, i: _hash([F.get(ws, i + j) for j in range(size)])
    many = lambda ws: F.when(F.size(ws) >= size, F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: pick(ws, i)))
    # The words are bound to a one-element array first, so that they are split once and not once per shingle.
    return F.get(F.transform(F.array(w), many), 0)


def template_shingles(spark: SparkSession, templates: list[tuple[str, str]], size: int) -> DataFrame:
    """(template, license, shingle, m, block): distinct shingles, their number, and the window step of the size class."""
    rows = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(templates)))
    listed = spark.range(1).select(F.inline(rows)).select("template", "license", F.explode(_shingles(F.col("text"), size)).alias("shingle")).distinct()
    sizes = listed.groupBy("template").agg(F.count(F.lit(1)).alias("m"))
    return listed.join(sizes, "template").withColumn("block", F.pow(F.lit(2), F.ceil(F.log2("m"))).cast("int"))


def _signature(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and (band, value) rows: MinHash values of the shingles of each group."""
    least = rows.groupBy(*keys).agg(*(F.min(F.xxhash64("shingle", F.lit(i))).alias(f"h{i}") for i in range(HASHES)))
    return least.select(*keys, F.posexplode(F.array(*(f"h{i}" for i in range(HASHES)))).alias("band", "value"))


def license_notices(docs: DataFrame, templates: list[tuple[str, str]] | None = None, size: int = WORDS, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, license, containment, n_windows): notices found in the whole text of every row of (doc_id, text)."""
    templates = [t for t in (TEMPLATES if templates is None else templates) if len(words_of(t[1])) >= size]
    spark = docs.sparkSession
    if not templates:
        return docs.selectExpr("cast(doc_id as long) doc_id", "'' license", "0d containment", "0L n_windows").where("false")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    low = F.lower("text")
    some = F.lit(False)
    for word in anchors(templates, size, contained):
        some = some | low.contains(word)
    key = ["place", "known", "nameless"]  # a row is told by its text and its id, which may be null
    kept = cut(rows.where(some).select(F.xxhash64("text").alias("place"), F.coalesce("doc_id", F.lit(0)).alias("known"), F.col("doc_id").isNull().alias("nameless"), "text"))
    known = cut(template_shingles(spark, templates, size))
    blocks = sorted(r[0] for r in known.select("block").distinct().collect())  # one per size class
    placed = kept.repartition(*key).select(*key, F.posexplode(_shingles(F.col("text"), size)).alias("at", "shingle"))
    both = F.explode(F.flatten(F.array(*(F.array(*(F.struct(F.lit(b).alias("block"), (F.floor(F.col("at") / b) - back).alias("window")) for back in (0, 1))) for b in blocks)))).alias("w")
    windows = placed.select(*key, "shingle", both).select(*key, "shingle", "w.block", "w.window").where("window >= 0")
    met = _signature(windows, [*key, "block", "window"]).join(_signature(known, ["template", "block"]), ["block", "band", "value"])
    candidates = cut(met.select(*key, "block", "window", "template").distinct())
    inside = windows.join(candidates, [*key, "block", "window"]).join(known.select("template", "shingle", "license", "m"), ["template", "shingle"])
    shares = inside.groupBy(*key, "block", "window", "template", "license", "m").agg(F.count_distinct("shingle").alias("held"))
    share = F.col("held") / F.col("m")
    doc = F.when(~F.col("nameless"), F.col("known")).alias("doc_id")
    return shares.where(share >= contained).groupBy(doc, "license").agg(
        F.max(share).alias("containment"), F.count_distinct("place", "block", "window").alias("n_windows"))


def oracle_sql(templates: list[tuple[str, str]] | None = None, size: int = WORDS, contained: float = CONTAINED) -> str:
    """The same result in plain SQL, by comparing all shingles, for DuckDB."""
    quoted = [(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES if templates is None else templates)]
    values = ", ".join(f"({i}, '{name}', '{text}')" for i, name, text in quoted)
    cut_up = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[0-9]+', '0', 'g'), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"""
WITH t AS (SELECT * FROM (VALUES {values}) v(template, license, text)),
tw AS (SELECT template, license, {cut_up} AS ws FROM t),
ts AS (SELECT DISTINCT template, license, array_to_string(ws[i + 1:i + {size}], ' ') AS shingle FROM (SELECT *, unnest(range(0, len(ws) - {size - 1})) AS i FROM tw)),
known AS (SELECT *, CAST(2 ** ceil(log2(m)) AS BIGINT) AS block FROM (SELECT *, count(*) OVER (PARTITION BY template) AS m FROM ts)),
dw AS (SELECT doc_id, text, {cut_up} AS ws FROM documents),
ds AS (SELECT doc_id, text, i AS "at", array_to_string(ws[i + 1:i + {size}], ' ') AS shingle FROM (SELECT *, unnest(range(0, len(ws) - {size - 1})) AS i FROM dw)),
met AS (SELECT doc_id, text, template, license, m, block, shingle, "at" // block - back AS win FROM ds JOIN known USING (shingle), (VALUES (0), (1)) b(back)),
shares AS (SELECT doc_id, text, block, win, template, license, count(DISTINCT shingle) / m AS share FROM met WHERE win >= 0 GROUP BY doc_id, text, block, win, template, license, m)
SELECT doc_id, license, max(share) AS containment, count(DISTINCT (text, block, win)) AS n_windows FROM shares WHERE share >= {contained} GROUP BY doc_id, license
"""
