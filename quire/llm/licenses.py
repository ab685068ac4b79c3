"""License scans by MinHash bands over overlapping windows; DataFrame functions only.

Texts become lower-case words and numbers, and windows of their five-word shingles are compared with
license templates. Templates are dealt to classes by their number of shingles. A class has a stride
of about half its templates' shingles and windows of so many strides that any notice, wherever it
stands, lies whole in one. A window's MinHash under a permutation is the least of its strides' least
hashes. Every band is one such value; a class has as many bands as its worst template needs to share
one with a window that holds just enough of it with a probability of ``SURE``: 1 - (1 - J)**bands,
J being the Jaccard similarity of the two.

The join of bands runs from the templates' side, whose values are few and known: a window can share a
band only if it holds the one shingle that gives the template its value, so these shingles (one for
each template and band, not all of a template's) are looked up in the texts, and the windows round
them are candidates if their own least hash is that value. That finds the windows that a join of all
windows' values finds. A plan that works out all values of all windows was five times over the budget.

Retrieved windows are verified by the exact share of the template's shingles that they hold, 0.8 or
more. A template of fewer than five words is one shingle of its length; its windows are single
shingles and its one band is sure.

The templates' bands are a parameter of the scan and of fixed size; texts keep only windows with one.

Defined results: null and empty texts match nothing, nor do empty templates; equal templates are
each found. Very long texts are cut into pieces that overlap by more than a window, and windows in an
overlap count in both. Rows that repeat a doc_id are judged together; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .decontaminate import _pieces

SHINGLE, COVER, SURE = 5, 0.8, 0.999
#: Classes of templates by shingles: 1, 2, 3, 4 and on by halves of powers of two.
GRID = sorted({1, 2, 3} | {n for k in range(2, 16) for n in (1 << k, 3 << k - 1)})
#: Common notices, abridged where long. Fixed values.
TEMPLATES = {
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-text": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "All-rights-short": "All rights reserved",
    "All-rights": "All rights reserved. No part of this publication may be reproduced, stored or transmitted in any form",
}


@dataclass(frozen=True)
class Kind:
    """A class of templates: words of a shingle, shingles of a stride, strides of a window, bands."""

    words: int
    stride: int
    strides: int
    bands: int

    @classmethod
    def of(cls, words: int, shingles: int) -> Kind:
        top = next(n for n in GRID if n >= shingles)
        stride = -(-top // 2)
        return cls(words, stride, -(-(top + stride - 1) // stride), 1)

    def needs(self, shingles: int, cover: float) -> int:
        """Bands that find a full window with the least share of a template that counts."""
        held = min(max(math.ceil(cover * shingles - 1e-9), 1), shingles)
        alike = held / max(self.stride * self.strides + shingles - held, held)
        return 1 if alike == 1 else math.ceil(math.log(1 - SURE) / math.log(1 - alike))


def _words(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")).alias("t"))


def _runs(n: int) -> Column:
    """Runs of n words of a text; a shorter text of five-word shingles is one, texts without a word
    have none."""
    runs = F.expr(rf"regexp_extract_all(t, '(?=([^ ]++(?: [^ ]++){{{n - 1}}}+))[^ ]++', 1)")
    return F.when(F.size(runs) > 0, runs).when(F.length("t") > 0, F.array("t")) if n == SHINGLE else runs


def _shingles(n: int) -> Column:
    return F.transform(_runs(n), lambda x: F.xxhash64(x))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, cover: float = COVER) -> DataFrame:
    """``(doc_id, license_id, n_windows, containment)`` for documents and the licenses they name;
    n_windows: windows that match."""
    spark = docs.sparkSession
    given = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license_id string, text string")
    size = F.size(F.split("t", " "))
    read = _words(given, "license_id").where("t <> ''").select("license_id", "t", size.alias("words"))
    by_words, brief = {}, read.collect()  # a parameter, of fixed size
    for r in brief:
        by_words.setdefault(min(r.words, SHINGLE), []).append(r.license_id)
    known = None
    for n, ids in by_words.items():
        own = read.where(F.col("license_id").isin(ids)).select("license_id", F.lit(n).alias("words"), F.array_distinct(_shingles(n)).alias("th"))
        known = own if known is None else known.unionByName(own)
    sizes = {r.license_id: (r.words, r.n) for r in known.select("license_id", "words", F.size("th").alias("n")).collect()} if known else {}
    bare = {i: Kind.of(*s) for i, s in sizes.items()}
    order = sorted(set(bare.values()), key=lambda k: (k.words, k.stride, k.strides))
    kinds = [replace(k, bands=max(k.needs(sizes[i][1], cover) for i in sizes if bare[i] == k)) for k in order]
    number = {i: order.index(k) for i, k in bare.items()}
    if not sizes:
        return docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("license_id"), F.lit(0).cast("long").alias("n_windows"), F.lit(0.0).alias("containment")).where("false")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind_of = F.element_at(F.create_map(*(F.lit(x) for i, j in number.items() for x in (i, j))), F.col("license_id"))
    known = cut(known.withColumn("kind", kind_of))
    most, of_kind = max(k.bands for k in kinds), lambda xs: F.element_at(F.array(*(F.lit(x) for x in xs)), F.col("kind") + 1)
    bands = known.select("license_id", "kind", "words", F.explode("th").alias("x")).select("*", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("band")).where(F.col("band") <= of_kind([k.bands for k in kinds]))
    bands = bands.groupBy("license_id", "kind", "words", "band").agg(F.min(F.struct(F.xxhash64("x", "band").alias("least"), "x")).alias("m"))
    bands = cut(bands.select("license_id", "kind", "words", "band", "m.least", "m.x"))

    # a window can only share a template's band if it holds the shingle that gives the template its value
    words_of, each = _words(_pieces(text, "doc_id"), "doc_id", "piece"), None
    for n in sorted(by_words):
        there = words_of if n == SHINGLE else words_of.where(reduce(or_, (F.contains("t", F.lit(r.t)) for r in brief if r.words == n)))
        rows = there.select("doc_id", "piece", F.posexplode(_runs(n)).alias("i", "run")).select("doc_id", "piece", F.lit(n).alias("words"), "i", F.xxhash64("run").alias("x"))
        each = rows if each is None else each.unionByName(rows)
    near = each.join(F.broadcast(bands), ["words", "x"])
    stride, strides = of_kind([k.stride for k in kinds]), of_kind([k.strides for k in kinds])
    at = F.floor(F.col("i") / stride).cast("int")
    windows = F.explode(F.sequence(F.greatest(at - strides + 1, F.lit(0)), at)).alias("window")
    near = cut(near.select("doc_id", "piece", "words", "kind", "license_id", "band", "least", windows).distinct())

    ids = near.select(F.col("doc_id").alias("d"), F.col("piece").alias("p")).distinct()
    own = _words(_pieces(text.join(ids.select("d").distinct(), F.expr("doc_id <=> d"), "left_semi"), "doc_id"), "doc_id", "piece")
    own = own.join(ids, F.expr("doc_id <=> d and piece = p"), "left_semi")
    hashed = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), _shingles(n).alias("h")) for n in sorted(by_words))))
    own = own.select(F.col("doc_id").alias("d"), F.col("piece").alias("p"), hashed.alias("x")).select("d", "p", "x.n", "x.h")
    shared = near.join(own, F.expr("doc_id <=> d and piece = p and n = words")).withColumn("sh", F.slice("h", F.col("window") * stride + 1, stride * strides))
    shared = shared.where(F.array_min(F.transform("sh", lambda x: F.xxhash64(x, F.col("band")))) == F.col("least"))
    found = cut(shared.select("doc_id", "piece", "kind", "window", "license_id", "sh").dropDuplicates(["doc_id", "piece", "window", "license_id"]))
    both = found.join(F.broadcast(known.select("license_id", "th")), "license_id")
    held = both.select("doc_id", "license_id", "piece", "window", (F.size(F.array_intersect("th", "sh")) / F.size("th")).alias("containment")).where(F.col("containment") >= cover)
    held = held.groupBy("doc_id", "license_id", "piece", "window").agg(F.max("containment").alias("containment"))
    return held.groupBy("doc_id", "license_id").agg(F.count("*").alias("n_windows"), F.max("containment").alias("containment"))
