"""Licence detection: sparse TF-IDF cosine to short notices and full licence texts, and inheritance along directories.

A text is cut into segments at line ends and sentence ends. Windows of a few consecutive segments
(a notice may be wrapped, or stand within a longer line) are compared with short notices, whole
texts with full licence texts. Terms are weighted by term frequency and inverse document frequency
over all documents. By Cauchy-Schwarz a cosine is at most the norm of the template's part that the
compared text shares, so only texts that share enough of a template's squared weight are compared.
A document whose words are mostly matched is a licence file of its directory; documents without a
match take the licence of the nearest ancestor directory that has one.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, small, text_of
from .url_filter import LOWER, UPPER

#: Short notices of common licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "All-rights-reserved": ["All rights reserved"],
}
#: Licences whose full text lies in the folder licenses; those of CC-BY-4.0 and CC-BY-NC-4.0 are known by their notices only.
FULL_TEXTS = ["Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-3.0", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"]
THRESHOLD = 0.75
#: Segments of the windows compared with notices, at every place. A window may have any number of segments as long as it has no more words than LONGEST times the longest notice, so a notice is found however it is wrapped.
SPAN, LONGEST = 5, 2
#: Squared weight of a full text that its rare terms may leave out, and the share of documents above which a term is not rare.
LEFT_OUT, COMMON = 0.25, 0.05
#: Share of a document's terms in matched lines from which it is a licence file.
FILE_SHARE = 0.5
SPLIT = r"[^a-z0-9]+"
SEGMENT = r"\n|(?<=[.!?])\s+"


def _terms(text: str) -> Counter:
    return Counter(t for t in re.split(SPLIT, text.lower()) if t)


def terms_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SPLIT), "")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): how many documents have each term, as a written table."""
    held = docs.select(F.explode(F.array_distinct(terms_of(text_of()))).alias("term"))
    return materialize(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")


def full_texts() -> dict[str, list[str]]:
    return {name: [pkgutil.get_data(__package__, f"licenses/{name}.txt").decode()] for name in FULL_TEXTS}


class Weights:
    """Unit template vectors under the corpus' document frequencies, and the terms that a matching text must have."""

    def __init__(self, n: int, df: dict[str, int], templates: dict[str, list[str]]):
        self.n, self.df, self.vectors = n, df, []
        for name, texts in sorted(templates.items()):
            for i, text in enumerate(texts):
                weights = {t: k * (math.log((1 + n) / (1 + df.get(t, 0))) + 1) for t, k in _terms(text).items()}
                norm = math.sqrt(sum(w * w for w in weights.values()))
                self.vectors.append((f"{name}#{i}", {t: w / norm for t, w in weights.items()}))

    def needed(self, threshold: float, left_out: float) -> list[tuple[list[str], int]]:
        """For each template its heaviest rare terms, without which at most left_out of its squared weight is left, and how many of them a text within the threshold has at least."""
        out = []
        for _, unit in self.vectors:
            rest, taken = 1.0, []
            for t in sorted(unit, key=lambda t: (self.df.get(t, 0) > COMMON * self.n, -unit[t], t)):
                if rest < left_out:
                    break
                taken.append(t)
                rest -= unit[t] ** 2
            need = 0
            for t in sorted(taken, key=lambda t: -unit[t]):
                if rest >= threshold**2 - 1e-9:
                    break
                need, rest = need + 1, rest + unit[t] ** 2
            out.append((sorted(taken), max(need, 1)))
        return out


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in words]).cast("array<string>")


def _windows(ends: Column, words: int) -> Column:
    """Structs (start, span, terms) of the windows of the array segs that begin and end with a segment that has one of the terms in ends: of SPAN segments at most, or of so many that they have `words` words at most."""
    last = F.size("segs") - 1
    edges = F.filter(F.sequence(F.lit(0), last), lambda i: F.col("edge")[i])
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))

    def reach(i: Column) -> Column:
        """How many segments from i on have `words` words together, at most."""
        after = lambda acc, seg: F.struct((acc["n"] + F.size(seg)).alias("n"), (acc["reach"] + F.when(acc["n"] + F.size(seg) <= words, 1).otherwise(0)).alias("reach"))
        return F.aggregate(F.slice("segs", i + 1, F.lit(words)), none, after)["reach"]

    near = lambda i: F.filter(F.sequence(i, F.least(i + F.greatest(F.lit(SPAN), reach(i)) - 1, last)), lambda j: F.col("edge")[j])
    window = lambda i, j: F.struct(i.alias("start"), (j - i + 1).alias("span"), F.flatten(F.slice("segs", i + 1, j - i + 1)).alias("terms"))
    return F.when(F.size("segs") > 0, F.flatten(F.transform(edges, lambda i: F.transform(near(i), lambda j: window(i, j)))))


def _weighed(units: DataFrame, frequencies: DataFrame, n: int) -> DataFrame:
    """(row, start, span, term, w): TF-IDF weights of the terms of units. The most frequent words are broadcast, so that none gathers its rows in one task."""
    key = ["row", "start", "span"]
    terms = units.select(*key, F.explode("terms").alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = materialize(terms, "terms")
    words = materialize(frequencies.join(terms.select("term").distinct(), "term", "left_semi"), "words")
    if words.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = terms.join(F.broadcast(words), "term")
    else:
        top = F.broadcast(materialize(words.orderBy(F.desc("df"), "term").limit(BROADCAST_ROWS), "top-words"))
        known = terms.join(top, "term").unionByName(terms.join(top.select("term"), "term", "left_anti").join(words, "term"))
    return known.select(*key, "term", (F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("w"))


def _cosines(units: DataFrame, w: Weights, frequencies: DataFrame, threshold: float) -> DataFrame:
    """(row, start, span, cosine, license) of the units (row, start, span, terms) that reach the threshold."""
    spark, key = units.sparkSession, ["row", "start", "span"]
    units = materialize(units, "units")
    vectors = F.broadcast(spark.createDataFrame([(t, name, x) for name, v in w.vectors for t, x in v.items()], "term string, template string, x double"))
    shared = units.select(*key, F.explode(F.array_distinct("terms")).alias("term")).join(vectors, "term")
    enough = shared.groupBy(*key, "template").agg(F.sum(F.col("x") * F.col("x")).alias("share")).filter(F.col("share") >= threshold**2 - 1e-9)
    near = materialize(enough.select(*key, "template"), "near")
    weighed = _weighed(units.join(small(near.select(*key).distinct()), key), frequencies, w.n)
    weighed = materialize(weighed, "weights")
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(vectors, "term").join(small(near), [*key, "template"]).groupBy(*key, "template").agg(F.sum(F.col("w") * F.col("x")).alias("dot"))
    # rounded, so that the order in which sums were made does not decide between equals
    cosine = dots.join(norms, key).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("cosine") >= threshold)
    return cosine.select(*key, "cosine", F.substring_index("template", "#", 1).alias("license"))


def scan_licenses(files: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of files (doc_id, path, text): doc_id, path, license, similarity, origin, from_dir.

    origin is 'own' (a window of the text, or all of it, matches; the best one decides, ties by the
    alphabetically last licence), 'inherited' (from_dir is the nearest ancestor directory with a
    licence file) or 'none' (license null). Of a directory's licence files the one with the larger
    share of matched terms decides, then the larger similarity, then the alphabetically last
    licence. A null text is empty; a null path has no directory. Repeated rows are alike. Other
    columns are ignored. With templates, these notices are used and no full texts.
    """
    spark = files.sparkSession
    notices, full = templates or TEMPLATES, {} if templates else full_texts()
    frequencies, n = document_frequencies(files), files.count()
    vocabulary = sorted({t for texts in [*notices.values(), *full.values()] for text in texts for t in _terms(text)})
    wanted = spark.createDataFrame([(t,) for t in vocabulary], "term string")
    df = {r["term"]: r["df"] for r in frequencies.join(F.broadcast(wanted), "term").collect()}  # the templates bound it
    short, long = Weights(n, df, notices), Weights(n, df, full)
    # a window reaches the threshold with one of these at least
    anchors = sorted({t for taken, _ in short.needed(threshold, threshold**2) for t in taken})
    ends = _words(sorted({t for _, v in short.vectors for t in v}))

    rows = files.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", text_of().alias("t"), terms_of(text_of()).alias("terms"))
    near_full, rare = F.lit(False), long.needed(threshold, LEFT_OUT)
    rows = rows.withColumn("rare", F.array_intersect("terms", _words(sorted({t for taken, _ in rare for t in taken}))))
    for taken, need in rare:
        near_full = near_full | ((F.size("rare") >= need) & (F.size(F.array_intersect("rare", _words(taken))) >= need))
    segs = F.filter(F.transform(F.split("t", SEGMENT), terms_of), lambda x: F.size(x) > 0)
    rows = rows.select(
        "row", "doc_id", "path", F.size("terms").alias("n"), F.when(near_full, F.col("terms")).alias("terms"),
        F.when(F.arrays_overlap("terms", _words(anchors)), segs).alias("segs"),
    )
    rows = materialize(rows, "segments")

    most = LONGEST * max((sum(_terms(t).values()) for texts in notices.values() for t in texts), default=0)
    windows = F.filter(_windows(ends, most), lambda u: F.arrays_overlap(u["terms"], _words(anchors)))
    edged = rows.filter("segs IS NOT NULL").select("row", "segs", F.transform("segs", lambda s: F.arrays_overlap(s, ends)).alias("edge"))
    units = edged.select("row", F.explode(windows).alias("u")).select("row", "u.start", "u.span", "u.terms")
    matched = materialize(_cosines(units, short, frequencies, threshold), "matched")
    best = matched.select("row", "cosine", "license")
    # what the matches cover: of the windows with one start, and of those with one end, only the best
    tight = matched.groupBy("row", "start").agg(F.max(F.struct("cosine", (-F.col("span")).alias("less"))).alias("b")).select("row", "start", "b.cosine", (-F.col("b.less")).alias("span"))
    tight = tight.groupBy("row", (F.col("start") + F.col("span")).alias("end")).agg(F.max(F.struct("cosine", "start")).alias("b")).select("row", F.explode(F.sequence(F.col("b.start"), F.col("end") - 1)).alias("i")).distinct()
    sizes = rows.filter("segs IS NOT NULL").select("row", "n", F.transform("segs", F.size).alias("sizes"))
    shares = tight.join(sizes, "row").groupBy("row", "n").agg(F.sum(F.col("sizes")[F.col("i")]).alias("m")).select("row", (F.col("m") / F.col("n")).alias("share"))
    if full:
        whole = rows.filter("terms IS NOT NULL").select("row", F.lit(0).alias("start"), F.lit(1).alias("span"), "terms")
        whole = materialize(_cosines(whole, long, frequencies, threshold), "whole")
        best = best.unionByName(whole.select("row", "cosine", "license"))
        shares = shares.unionByName(whole.select("row", F.lit(1.0).alias("share")))
    best = best.groupBy("row").agg(F.max(F.struct("cosine", "license")).alias("best"))
    own = materialize(best.join(shares.groupBy("row").agg(F.max("share").alias("share")), "row"), "own")

    # directories of licence files, then the nearest ancestor of every directory, then its files
    found = rows.select("row", "doc_id", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir")).join(small(own), "row", "left")
    found = materialize(found, "found")
    holders = found.filter((F.col("share") >= FILE_SHARE) & (F.col("dir") != "")).groupBy("dir").agg(F.max(F.struct("share", "best")).alias("top"))
    holders = materialize(holders.select("dir", F.col("top.best.license").alias("inherited")), "holders")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))
    needy = found.filter("best IS NULL AND dir <> ''").select("dir").distinct().select("dir", F.explode(above).alias("a"))
    nearest = needy.select(F.col("dir").alias("own_dir"), "a.depth", F.col("a.above").alias("dir")).join(small(holders), "dir")
    nearest = nearest.groupBy("own_dir").agg(F.max(F.struct("depth", "dir", "inherited")).alias("near")).withColumnRenamed("own_dir", "dir")
    out = found.join(small(materialize(nearest, "nearest")), "dir", "left")
    return out.select(
        "doc_id", "path", F.coalesce("best.license", "near.inherited").alias("license"), F.round("best.cosine", 6).alias("similarity"),
        F.when(F.col("best").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("best").isNull(), F.col("near.dir")).alias("from_dir"),
    )
