"""License scan by MinHash bands over overlapping text windows, in DataFrame functions only.

A template of L words is looked for in windows of L + s - 1 words, one every s = L / 4 words, so every span of L words lies inside
a window.  Template and window are sets of ``shingle``-word shingles (of a template with fewer words, all of them as one).  If a
window holds at least ``percent`` of the template's shingles, their Jaccard similarity is at least ``least_similarity``; bands of
``ROWS`` MinHash rows, as many as ``bands_for`` asks, then share a band with probability 1 - ``MISS`` or more.  What the bands
retrieve is verified: exact containment of the template's shingles.

Only windows around anchor words are signed: words of the templates chosen so that no window without one of them can reach the
containment.  Texts without any anchor are passed over by a substring test.  Nothing is lost by either.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.decontam import words_of
from scanloom.llm.tables import materialise

ROWS, MISS = 2, 1e-4

# Short notices and opening sentences of well-known licenses.
TEMPLATES = {
    "All rights reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


@dataclass(frozen=True)
class Shape:
    """Windows for templates of one length: ``words`` of a template, ``k`` of a shingle, ``step`` between windows."""
    words: int
    k: int

    @property
    def step(self) -> int:
        return max(1, self.words // 4)

    @property
    def shingles(self) -> int:
        """Shingles of a full window."""
        return self.words + self.step - self.k


def least_similarity(shape: Shape, percent: int) -> float:
    own = shape.words - shape.k + 1
    common = math.ceil(percent * own / 100)
    return common / (shape.shingles + own - common)


def bands_for(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity ** ROWS)) if similarity < 1 else 1


def words(text: str) -> list[str]:
    """Words of a template, as ``words_of`` gives them for a column."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return "".join(c if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) > 127 else " " for c in low).split()


def anchors(templates: dict[str, list[str]], k: int, percent: int) -> list[str]:
    """Longest words first, per template until shingles without any of them fall short of the containment."""
    chosen: set[str] = set()
    for own in templates.values():
        size = min(k, len(own))
        grams = [own[i:i + size] for i in range(len(own) - size + 1)]
        for word in sorted(set(own), key=lambda w: (w not in chosen, -len(w), w)):
            free = {tuple(g) for g in grams if not chosen.intersection(g)}
            if 100 * len(free) < percent * len({tuple(g) for g in grams}):
                break
            chosen.add(word)
    return sorted(chosen)


def _bands(shingles: Column, count: int) -> Column:
    """Band hashes of a set of shingle hashes, with the band's number mixed in."""
    def row(seed: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(seed))))

    return F.array(*(F.xxhash64(F.lit(b), *(row(ROWS * b + r) for r in range(ROWS))) for b in range(count)))


def _shingles(words_col: Column, start: Column, count: Column, k: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(F.array_join(F.slice(words_col, start + i + 1, k), " "))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_licenses, licenses, containment) for every row of ``docs``.

    ``licenses`` are the names of the templates that a window contains to ``percent`` or more, sorted and joined by "; ";
    ``containment`` is the best one's share of shingles, 0 without a match.  Null and wordless texts match nothing; texts shorter
    than a window are one window.  Repeated rows and rows without an id are rows of their own.  Templates without a word are passed
    over.  Other columns are not read.  Empty table: no rows.
    """
    spark = docs.sparkSession
    own = {name: words(text) for name, text in (TEMPLATES if templates is None else templates).items()}
    own = {name: w for name, w in own.items() if w}
    marks = anchors(own, shingle, percent)
    keyed = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version"))
    low = F.lower("text")
    some = F.lit(False)
    for m in marks:
        some = some | F.contains(low, F.lit(m))
    texts = keyed.filter(some).select("doc", "version", words_of(F.col("text")).alias("w"))
    at = F.filter(F.transform("w", lambda x, i: F.when(x.isin(marks), i)), lambda i: i.isNotNull())
    # Few texts are left; they are written once, with the anchors' places.
    texts = materialise(texts.withColumn("at", at).filter("size(at) > 0").distinct(), "marked")

    shapes = sorted({Shape(len(w), min(shingle, len(w))) for w in own.values()}, key=lambda s: s.words)
    count = max((bands_for(least_similarity(s, percent)) for s in shapes), default=1)
    # The windows on each shape's grid that hold an anchor.
    kinds = F.array(*(F.struct(F.lit(s.words).alias("l"), F.lit(s.k).alias("k"), F.lit(s.step).alias("step")) for s in shapes)) if shapes else F.expr("CAST(array() AS array<struct<l:int,k:int,step:int>>)")
    spots = texts.select("doc", "version", "w", "at", F.explode(kinds).alias("p")).select("doc", "version", "w", "p.*", F.explode("at").alias("a"))
    length = F.col("l") + F.col("step") - 1
    lo, hi = F.greatest(F.lit(0), F.ceil((F.col("a") - (length - 1)) / F.col("step")).cast("int")), F.floor(F.col("a") / F.col("step")).cast("int")
    windows = (spots.withColumn("g", F.explode(F.sequence(lo, hi))).withColumn("s", F.col("g") * F.col("step")).withColumn("c", F.least(length, F.size("w") - F.col("s")) - (F.col("k") - 1)).filter("c > 0")
               .select("doc", "version", "l", _shingles(F.col("w"), F.col("s"), F.col("c"), F.col("k")).alias("sh")))
    rows = [(name, w, len(w), min(shingle, len(w))) for name, w in own.items()]
    names = spark.createDataFrame(rows, "name string, w array<string>, l int, k int").withColumn("th", _shingles(F.col("w"), F.lit(0), F.size("w") - (F.col("k") - 1), F.col("k")))
    # Templates times bands: fixed by the template list.
    wanted = F.broadcast(names.select("name", "l", "th", F.explode(_bands(F.col("th"), count)).alias("band")))
    met = windows.select("doc", "version", "l", "sh", F.explode(_bands(F.col("sh"), count)).alias("band")).join(wanted, ["l", "band"])
    share = F.size(F.array_intersect("sh", "th")) / F.size("th")
    hits = met.select("doc", "version", "name", share.alias("share")).filter(F.col("share") * 100 >= percent)
    found = hits.groupBy("doc", "version").agg(F.array_sort(F.collect_set("name")).alias("names"), F.max("share").alias("share"))
    found = found.select(F.col("doc").alias("d"), F.col("version").alias("v"), "names", "share")
    out = keyed.select("doc", "version").join(found, F.col("doc").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    return out.select(F.col("doc").alias(id_col), F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"),
                      F.coalesce(F.array_join("names", "; "), F.lit("")).alias("licenses"), F.coalesce("share", F.lit(0.0)).alias("containment"))
