"""Licence scan: sparse TF-IDF cosine to licence templates, then inheritance from the nearest ancestor directory.

Method. Every line of a text, each run of `RUNS` lines and the whole text where it is short is a candidate; its words' TF-IDF
vector is compared with those of the templates (notices and opening passages of licences) by cosine. A licence is found where the
best template reaches `COSINE`. Texts of any length are also compared as a whole with whole licence texts (`FULL_TEXTS`). A file of whose words
four fifths lie in found passages, or in the whole licence text that it matches and is at least half as long as, is a licence file: it licenses its
directory. Files without a licence of their own take that of the nearest ancestor directory which has one.

Scale. Inverse document frequencies of the template words are counted over all documents; the templates bound that table. Texts are
read once for the counts and once for the scan, and are never shuffled. Directories are collapsed before their ancestors
are expanded, joined with licensed directories and reduced to the deepest; files then meet their directory's licence.

Edge cases. Null and empty texts hold no licence and may inherit. A null path inherits nothing. Ties go to the licence first in
order of name. Repeated rows each get a row. Columns other than those named are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import durable, read_table, small_side
from larkspur.llm.license_texts import FULL_TEXTS

COSINE, RUNS, SHORT = 0.7, (2, 3, 4, 5, 6, 7, 8, 12, 16), 4000
#: Public notices of licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Use of this source code is governed by a BSD-style license."),
    ("BSD", "Released under the BSD License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0", "Released under CC0 1.0 Universal Public Domain Dedication."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
]
#: Every template holds one of these, so a text without any is done.
ANCHOR = re.compile(r"licen[sc]|rights reserved|permi(?:ssion|tted)|cc0|public domain|confidential|redistribut", re.I)
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", re.I)


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


NOTICES = [(name, Counter(words(t))) for name, t in TEMPLATES]
FULL = [(name, Counter({w: int(n) for w, n in (x.rsplit(":", 1) for x in t.split(" "))})) for name, t in FULL_TEXTS]
VOCABULARY = sorted({w for _, t in NOTICES for w in t})
FULL_VOCABULARY = sorted({w for _, t in [*NOTICES, *FULL] for w in t})


class Index:
    """Templates as unit TF-IDF vectors, posted by word."""

    def __init__(self, idf: dict[str, float], rare: float, templates: list[tuple[str, Counter]] = NOTICES) -> None:
        self.idf, self.rare, self.templates = idf, rare, templates
        self.posts: dict[str, list[tuple[int, float]]] = {}
        for k, (_, count) in enumerate(templates):
            for w, x in self._unit(count).items():
                self.posts.setdefault(w, []).append((k, x))

    def _unit(self, count: Counter) -> dict[str, float]:
        v = {w: n * self.idf.get(w, self.rare) for w, n in count.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    def best(self, count: Counter) -> tuple[float, str, int]:
        """(cosine, licence, number) of the template closest to counted words."""
        sums: Counter = Counter()
        for w, x in self._unit(count).items() if count else ():
            for k, y in self.posts.get(w, ()):
                sums[k] += x * y
        if not sums:
            return 0.0, "", -1
        minus, name, k = min((-c, self.templates[k][0], k) for k, c in sums.items())
        return -minus, name, k


class Scanner:
    """Notices and whole licence texts, given the inverse document frequencies of their words."""

    def __init__(self, idf: dict[str, float], rare: float) -> None:
        self.notices, self.full = Index({w: idf[w] for w in VOCABULARY if w in idf}, rare), Index(idf, rare, FULL)

    def whole(self, count: Counter, total: int) -> tuple[str, float] | None:
        """(licence, cosine) if the words are those of a whole licence text."""
        c, name, k = self.full.best(count)
        if c < COSINE:
            return None
        text = self.full.templates[k][1]
        held = sum(min(n, text[w]) for w, n in count.items())
        return (name, c) if 5 * held >= 4 * total and 2 * total >= text.total() else None

    def scan(self, text: str | None) -> tuple[list[tuple[str, float]], bool]:
        """([(licence, cosine)] best first, whether the text is a licence file)."""
        if not text or not ANCHOR.search(text):
            return [], False
        lines = text.split("\n")
        in_line = [words(x) for x in lines]
        everything = Counter(w for x in in_line for w in x)
        total = everything.total()
        if file := self.whole(everything, total):
            return [file], True
        found: dict[str, float] = {}
        covered = [False] * len(lines)
        anchors = [i for i, x in enumerate(lines) if ANCHOR.search(x)]
        spans = {(i, i + 1) for i in anchors} | {(j, min(len(lines), j + n)) for i in anchors for n in RUNS for j in range(max(0, i - n + 1), i + 1)}
        if len(text) <= SHORT:
            spans.add((0, len(lines)))
        for i, j in spans:
            c, name, _ = self.notices.best(Counter(w for x in in_line[i:j] for w in x))
            if c >= COSINE:
                found[name] = max(found.get(name, 0.0), c)
                covered[i:j] = [True] * (j - i)
        held = sum(len(x) for x, yes in zip(in_line, covered) if yes)
        return sorted(found.items(), key=lambda x: (-x[1], x[0])), bool(found) and 5 * held >= 4 * total


def frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, float], float]:
    """Inverse document frequency of each template word over all of docs, and of a word in none."""
    vocabulary = set(FULL_VOCABULARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        n = 0
        for b in batches:
            for t in b.column(0):
                n += 1
                seen.update(vocabulary.intersection(re.split(r"[^a-z0-9.-]+", (t.as_py() or "").lower())))
        seen[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    seen = {r["word"]: r["n"] for r in got}
    n = seen.get("", 0)
    return {w: math.log((n + 1) / (seen.get(w, 0) + 1)) + 1 for w in FULL_VOCABULARY}, math.log(n + 1) + 1


def scan(docs: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, path, license, cosine, origin, licenses): origin is header, file, inherited or null; licenses are all found in the text."""
    idf, rare = frequencies(docs, text_col)
    cols = docs.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Scanner(idf, rare)
        for b in batches:
            got = [index.scan(t.as_py()) for t in b.column(2)]
            own = pa.array([[{"name": n, "cosine": c} for n, c in f] for f, _ in got], pa.list_(pa.struct([("name", pa.string()), ("cosine", pa.float64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), own, pa.array([y for _, y in got], pa.bool_())], names=["id", "path", "own", "is_file"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = durable(cols.mapInArrow(run, f"id {kind}, path string, own array<struct<name:string,cosine:double>>, is_file boolean").withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))
    licensed = rows.where("is_file and path is not null").groupBy("dir").agg(F.min(F.struct((-F.get("own", F.lit(0))["cosine"]).alias("minus"), F.get("own", F.lit(0))["name"].alias("name"))).alias("best"))
    licensed = durable(licensed.select(F.col("dir").alias("above"), F.col("best.name").alias("name"), (-F.col("best.minus")).alias("cosine")))
    n = licensed.count()
    dirs = rows.where("path is not null and not is_file").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.when(i == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))
    nearest = dirs.select("dir", F.explode(F.array_distinct(above)).alias("above")).join(small_side(licensed, n), "above")
    nearest = durable(nearest.groupBy("dir").agg(F.max(F.struct(F.length("above"), "name", "cosine")).alias("up")))
    x = rows.join(small_side(nearest, nearest.count(), 20_000), "dir", "left")
    has, up = F.size("own") > 0, F.col("up").isNotNull() & ~F.col("is_file")
    first = F.get("own", F.lit(0))
    return x.select(
        "id", "path", F.when(has, first["name"]).when(up, F.col("up.name")).alias("license"), F.when(has, first["cosine"]).when(up, F.col("up.cosine")).alias("cosine"),
        F.when(F.col("is_file"), "file").when(has, "header").when(up, "inherited").alias("origin"), F.array_join(F.sort_array(F.transform("own", lambda o: o["name"])), ",").alias("licenses"),
    )


def op9_tfidf_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id."""
    docs = read_table(spark, sf_dir, "documents")
    found = scan(docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text"))
    return found.select(F.col("id").alias("doc_id"), "path", "license", F.round("cosine", 9).alias("cosine"), "origin", "licenses")
