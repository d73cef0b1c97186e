"""Licence scans: sparse TF-IDF cosine of lines to templates, then inheritance from the nearest ancestor directory.

Every line of every document that shares two words with some template is a candidate header. Words weigh by how few
lines of the whole corpus hold them; words no template has count as the rarest. Lines go through an inverted index
over the templates' words, so the cosine is worked out sparsely and no line leaves its task; a line carries the
licence of its most similar template from ``LEAST`` on. Files that
consist of licence lines alone are licence files and declare their directory; a document without a licence of its
own inherits from the deepest directory above it that declares one.

Defined results: null and empty texts have no own licence; a null path is the root; rows that repeat id, path and
text get the same result; equal cosines go to the template first in order; a directory with several licence files
takes the most frequent licence, then the first by name; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import add_columns
from tabwise.session import cut_lineage

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

LEAST = 0.8
SHARED_WORDS = 2
#: Notices as their licences word them.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "all-rights-reserved": ["All rights reserved."],
}


def line_words(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def _vocabulary(templates: dict[str, list[str]]) -> set[str]:
    return {w for texts in templates.values() for t in texts for w in line_words(t)}


def line_frequencies(docs: DataFrame, vocabulary: set[str], text_col: str) -> tuple[int, dict[str, int]]:
    """Number of lines of all documents, and how many hold each word of the vocabulary (as many as templates have)."""

    def run(batches):
        import pyarrow as pa

        counts: dict[str, int] = {"": 0}  # under the empty word: all lines
        for batch in batches:
            for text in batch.column(0).to_pylist():
                lines = (text or b"").decode("utf-8", "replace").split("\n")
                counts[""] += len(lines)
                for line in lines:
                    for w in vocabulary.intersection(line_words(line)):
                        counts[w] = counts.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])

    parts = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "w string, n bigint")
    found = {r["w"]: r["n"] for r in parts.groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return found.pop("", 0), found


class Matcher:
    """Cosine of a line to its most similar template, over the words they share."""

    def __init__(self, templates: dict[str, list[str]], total: int, frequencies: dict[str, int]):
        self.rarest = log(total + 1) + 1e-9
        self.idf = {w: log((total + 1) / (frequencies.get(w, 0) + 1)) + 1e-9 for w in _vocabulary(templates)}
        self.names: list[str] = []
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for name, text in ((n, t) for n, texts in templates.items() for t in texts):
            weights = {w: k * self.idf[w] for w, k in Counter(line_words(text)).items()}
            norm = sqrt(sum(x * x for x in weights.values()))
            for w, x in weights.items():
                self.postings.setdefault(w, []).append((len(self.names), x / norm))
            self.names.append(name)

    def best(self, line: str, least: float) -> tuple[str, float] | None:
        words = line_words(line)
        shared = [w for w in words if w in self.idf]
        if len(set(shared)) < SHARED_WORDS:
            return None
        inside = {w: k * self.idf[w] for w, k in Counter(shared).items()}
        within = sum(x * x for x in inside.values())
        # words no template has only add to the line's length: with so many of them no template is near enough
        if within < least * least * (within + (len(words) - len(shared)) * self.rarest**2):
            return None
        norm = sqrt(within + sum((k * self.rarest) ** 2 for w, k in Counter(words).items() if w not in inside))
        dots = [0.0] * len(self.names)
        for w, x in inside.items():
            for t, y in self.postings[w]:
                dots[t] += x * y
        top = max(range(len(dots)), key=lambda t: (dots[t], -t))
        cosine = round(dots[top] / norm, 9)
        return (self.names[top], cosine) if cosine >= least else None


def with_licence_lines(docs: DataFrame, text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``docs`` without the text, with __hits: (line, licence, cosine) of each licence line, and __filled: the number of
    lines that are not blank."""
    total, frequencies = line_frequencies(docs, _vocabulary(templates), text_col)  # as large as the templates

    def make():
        own = Matcher(templates, total, frequencies)

        def one(text):
            lines = (text or b"").decode("utf-8", "replace").split("\n")
            hits = [{"line": i, "licence": m[0], "cosine": m[1]} for i, x in enumerate(lines) if (m := own.best(x, least))]
            return hits, sum(1 for x in lines if x.strip())

        return one

    return add_columns(docs, text_col, make, "__hits array<struct<line:int, licence:string, cosine:double>>, __filled int")


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(id, path, licence, cosine, n_lines, inherited, inherited_from): own licence of the most similar line, number of
    licence lines, and for documents without one the licence of the nearest directory above."""
    hit = with_licence_lines(docs.select(id_col, F.coalesce(path, F.lit("")).alias("path"), text_col), text_col, templates, least)
    best = F.reduce("__hits", F.lit(None).cast("struct<line:int,licence:string,cosine:double>"), lambda a, x: F.when(a.isNull() | (x["cosine"] > a["cosine"]), x).otherwise(a))
    own = cut_lineage(hit.select(id_col, "path", best.alias("b"), F.size("__hits").alias("n_lines"), "__filled").select(id_col, "path", "b.licence", "b.cosine", "n_lines", "__filled"))

    declared = own.filter("n_lines > 0 and n_lines = __filled").groupBy(_parent(F.col("path")).alias("dir"), "licence").agg(F.count(F.lit(1)).alias("n"))
    dirs = declared.groupBy("dir").agg(F.min_by("licence", F.struct(-F.col("n"), "licence")).alias("inherited"))

    steps = F.split(_parent(F.col("path")), "/", -1)
    ancestors = F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/")))
    wanting = own.filter("n_lines = 0").select("path").distinct().select("path", F.explode(ancestors).alias("dir"))
    nearest = wanting.join(dirs, "dir").groupBy("path").agg(F.max_by(F.struct("inherited", "dir"), F.length("dir")).alias("i"))
    inherits = F.col("n_lines") == 0
    return own.join(nearest, "path", "left").select(
        id_col, "path", "licence", "cosine", F.col("n_lines").cast("bigint").alias("n_lines"),
        F.when(inherits, F.col("i.inherited")).alias("inherited"), F.when(inherits, F.col("i.dir")).alias("inherited_from"),
    )
