"""Licences of files: sparse TF-IDF cosine of headers and licence files to templates, then nearest-ancestor inheritance.

Passages of a file are all its lines, all its blocks between blank lines and, for a licence file (see LICENCE_FILE), the
whole text. Words are runs of letters, digits, dots and dashes, lower-cased. A word weighs tf * idf with idf =
log((1 + t) / (1 + df)) + 1 over the t templates; words of no template have df 0, so that foreign text lowers a cosine.
The best template of a file's best passage at THRESHOLD or more is its own licence (ties: the smaller name). Neighbouring
licences differ in few words, so a template counts only if the passage names its version numbers and the same of the
words in DECIDING as the template does: a licence without a template gets no name rather than its neighbour's.

A directory's licence is that of its best licence file (highest cosine, then name). A file without a licence of its own
takes that of the nearest directory above it: the distinct directories are exploded to their ancestors and joined with
the licensed directories. One above more than HOT directories is spread over SALTS keys; the others have one row. Files meet
the result, one row per directory, in a plain join, which adaptive execution splits where a directory is hot.

Null and empty texts have no passages and can only inherit; a null path has no directory; repeated rows get equal
verdicts; very long texts are scanned whole; an empty table gives no rows; other columns than those asked to be kept go.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.scratch import written

THRESHOLD, SALTS, HOT = 0.6, 32, 512
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|copyright|notice)([^a-z].*)?$"
#: Words (also within others) that tell a licence from its neighbours.
DECIDING = ("affero", "lesser", "sharealike", "by-sa", "-sa ", "noderiv", "by-nd", "-nd ", "noncommercial", "by-nc")
#: A licence whose first clauses are those of another: what the text must hold besides.
REFINED = {"BSD-2-Clause": ("neither the name", "BSD-3-Clause")}
_WORD = re.compile(r"[0-9a-zà-ɏ](?:[0-9a-zà-ɏ.-]*[0-9a-zà-ɏ])?")

# Notices as their licences recommend or as they are commonly worded.
TEMPLATES = {
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
}


def decided(words: list[str]) -> tuple[frozenset[str], frozenset[str]]:
    """The DECIDING words of a passage, and its numbers without a trailing .0."""
    text = " ".join([*words, ""])
    return frozenset(d for d in DECIDING if d in text), frozenset(w.removesuffix(".0") for w in words if re.fullmatch(r"\d+(\.\d+)?", w))


class Matcher:
    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float) -> None:
        texts = [(name, Counter(_WORD.findall(t.lower()))) for name in sorted(templates) for t in templates[name]]
        df = Counter(w for _, tf in texts for w in tf)
        idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}
        self.threshold, self.idf, self.foreign = threshold, idf, math.log(1 + len(texts)) + 1
        self.names = [name for name, _ in texts]
        self.decided = [decided(_WORD.findall(t.lower())) for name in sorted(templates) for t in templates[name]]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for k, (_, tf) in enumerate(texts):
            norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in tf.items()))
            for w, n in tf.items():
                self.postings.setdefault(w, []).append((k, n * idf[w] / norm))

    def _cosine(self, words: list[str]) -> tuple[float, str] | None:
        """The best (cosine, name) at the threshold or above."""
        inside = [w for w in words if w in self.idf]
        # a passage's squared norm is at least that of its foreign words, each of which weighs `foreign` or more
        own = sum((n * self.idf[w]) ** 2 for w, n in Counter(inside).items())
        foreign = (len(words) - len(inside)) * self.foreign**2
        if not inside or own < self.threshold**2 * (own + foreign) * (1 - 1e-9):
            return None
        norm, dots = 0.0, dict.fromkeys(range(len(self.names)), 0.0)
        for w, n in Counter(words).items():
            weight = n * self.idf.get(w, self.foreign)
            norm += weight * weight
            for k, t in self.postings.get(w, ()):
                dots[k] += weight * t
        least, own_words = self.threshold * math.sqrt(norm), None
        for k in sorted((k for k in dots if dots[k] >= least), key=lambda k: (-round(dots[k], 9), k)):
            own_words = own_words or decided(words)
            if self.decided[k][0] == own_words[0] and self.decided[k][1] <= own_words[1]:
                return dots[k] / math.sqrt(norm), self.names[k]
        return None

    def best(self, text: str | None, licence_file: bool) -> tuple[float, str] | None:
        if not text:
            return None
        found, block = [], []
        for line in [*text.split("\n"), ""]:
            words = _WORD.findall(line.lower())
            if words:
                found.append(self._cosine(words))
                block.append(words)
            elif not line.strip():
                if len(block) > 1:
                    found.append(self._cosine([w for x in block for w in x]))
                block = []
        if licence_file:
            found.append(self._cosine(_WORD.findall(text.lower())))
        good = [x for x in found if x]
        if not good:
            return None
        cosine, name = min(good, key=lambda x: (-round(x[0], 9), x[1]))
        clause, fuller = REFINED.get(name, ("", name))
        return cosine, fuller if clause in " ".join(text.lower().split()) else name


def own_licences(files: DataFrame, keep: tuple[str, ...], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of keep and path, with directory, licence_file, own and cosine."""
    name, up = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/?[^/]*$", "")
    columns = list(dict.fromkeys([*keep, "path"]))
    given = files.select(*columns, up.alias("directory"), F.coalesce(name.rlike(LICENCE_FILE), F.lit(False)).alias("licence_file"), "text")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in batches:
            found = [matcher.best(t, f) for t, f in zip(batch.column("text").to_pylist(), batch.column("licence_file").to_pylist(), strict=True)]
            more = [pa.array([f and f[1] for f in found], pa.string()), pa.array([f and f[0] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], "own", "cosine"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "text")
    return given.mapInArrow(match, f"{kinds}, own string, cosine double")


def inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """directory, from_directory, inherited: for each directory the nearest licensed one among itself and those above."""
    parts = F.filter(F.split("directory", "/"), lambda x: x != "")
    depth = F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth")
    up = directories.select("directory", parts.alias("parts")).select("directory", "parts", depth)
    up = up.select("directory", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("above"))
    up = up.withColumn("own", F.pmod(F.xxhash64("directory"), F.lit(SALTS)).cast("int"))
    hot = up.groupBy("above").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    hot = written(hot.select("above", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("own")), "hot-directories")
    up = up.join(hot.withColumn("hot", F.lit(True)), ["above", "own"], "left")
    up = up.select("directory", "depth", "above", F.when(F.col("hot"), F.col("own")).otherwise(-1).alias("salt"))
    owners = licensed.select(F.col("directory").alias("above"), "licence")
    spread = owners.join(hot.withColumnRenamed("own", "salt"), "above").select("above", "salt", "licence")
    met = up.join(owners.select("above", F.lit(-1).alias("salt"), "licence").union(spread), ["above", "salt"])
    return met.groupBy("directory").agg(F.max_by(F.struct("above", "licence"), "depth").alias("x")).select("directory", F.col("x.above").alias("from_directory"), F.col("x.licence").alias("inherited"))


def scan(files: DataFrame, keep: tuple[str, ...] = (), templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files: path, text and the columns of keep. Returns keep, path, own, cosine, licence, from_directory (null where the
    licence is the file's own)."""
    own = written(own_licences(files, keep, templates, threshold), "licences")
    licensed = own.where("licence_file and own is not null").groupBy("directory").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("own").alias("licence"))).alias("x"))
    licensed = written(licensed.select("directory", "x.licence"), "licensed-directories")
    directories = own.where("own is null and directory is not null").select("directory").distinct()
    found = written(inherited(directories, licensed), "inherited")
    out = own.join(found, "directory", "left")
    return out.select(*dict.fromkeys([*keep, "path"]), "own", "cosine", F.coalesce("own", "inherited").alias("licence"), F.when(F.col("own").isNull(), F.col("from_directory")).alias("from_directory"))
