"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Two kinds of units are compared with the templates by the cosine of their TF-IDF vectors:

- a header: any run of consecutive terms that is as long as the notice it is compared with. Line breaks,
  comment signs and what stands before or behind on the line don't matter, so wrapped notices, comment
  blocks and notices inside long lines are found;
- a whole file, compared with whole licence texts.

Document frequencies of all terms are counted over all documents. What a template's own terms weigh bounds
a unit's cosine from above (any other term weighs at least 1), so units that cannot reach the threshold go
in the pass over the texts; of overlapping headers the one with the highest bound stays. Equal units are
weighed once, with the true frequencies of all their terms. A file's licence is that of its best unit.

Licences of a family read almost alike, so their cosines can't tell them apart. A unit must hold the same telling terms
of the family (versions, "lesser", "sharealike", ...) as the template, and the sentence that two BSD licences share
goes by the clauses behind it.

A file without one takes that of the nearest directory above it that has one: directories are joined by
path. A directory's licence is the best of the files right in it.

Null and empty texts have no licence of their own; texts of any length are read whole; repeated rows are
files of their own, while a repeated key is one file whose best unit counts; ties go to the higher score,
then the licence that comes first by name; a null path inherits nothing; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import checkpointed

#: The notices by which common licences are named.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "The MIT License (MIT)"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "EPL-2.0": ["Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "CC0 1.0 Universal Public Domain Dedication", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
#: The elements of Creative Commons licences, and the names of their versions.
CC_ELEMENTS = {"NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
CC_KINDS = ("BY", "BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")
CC_VERSIONS = {"3.0": "Unported", "4.0": "International"}
for _version, _scope in CC_VERSIONS.items():
    for _kind in CC_KINDS:
        _long = "-".join(["Attribution", *(CC_ELEMENTS[x] for x in _kind.split("-")[1:])])
        TEMPLATES[f"CC-{_kind}-{_version}"] = [f"Licensed under CC {_kind} {_version}.", f"This work is licensed under a Creative Commons {_long} {_version} {_scope} License."]
#: Terms that tell the licences of a family apart. A unit only goes to a template with the same ones of them.
TELLING = {
    "GPL": ("lesser", "affero", "1", "2", "2.0", "2.1", "3", "3.0"),
    "CC": ("nc", "noncommercial", "sa", "sharealike", "nd", "noderivatives", "noderivs", "cc0", "1.0", "2.0", "2.5", "3.0", "4.0"),
    "BSD": ("1", "2", "3", "4", "neither"),
    "ISC": ("appear",),
}
#: What follows the sentence that BSD licences share, within AHEAD terms, where it is the one of two clauses.
SHARED = "redistribution"
TWO_CLAUSES = ("retain", "reproduce")
THIRD_CLAUSE = "neither"
CONDITION = "provided"
AHEAD = 120
#: The bodies of short licences, as licence files hold them.
LICENCE_FILES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}
#: Least cosines: of notices shorter than SHORT terms, where one other word may be another licence's name, and of longer units.
SHORT = 16
LEAST_SHORT = 0.9
LEAST = 0.75
_SPLIT = "[^a-z0-9.]+"


def terms_of(text: str) -> list[str]:
    return [t for t in (w.strip(".") for w in re.split(_SPLIT, text.lower())) if t]


def terms(text: Column) -> Column:
    """array<string>: runs of letters, digits and inner dots, in lower case."""
    return F.filter(F.transform(F.split(F.lower(text), _SPLIT), lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def all_frequencies(files: DataFrame, text: str) -> DataFrame:
    """(term, df): the files that hold each term, over all files; partial counts go to the shuffle."""
    return files.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def weight(df: float, n: int) -> float:
    """The inverse document frequency of a term that df of n files hold: 1 at least."""
    return math.log((1 + n) / (1 + df)) + 1


def family_of(licence: str) -> str | None:
    """The key in TELLING that a licence goes by."""
    return {"0BSD": "ISC"}.get(licence) or next((f for f in TELLING if f in licence), None)


@dataclass(frozen=True)
class Shape:
    """A template: its terms with their weights in a vector of length 1, and the least cosine to it.

    `own` are the telling terms of its family that a unit must hold, `others` those that it must not.
    """

    licence: str
    words: list[str]
    unit: dict[str, float]
    whole: bool

    @property
    def telling(self) -> tuple[str, ...]:
        # numbered clauses are no versions, so whole texts go by words alone
        return tuple(t for t in TELLING.get(family_of(self.licence), ()) if not (self.whole and t.isdigit()))

    @property
    def own(self) -> tuple[str, ...]:
        return tuple(t for t in self.telling if t in self.words)

    @property
    def others(self) -> tuple[str, ...]:
        return tuple(t for t in self.telling if t not in self.words)

    def follows(self, ahead: list[str]) -> bool:
        """Whether the terms behind a unit allow this template: they matter for the sentences that two licences share."""
        if self.licence == "0BSD":
            return CONDITION not in ahead[:3]  # the other one goes on with it
        if self.whole or self.words[0] != SHARED:
            return True
        two = set(TWO_CLAUSES) <= set(ahead) and THIRD_CLAUSE not in ahead
        return two == (self.licence == "BSD-2-Clause")

    @property
    def least(self) -> float:
        return LEAST if len(self.words) >= SHORT else LEAST_SHORT


def shapes_of(templates: dict[str, list[str]], licence_files: dict[str, str], idf: dict[str, float]) -> list[Shape]:
    out = []
    for name, text, whole in [(k, t, False) for k in sorted(templates) for t in templates[k]] + [(k, licence_files[k], True) for k in sorted(licence_files)]:
        words = terms_of(text)
        vector = {t: words.count(t) * idf[t] for t in words}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        out.append(Shape(name, words, {t: x / norm for t, x in vector.items()}, whole))
    return out


def needed(shape: Shape) -> set[str]:
    """Terms of which a unit must hold one to reach the least cosine: the others' weights cannot suffice."""
    need, rest = set(), 1.0
    for t in sorted(shape.unit, key=lambda t: (-shape.unit[t], t)):
        if math.sqrt(max(rest, 0)) < shape.least - 1e-6:
            break
        need.add(t)
        rest -= shape.unit[t] ** 2
    return need


def candidates(words: list[str], shapes: list[Shape], idf: dict[str, float], need: list[set[str]]) -> Iterator[tuple[int, str]]:
    """(shape, unit): the headers, and the whole file, whose bound reaches a template's least cosine and whose telling terms are
    the template's; terms joined by a space."""
    held = set(words)
    at_of: dict[str, np.ndarray] = {}

    def count(term: str) -> np.ndarray:
        """How often the term is among the first i words."""
        if term not in at_of:
            at_of[term] = np.cumsum(np.r_[0, np.fromiter((w == term for w in words), np.int64, len(words))]) if term in held else np.zeros(len(words) + 1, np.int64)
        return at_of[term]

    for k, shape in enumerate(shapes):
        if not need[k] & held or not held.issuperset(shape.own):
            continue
        x = np.array([idf[w] if w in shape.unit else 0.0 for w in words])
        dots = np.array([idf[w] * shape.unit.get(w, 0.0) if w in shape.unit else 0.0 for w in words])
        if shape.whole:
            tf = {t: 0 for t in shape.unit}
            for w in words:
                if w in tf:
                    tf[w] += 1
            norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()) + int((x == 0).sum()))
            if norm and dots.sum() / norm >= shape.least - 1e-6 and not held.intersection(shape.others):
                yield k, " ".join(words)
            continue
        m = min(len(shape.words), len(words))
        low = np.where(x > 0, x * x, 1.0)  # a term met more than once weighs at least this much
        total, norms = (np.cumsum(np.r_[0.0, a]) for a in (dots, low))
        bound = (total[m:] - total[:-m]) / np.sqrt(norms[m:] - norms[:-m])
        fits = bound >= shape.least - 1e-6
        for terms, there in ((shape.own, True), (shape.others, False)):
            for t in terms:
                c = count(t)
                fits &= (c[m:] > c[:-m]) == there
        starts = np.flatnonzero(fits)
        if not len(starts):
            continue
        for run in np.split(starts, np.flatnonzero(np.diff(starts) >= m) + 1):
            at = int(run[np.argmax(np.round(bound[run], 9))])
            if shape.follows(words[at + m : at + m + AHEAD]):
                yield k, " ".join(words[at : at + m])


def unit_scores(files: DataFrame, key: str, text: str, templates: dict[str, list[str]], licence_files: dict[str, str]) -> DataFrame:
    """(key, licence, score): for each file and licence, its best unit's cosine, from the template's least on."""
    counted = checkpointed(all_frequencies(files.filter(F.col(text).isNotNull()), text))
    n = files.count()
    vocabulary = sorted({t for texts in [*templates.values(), licence_files.values()] for x in texts for t in terms_of(x)})
    found = {r.term: r.df for r in counted.filter(F.col("term").isin(vocabulary)).collect()}  # at most the templates' terms
    idf = {t: weight(found.get(t, 0), n) for t in vocabulary}
    shapes = shapes_of(templates, licence_files, idf)
    need = [needed(s) for s in shapes]
    kind = files.schema[key].dataType.simpleString()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, unit) for i, t in enumerate(b.column("text").to_pylist()) for k, unit in candidates(terms_of(t), shapes, idf, need)]
            at, k, unit = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), pa.array(unit, pa.string())], ["key", "shape", "unit"])

    sure = "(?i)(?<![a-z0-9.])\\.*(?:" + "|".join(re.escape(t).replace("\\-", "-") for t in sorted(set().union(*need))) + ")(?![a-z0-9])"
    units = files.filter(F.col(text).rlike(sure)).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(pick, f"key {kind}, shape int, unit string")
    units = checkpointed(units.withColumn("mark", F.md5("unit")))
    once = units.groupBy("shape", "mark").agg(F.first("unit").alias("unit"))  # a notice that a third of all files hold is weighed once
    spread = once.select("shape", "mark", F.explode(F.split("unit", " ")).alias("term")).groupBy("shape", "mark", "term").agg(F.count(F.lit(1)).alias("tf"))
    weights = files.sparkSession.createDataFrame([(k, s.licence, s.least, t, w) for k, s in enumerate(shapes) for t, w in s.unit.items()], "shape int, licence string, least double, term string, w double")
    x = F.col("tf") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)
    weighed = spread.join(counted, "term").withColumn("x", x).join(F.broadcast(weights.select("shape", "term", "w")), ["shape", "term"], "left")
    cosine = F.round(F.try_divide(F.sum(F.col("x") * F.coalesce("w", F.lit(0.0))), F.sqrt(F.sum(F.col("x") * F.col("x")))), 6)
    scored = weighed.groupBy("shape", "mark").agg(cosine.alias("score")).join(F.broadcast(weights.select("shape", "licence", "least").distinct()), "shape").filter(F.col("score") >= F.col("least"))
    scored = checkpointed(scored)
    return units.select("key", "shape", "mark").join(scored.select("shape", "mark", "licence", "score"), ["shape", "mark"]).groupBy(F.col("key").alias(key), "licence").agg(F.max("score").alias("score"))


def directories(path: Column) -> Column:
    """array<string>: the directories above a path, nearest first; the root is ''."""
    parts = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", templates: dict[str, list[str]] | None = None, licence_files: dict[str, str] | None = None) -> DataFrame:
    """(key, path, own_licence, own_score, licence, inherited_from): the licence of every file.

    inherited_from is the directory whose licence the file takes, null if it has its own or none.
    """
    scores = unit_scores(files.select(key, text), key, text, TEMPLATES if templates is None else templates, LICENCE_FILES if licence_files is None else licence_files)
    own = scores.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("m")).select(key, F.col("m.licence").alias("own_licence"), (-F.col("m.s")).alias("own_score"))
    all_files = files.select(key, path).join(own, key, "left")
    licensed = all_files.filter("own_licence IS NOT NULL").filter(F.col(path).isNotNull())
    dirs = licensed.groupBy(directories(F.col(path))[0].alias("dir")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_licence").alias("licence"))).alias("m")).select("dir", F.col("m.licence").alias("dir_licence"))
    bare = all_files.filter("own_licence IS NULL").select(key, path)
    # files of one directory share their ancestors, so each directory is looked up once
    homes = bare.filter(F.col(path).isNotNull()).select(directories(F.col(path)).alias("up")).select("up", F.col("up")[0].alias("home")).groupBy("home").agg(F.first("up").alias("up"))
    near = homes.select("home", F.posexplode("up").alias("steps", "dir")).join(dirs, "dir").groupBy("home").agg(F.min(F.struct("steps", "dir", "dir_licence")).alias("m"))
    taken = bare.withColumn("home", F.when(F.col(path).isNotNull(), directories(F.col(path))[0])).join(near, "home", "left").select(key, path, F.lit(None).cast("string").alias("own_licence"), F.lit(None).cast("double").alias("own_score"), F.col("m.dir_licence").alias("licence"), F.col("m.dir").alias("inherited_from"))
    kept = all_files.filter("own_licence IS NOT NULL").select(key, path, "own_licence", "own_score", F.col("own_licence").alias("licence"), F.lit(None).cast("string").alias("inherited_from"))
    return kept.unionAll(taken)


def op3(docs: DataFrame) -> DataFrame:
    """The licence of every document; its place is its source, then the thousands and hundreds of its id."""
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", "text", path.alias("path")))
