"""License scan: TF-IDF cosine of notices to templates, inherited down directories.

Around every licence cue of a file all windows of each template's number of
terms are compared with that template, and so are the cue's line, sentence and
run of adjacent cue lines with every template; the best of all counts. Terms
are weighted by their inverse document frequency over the templates, so what
stands beside a notice and how many files there are cannot hide it. A file
without a notice of its own takes the licence of the licence file in the
nearest directory above it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import cut

CUE = r"(?i)licen[cs]e|copyright|spdx-|permission is|redistribution|warrant(?:y|ies)|public domain"
_CUE = re.compile(CUE, re.ASCII)
_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_STOP = re.compile(r"[.!?](?=\s)|\n[^a-z0-9\n]*(?=\n)")

# Whole licence texts.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Licence notices, as their licences word them, and whole texts.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
        MIT_TEXT,
    ],
    "ISC": [ISC_TEXT, "SPDX-License-Identifier: ISC"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
        BSD_TEXT,
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 into the public domain.", "SPDX-License-Identifier: CC0-1.0"],
}


def template_table(spark: SparkSession, templates: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(name, f"{name}#{k}", text) for name, texts in (templates or TEMPLATES).items() for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "license string, template string, text string")


class Matcher:
    """Templates as unit TF-IDF vectors, and the best of them for a text."""

    def __init__(self, templates: list[tuple[str, str]], least: float):
        counts = [(name, Counter(_TERM.findall(text.lower()))) for name, text in templates]
        df = Counter(t for _, c in counts for t in c)
        idf = lambda n: 1 + math.log((len(counts) + 1) / (n + 1))
        self.least, self.weight, self.unseen = least, {t: idf(n) for t, n in df.items()}, idf(0)
        self.templates = []
        for name, c in counts:
            norm = math.sqrt(sum((n * self.weight[t]) ** 2 for t, n in c.items()))
            if norm:
                self.templates.append((name, sum(c.values()), {t: n * self.weight[t] / norm for t, n in c.items()}))

    def best(self, text: str) -> tuple[str, float] | None:
        """(license, score) of the text's best window; of equal scores the first license."""
        text = text.lower()
        cues = [(m.start(), m.end()) for m in _CUE.finditer(text)]
        found = [(m.start(), m.end(), m[0]) for m in _TERM.finditer(text)]
        if not cues or not found:
            return None
        starts, ends, words = ([f[k] for f in found] for k in range(3))
        at = [(max(0, bisect_left(ends, a + 1)), bisect_left(starts, b)) for a, b in cues]  # terms of each cue
        w = np.array([self.weight.get(t, self.unseen) for t in words])
        held, scores = set(words), []
        # no window is nearer to a template than its share of the terms that occur at all
        near = [x for x in self.templates if math.sqrt(sum(v * v for t, v in x[2].items() if t in held)) >= self.least - 1e-6]
        if not near:
            return None
        for a, b in self.spans(text, cues, starts):
            n = Counter(words[a:b])
            norm = math.sqrt(sum((k * self.weight.get(t, self.unseen)) ** 2 for t, k in n.items()))
            scores += [(sum(v * n[t] * self.weight[t] for t, v in vector.items() if t in n) / norm, name) for name, _, vector in near]
        number = {t: k for k, t in enumerate(held)}
        ids, norms = np.array([number[t] for t in words]), {}
        for name, size, vector in near:
            if size not in norms:
                norms[size] = self.windows(ids, w * w, at, size)
            places, norm = norms[size]
            dots = np.concatenate(([0.0], np.cumsum(w * np.array([vector.get(t, 0.0) for t in words]))))
            stop = np.minimum(places + size, len(words))
            scores.append((float(((dots[stop] - dots[places]) / norm).max()), name))
        score, name = min((-round(x, 6), name) for x, name in scores)
        return (name, -score) if -score >= self.least else None

    @staticmethod
    def spans(text: str, cues: list[tuple[int, int]], starts: list[int]) -> set[tuple[int, int]]:
        """Term ranges of the lines, sentences and runs of adjacent cue lines that hold the cues."""
        breaks = [m.start() for m in re.finditer("\n", text)]
        stops = [m.end() for m in _STOP.finditer(text)]
        lines = sorted({k for a, b in cues for k in range(bisect_left(breaks, a), bisect_left(breaks, b - 1) + 1)})
        edge = lambda cuts, k: 0 if k < 0 else cuts[k] if k < len(cuts) else len(text)
        out = {(edge(breaks, k - 1), edge(breaks, k)) for k in lines}
        out |= {(edge(stops, bisect_left(stops, a + 1) - 1), edge(stops, bisect_left(stops, b))) for a, b in cues}
        first = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or lines[k] != lines[k - 1] + 1:
                out.add((edge(breaks, lines[first] - 1), edge(breaks, lines[k - 1])))
                first = k
        ranges = {(bisect_left(starts, a), bisect_left(starts, b)) for a, b in out}
        return {(a, b) for a, b in ranges if a < b}

    @staticmethod
    def windows(ids: np.ndarray, squares: np.ndarray, at: list[tuple[int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of ``size`` terms that touch a cue, and their norms."""
        last = max(0, len(ids) - size)
        marks = np.zeros(last + 2, np.int64)
        for a, b in at:
            marks[min(max(0, a - size + 1), last)] += 1
            marks[min(max(b - 1, a), last) + 1] -= 1
        places = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        low, high = places[0], min(places[-1] + size, len(ids))
        part, sq = ids[low:high], squares[low:high]
        sums = np.concatenate(([0.0], np.cumsum(sq)))
        total = sums[np.minimum(places + size, len(ids)) - low] - sums[places - low]
        # twice the squares of each pair of equal terms inside a window
        order = np.argsort(part, kind="stable")
        same, lag = np.zeros(len(part) + 1), 1
        while lag < min(size, len(part)):
            i, j = order[:-lag], order[lag:]
            pair = (part[i] == part[j]) & (j - i < size)
            if not pair.any():
                break
            i, j = i[pair], j[pair]
            np.add.at(same, np.maximum(j - size + 1, 0), 2 * sq[i])
            np.add.at(same, i + 1, -2 * sq[i])
            lag += 1
        total = total + np.cumsum(same)[places - low]
        return places, np.sqrt(total)


def _match(matcher: Matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [matcher.best(t.as_py()) for t in batch.column(1)]
            hit = [k for k, g in enumerate(got) if g]
            columns = [batch.column(0).take(pa.array(hit, pa.int64())), pa.array([got[k][0] for k in hit], pa.string()), pa.array([got[k][1] for k in hit], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "license", "score"])

    return run


def own_licenses(files: DataFrame, templates: DataFrame, least: float = 0.6, key: str = "file") -> DataFrame:
    """(key, license, score) of files(key, text) whose best window is at least ``least`` like a template.

    The templates, whose number does not depend on the files, are sent to the tasks.
    """
    matcher = Matcher([(r.license, r.text) for r in templates.select("license", "text").collect()], least)
    schema = StructType().add(key, files.schema[key].dataType).add("license", StringType()).add("score", DoubleType())
    scored = files.where(F.col("text").rlike(CUE)).select(key, "text").mapInArrow(_match(matcher), schema)
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("license"))).alias("b"))
    return best.select(key, F.col("b.license").alias("license"), (-F.col("b.less")).alias("score"))


def ancestors(path: Column) -> Column:
    """Every directory above a path, nearest first; "" is the root."""
    parts = F.split(path, "/")
    return F.transform(F.reverse(F.sequence(F.lit(0), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, templates: DataFrame | None = None, license_file: Column | None = None, least: float = 0.6) -> DataFrame:
    """files(path, text, ...) with own_license, own_score, license, license_from, license_depth.

    ``license_file`` says which files with a notice speak for their directory;
    by default those named LICENSE, LICENCE, COPYING or NOTICE, with any
    extension. Of several in a directory the best score and then the first path
    counts. ``license_from`` is the file's own path or that of the licence file
    taken, ``license_depth`` the number of directories between them (0: its
    own notice or directory). Null texts are empty; a null path has no
    ancestors. Columns of files with these names are replaced; every row is
    kept, repeated ones included.
    """
    named = F.lower(F.element_at(F.split("path", "/"), -1)).rlike(r"^(?:licen[cs]e|copying|notice)(?:\.[a-z0-9]+)?$")
    license_file = named if license_file is None else license_file
    made = ["own_license", "own_score", "license", "license_from", "license_depth"]
    files = files.drop(*made)
    keyed = files.withColumn("_file", F.sha2(F.concat_ws("\x00", F.coalesce("path", F.lit("")), F.coalesce("text", F.lit(""))), 256)).withColumn("_speaks", license_file)
    unique = keyed.select("_file", "text").dropDuplicates(["_file"])
    own = cut(own_licenses(unique, templates if templates is not None else template_table(files.sparkSession), least, "_file"))
    placed = keyed.join(own.select("_file", F.col("license").alias("own_license"), F.col("score").alias("own_score")), "_file", "left")

    speaking = placed.where(F.col("_speaks") & F.col("own_license").isNotNull() & F.col("path").isNotNull())
    folder = F.get(ancestors(F.col("path")), F.lit(0))
    choice = F.min(F.struct((-F.col("own_score")).alias("less"), F.col("path"), F.col("own_license"))).alias("c")
    heads = speaking.groupBy(folder.alias("folder")).agg(choice).select("folder", F.col("c.path").alias("head"), F.col("c.own_license").alias("given"))

    needy = placed.where("own_license is null and path is not null").select("path").distinct()
    above = needy.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "folder")).join(heads, "folder")
    nearest = above.groupBy("path").agg(F.min(F.struct("depth", "head", "given")).alias("near"))
    out = placed.join(nearest, "path", "left")
    return out.select(
        *[F.col(f"`{c}`") for c in files.columns],
        "own_license",
        "own_score",
        F.coalesce("own_license", "near.given").alias("license"),
        F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("near.head")).alias("license_from"),
        F.when(F.col("own_license").isNotNull(), F.lit(0)).otherwise(F.col("near.depth")).alias("license_depth"),
    )
