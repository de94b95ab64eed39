"""Licence scan: TF-IDF cosine of lines to templates, inherited down directories.

1. A header block is a run of lines without an empty one, comment markers stripped. Its sentences
   that hold a trigger, by line and with wrapped lines joined, the whole block and the whole text are candidates.
   They and each template are sparse TF-IDF vectors over the templates' words; document frequencies of
   those words are counted over all lines' documents. The best template of
   cosine ``COSINE`` or more is the file's licence (``direct``); a copyright line's "All rights
   reserved" counts only where no licence is named, and an SPDX tag of a template's name has cosine 1.
   The version and the qualifiers (lesser, affero, nc, sa, nd) of a template must be the header's, and a text without a clear
   lead of one licence is not named. Templates are notices, standard headers and, for the short licences, their texts.
2. A file named like a licence file (or any file that ``is_licence`` marks) gives
   its directory that licence.
3. A file without one takes it from the nearest ancestor directory that has one:
   its ancestor paths are joined with the directories' licences and the deepest match stays.

The template vocabulary is fixed, so document frequencies are a bounded table; directories
meet files by a join on the path and a salt, with one row per directory (its best cosine, ties to
the template's name), so a root that every file inherits from is no hot key.

Edge cases: null or empty texts have no own licence and may inherit; a null path
inherits nothing and is no directory; cosines of two licences closer than ``MARGIN`` name none; several licence files of
one directory: the highest cosine, then name; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bits
from .common import ready, spill, text_of, word_count

COSINE = 0.5
SHORT = 40  # words of a document that stands for its directory's licence file (query only)

SALTS = 16  # join keys that a directory's heirs are spread over
MARGIN = 0.01  # lead over the next licence below which a text is not named

_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.")
_BSD_END = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
            "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} License as published by the "
        "Free Software Foundation, either version {1} of the License, or (at your option) any later version.")

# FIXED VALUES: notices, standard headers and short licence texts by licence
TEMPLATES = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3", _GNU.format("Affero General Public", 3)),
    "Apache-1.1": ("Licensed under the Apache Software License, Version 1.1", "The Apache Software License, Version 1.1"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
                   "express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", "Simplified BSD License", _BSD, _BSD + _BSD_END),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License",
                     _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                     "from this software without specific prior written permission." + _BSD_END),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0",),
    "CC-BY-3.0": ("Licensed under CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("Creative Commons CC0 1.0 Universal",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", _GNU.format("General Public", 2)),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", _GNU.format("General Public", 3)),
    "ISC": ("Licensed under the ISC License",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies."),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1", _GNU.format("Lesser General Public", "2.1")),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3", _GNU.format("Lesser General Public", 3)),
    "MIT": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to "
            "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "Proprietary": ("All rights reserved",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}
# FIXED VALUES: words that tell licences of one family apart, and how they are abbreviated
QUALIFIERS = {"lesser": "lesser", "affero": "affero", "noncommercial": "nc", "nc": "nc", "sharealike": "sa", "sa": "sa",
              "noderivatives": "nd", "noderivs": "nd", "nd": "nd"}
_NUMBER = re.compile(r"\d+(?:\.\d+)?")
# lower case; a line without any of them is no candidate
TRIGGERS = ("licens", "licenc", "rights reserved", "redistribution and use", "permission is hereby", "creative commons", "cc by", "cc-by",
            "permission to use, copy", "general public", "public domain")
LICENCE_NAME = r"(?i)^(licen[sc]e|copying|notice|unlicense)([-._].*)?$"
_TERM = re.compile(r"[a-z0-9]+(?:[-.][a-z0-9]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])(?<!\sv\.)\s+")
_MARKER = re.compile(r"^\s*(?:/\*+|\*+/?|//+|#+|;+|--+|<!--)?\s*|\s*(?:\*+/|-->)?\s*$")
_SPDX = re.compile(r"spdx-license-identifier:\s*\(?([a-z0-9.+-]+)")
RESERVED = "Proprietary"  # only where no licence is named


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def numbers(text: str) -> set[str]:
    """Version numbers of a text, without a closing ".0"."""
    return {x.removesuffix(".0") for x in _NUMBER.findall(text.lower())}


def qualifiers(counts) -> set[str]:
    return {QUALIFIERS[p] for t in counts for p in re.split("[-.]", t) if p in QUALIFIERS}


def _version(name: str) -> str | None:
    """The version that a licence's name ends with."""
    found = re.search(r"-(\d+\.\d+)$", name)
    return found[1].removesuffix(".0") if found else None


VOCABULARY = sorted({t for notices in TEMPLATES.values() for x in notices for t in terms(x)})


BY_ID = {k.lower(): k for k in TEMPLATES if k != RESERVED}
HINTS = tuple(sorted({t.split()[0] for t in TRIGGERS}))  # a wrapped trigger's first word is still whole


def headers(text: str) -> list[str]:
    """The candidates, lower-cased: sentences by line and by block, whole blocks, and the whole text."""
    low, found = text.lower(), {}
    if not any(t in low for t in HINTS):
        return []
    held: list[str] = []
    for line in [*low.split("\n"), ""]:
        line = _MARKER.sub("", line)
        if line:
            held.append(line)
            continue
        block = " ".join(held)
        if any(t in block for t in TRIGGERS):
            for part in (*held, block):
                found.update((x, None) for x in _SENTENCE.split(part) if any(t in x for t in TRIGGERS))
            found[block] = None
        held = []
    found[" ".join(_MARKER.sub("", line) for line in low.split("\n"))] = None  # a licence file as a whole
    return list(found)


class Scanner:
    """Template vectors under given document frequencies."""

    def __init__(self, df: dict[str, int], n: int):
        self.idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in VOCABULARY}
        self.other = math.log(n + 1) + 1  # words of a header that no template has
        self.templates = [(k, _version(k), qualifiers(terms(x)), self._vector(Counter(terms(x))))
                          for k, notices in sorted(TEMPLATES.items()) for x in notices]

    def _vector(self, counts: Counter) -> dict[str, float]:
        v = {t: c * self.idf[t] for t, c in counts.items() if t in self.idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    def best(self, text: str) -> tuple[str | None, float]:
        """(template, cosine) of the best header, (None, 0) below ``COSINE`` or without a clear lead.

        A template of another version or qualifier (lesser, affero, nc, sa, nd) than the header's is no match
        however many words they share.
        """
        best: dict[str, float] = {}
        for h in headers(text):
            for tag in _SPDX.findall(h):
                tag = BY_ID.get(re.sub("-(only|or-later)$", "", tag.rstrip(".")))
                if tag is not None:
                    best[tag] = 1.0
            counts = Counter(terms(h))
            v = {t: c * self.idf.get(t, self.other) for t, c in counts.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            versions, kinds = numbers(h), qualifiers(counts)
            for k, version, own, template in self.templates:
                if norm and own == kinds and (version is None or version in versions):
                    best[k] = max(best.get(k, 0.0), sum(x * v.get(t, 0.0) for t, x in template.items()) / norm)
        reserved = best.pop(RESERVED, 0.0)
        ranked = sorted(((c, k) for k, c in best.items() if c >= COSINE), key=lambda x: (-x[0], x[1]))
        if ranked and (len(ranked) == 1 or ranked[0][0] - ranked[1][0] >= MARGIN):
            return ranked[0][1], ranked[0][0]
        return (RESERVED, reserved) if reserved >= COSINE and not ranked else (None, 0.0)


def _term_counts(batches):
    df, known = Counter(), set(VOCABULARY)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            df.update(known.intersection(_TERM.findall(text.lower())))
    yield pa.RecordBatch.from_pylist([{"term": t, "n": n} for t, n in df.items()],
                                     schema=pa.schema([("term", pa.string()), ("n", pa.int64())]))


def ancestors(path: Column) -> Column:
    """The directories above a path, from its own directory to the root ("")."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1),
                       lambda k: F.array_join(F.slice(parts, 1, F.size(parts) - 1 - k), "/"))


def scan(files: DataFrame, is_licence: Column | None = None) -> DataFrame:
    """``files``: file_id, path, text. Per row: file_id, path, licence, cosine, origin
    ("direct", "inherited", "none") and directory it came from.

    ``is_licence`` marks the licence files; by default the last part of the path decides.
    """
    spark = files.sparkSession
    ready(spark)
    mark = is_licence if is_licence is not None else F.element_at(F.split("path", "/"), -1).rlike(LICENCE_NAME)
    base = files.withColumn("text", text_of()).select(
        "file_id", F.col("path").cast("string").alias("path"), "text", F.coalesce(mark, F.lit(False)).alias("mark"))
    counted = base.select("text").mapInArrow(_term_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    scanner = spark.sparkContext.broadcast(Scanner({r.term: r.n for r in counted.collect()}, base.count()))

    def run(batches):
        for batch in batches:
            found = [scanner.value.best(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("file_id"), batch.column("path"), batch.column("mark"),
                                   pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                  names=["file_id", "path", "mark", "own", "own_cosine"])

    kind = dict(base.dtypes)["file_id"]
    own = spill(base.mapInArrow(run, f"file_id {kind}, path string, mark boolean, own string, own_cosine double"), "licences")
    own = own.withColumn("row", F.monotonically_increasing_id())
    directory = F.element_at(ancestors(F.col("path")), 1)
    givers = (own.filter(F.col("mark") & F.col("own").isNotNull() & F.col("path").isNotNull())
              .groupBy(directory.alias("directory"))
              .agg(F.min_by(F.struct("own", "own_cosine"), F.struct(-F.col("own_cosine"), "own")).alias("given")))
    givers = spill(givers, "directories")
    table = bits.bit_table(givers.select(F.xxhash64("directory")))
    heirs = own.filter(F.col("own").isNull() & F.col("path").isNotNull()).select(
        "row", F.posexplode(ancestors(F.col("path"))).alias("up", "directory"))
    heirs = heirs.filter(bits.maybe_in(table, F.xxhash64("directory"))).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    spread = givers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # the nearest directory: the least number of steps up, pre-aggregated
    nearest = (heirs.join(spread, ["directory", "salt"]).groupBy("row")
               .agg(F.min_by(F.struct("directory", "given"), "up").alias("near")))
    out = own.join(nearest, "row", "left")
    licence = F.coalesce("own", "near.given.own")
    return out.select("file_id", "path", licence.alias("licence"),
                      F.coalesce(F.when(F.col("own").isNotNull(), F.col("own_cosine")), F.col("near.given.own_cosine"), F.lit(0.0)).alias("cosine"),
                      F.when(F.col("own").isNotNull(), "direct").when(licence.isNotNull(), "inherited").otherwise("none").alias("origin"),
                      F.when(F.col("own").isNull(), F.col("near.directory")).alias("directory"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """The scan over ``documents`` as a file tree source/lang/(doc_id div 100)/doc_id; a document
    of at most ``SHORT`` words stands for its directory's licence file."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    files = docs.select(F.col("doc_id").cast("long").alias("file_id"),
                        F.concat_ws("/", part("source"), part("lang"), F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("_")),
                                    part("doc_id")).alias("path"), F.col("text"))
    return scan(files, word_count(F.col("text")) <= SHORT).withColumnRenamed("file_id", "doc_id")
