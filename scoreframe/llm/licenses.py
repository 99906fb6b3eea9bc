"""Licence scans: TF-IDF cosine of notices to templates, then inheritance along directories.

A notice is a sentence or line anywhere in a file, two neighbouring ones, and for a licence
file (by its name) also its whole text. Words are weighted by their number and by the inverse
document frequency, counted for every word over all files. A template is a licence's text or
a notice in common use; one that names a version only counts where the notice has its numbers.
The best template at ``cosine`` or more is the file's own licence. A directory has the licence
of its best licence file. A file without a licence of its own takes that of its nearest
ancestor directory, found by joins on directory paths.

A notice can only reach the cosine if it holds one of the templates' key words: the others
are the commonest words of a template, as many as stay below it together, whatever else the
notice says. Notices without any are left out before words are dealt, which loses nothing,
and notices of the same text are judged once for all their files. Everything is DataFrame
functions; only the weights of the templates' words reach the driver.

Defined results: a missing text is empty and has no licence of its own; a missing path lies
in no directory and inherits nothing; equal rows get equal results, and of several files at
one path each is judged on its own; ties go to the template named first by code point and
the first path; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.text import quoted, whole
from scoreframe.session import cut_lineage

COSINE = 0.6
# Licence texts and notices in common use, by SPDX name.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so, subject to the following conditions: ")
MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
    "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. ")
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. ")
BSD_REST = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License, Version 2.0, http://www.apache.org/licenses/"),
    ("BSD-2-Clause", BSD_GRANT + BSD_REST),
    ("BSD-3-Clause", BSD_GRANT + BSD_NAMES + BSD_REST),
    ("BSD-3-Clause", BSD_NAMES),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright, CC0 public domain dedication"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LicenseRef-reserved", "Copyright. All rights reserved"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "MIT License, Copyright"),
    ("MIT", MIT_GRANT),
    ("MIT", MIT_GRANT + MIT_REST),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
WORD_BREAKS = r"[^\p{L}\p{N}]+"


def terms_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), WORD_BREAKS), "")


def _counted(text: str) -> dict[str, int]:
    counts: dict[str, int] = {}
    for term in re.findall(r"[^\W_]+", text.lower()):
        counts[term] = counts.get(term, 0) + 1
    return counts


def frequencies(files: DataFrame) -> DataFrame:
    """(term, df): in how many files each word occurs; one pre-aggregated shuffle, written once."""
    return cut_lineage(files.select(F.explode(F.array_distinct(terms_of(whole()))).alias("term")).groupBy("term").agg(F.count("*").alias("df")))


def key_terms(vectors: list[dict[str, float]], idf: dict[str, float], found: set[str], cosine: float) -> list[str]:
    """Per template the words but the commonest, as many as cannot reach the cosine alone; words of no file are none."""
    keys = set()
    for vector in vectors:
        left = cosine * cosine * sum(w * w for w in vector.values()) * 0.999
        for term in sorted(found & vector.keys(), key=lambda t: (idf[t], t)):
            if vector[term] ** 2 < left:
                left -= vector[term] ** 2
            else:
                keys.add(term)
    return sorted(keys)


def notices_of(files: DataFrame, keys: list[str]) -> DataFrame:
    """(key, words): sentences and lines, neighbouring ones in pairs, and the whole of a licence file, if they hold a key word.

    Every line is searched once; a pair or a file holds a key word if one of its lines does.
    """
    holds_key = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(keys)})(?![\p{{L}}\p{{N}}])" if keys else "(?!)"
    lines = F.filter(F.split(whole(), r"\n|(?<=[.!?;])[\x20\t]+"), lambda s: F.trim(s) != "")
    marked = files.select("key", "path", whole().alias("text"), F.transform(lines, lambda s: F.struct(s.alias("s"), s.rlike(holds_key).alias("hit"))).alias("lines"))
    is_file = F.coalesce(F.col("path"), F.lit("")).rlike(LICENSE_FILE) & F.exists("lines", lambda x: x["hit"])
    file = F.when(is_file, F.array("text")).otherwise(F.array().cast("array<string>"))
    own = F.transform(F.filter("lines", lambda x: x["hit"]), lambda x: x["s"])
    after = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    pairs = F.zip_with("lines", after, lambda a, b: F.when(a["hit"] | b["hit"], F.concat_ws(" ", a["s"], b["s"])))
    found = F.array_distinct(F.concat(file, own, F.filter(pairs, lambda s: s.isNotNull())))
    return marked.select("key", F.explode(found).alias("words"))


def own_licenses(files: DataFrame, templates: Iterable[tuple[str, str]], cosine: float = COSINE) -> DataFrame:
    """(key, license, score) of the files (key, path, text) that have a licence of their own."""
    named = [(name, _counted(text)) for name, text in templates]
    vocabulary = sorted({t for _, counts in named for t in counts})
    spark, n_files, table = files.sparkSession, files.count(), frequencies(files)
    inverse = F.log((1.0 + F.lit(float(n_files))) / (1.0 + F.col("df"))) + 1.0
    known = table.join(F.broadcast(spark.createDataFrame([(t,) for t in vocabulary], "term string")), "term")
    idf = {t: math.log(1.0 + n_files) + 1.0 for t in vocabulary}
    in_files = {r.term: r.idf for r in known.select("term", inverse.alias("idf")).collect()}
    idf |= in_files
    vectors = [{t: n * idf[t] for t, n in counts.items()} for _, counts in named]
    lengths = [math.sqrt(sum(w * w for w in v.values())) for v in vectors]
    numbers = [sum(t.isdigit() for t in v) for v in vectors]
    of_template = spark.createDataFrame(
        [(t, name, i, w / lengths[i], t.isdigit(), numbers[i]) for i, ((name, _), v) in enumerate(zip(named, vectors, strict=True)) for t, w in v.items()],
        "term string, license string, template int, share double, number boolean, numbers int")
    held = cut_lineage(notices_of(files, key_terms(vectors, idf, in_files.keys(), cosine)))
    notice = F.unhex(F.md5("words")).alias("notice")
    texts = held.select("words").distinct().select(notice, "words")  # named before the words are dealt, so once a text
    terms = texts.select("notice", F.explode(terms_of(F.col("words"))).alias("term")).groupBy("notice", "term").count()
    weighted = cut_lineage(terms.join(table, "term").withColumn("w", F.col("count") * inverse).drop("df"))
    length = weighted.groupBy("notice").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = weighted.join(F.broadcast(of_template), "term").groupBy("notice", "template", "license").agg(
        F.sum(F.col("w") * F.col("share")).alias("dot"), (F.count_if("number") == F.max("numbers")).alias("versions"))
    scores = dots.where("versions").join(length, "notice").withColumn("score", F.round(F.col("dot") / F.col("length"), 9))
    given = F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best")
    of_notice = cut_lineage(scores.where(F.col("score") >= cosine).groupBy("notice").agg(given))
    best = held.select("key", notice).join(of_notice, "notice").groupBy("key").agg(F.min("best").alias("best"))
    return best.select("key", "best.license", (-F.col("best.minus")).alias("score"))


def directories(path: Column) -> Column:
    """All directories above a path, the root ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))


def scan(files: DataFrame, templates: Iterable[tuple[str, str]] | None = None, cosine: float = COSINE) -> DataFrame:
    """(path, license, score, origin, from_directory) of each row of (path, text, ...).

    ``origin`` is ``own``, ``inherited`` or NULL. Other columns of ``files`` are kept, but
    for those named like a result.
    """
    results = ("license", "score", "origin", "from_directory")
    kept = [c for c in files.columns if c not in (*results, "text")]
    key = F.unhex(F.md5(F.concat_ws(":", F.col("path").isNull(), F.col("path"), whole())))  # 16 bytes a file
    own = cut_lineage(own_licenses(files.select(key.alias("key"), "path", "text"), templates or TEMPLATES, cosine))
    own = own.select(F.col("key").alias("_key"), F.col("license").alias("_own"), F.col("score").alias("_score"))
    # the columns that are kept travel as one, so their names meet none of the names used here
    known = cut_lineage(files.select(F.struct(*map(quoted, kept)).alias("row"), F.col("path"), key.alias("_key")).join(own, "_key", "left"))
    parent = F.element_at(directories(F.col("path")), -1)
    of_directory = cut_lineage(
        known.where(F.col("_own").isNotNull() & F.col("path").rlike(LICENSE_FILE)).groupBy(parent.alias("directory"))
        .agg(F.min(F.struct((-F.col("_score")).alias("minus"), "path", "_own")).alias("best"))
        .select("directory", F.col("best._own").alias("given")))
    orphans = known.where("_own is null and path is not null").select("path").distinct()
    above = orphans.select("path", F.posexplode(directories(F.col("path"))).alias("depth", "directory"))
    nearest = above.join(of_directory, "directory").groupBy("path").agg(
        F.max(F.struct("depth", "directory", "given")).alias("near")).select(
        F.col("path").alias("_at"), F.col("near.directory").alias("_directory"), F.col("near.given").alias("_given"))
    joined = known.join(nearest, F.expr("_own is null and path = _at"), "left")
    origin = F.when(F.col("_own").isNotNull(), "own").when(F.col("_given").isNotNull(), "inherited")
    return joined.select("row.*", F.coalesce("_own", "_given").alias("license"), F.col("_score").alias("score"),
                         origin.alias("origin"), F.col("_directory").alias("from_directory"))
