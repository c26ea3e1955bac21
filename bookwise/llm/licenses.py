"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bookwise.functions.staging import stage
from bookwise.llm.common import small, table

# The notices by which the licenses are applied, as their publishers word them.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Header paragraphs, titles of licence files, and whole licences where they are short.
_GNU = [
    ("AGPL-3.0", "Affero ", "3", "19 November 2007"), ("GPL-2.0", "", "2", "June 1991"), ("GPL-3.0", "", "3", "29 June 2007"),
    ("LGPL-2.1", "Lesser ", "2.1", "February 1999"), ("LGPL-3.0", "Lesser ", "3", "29 June 2007"),
]
for _name, _kind, _version, _day in _GNU:
    TEMPLATES += [(_name, f"GNU {_kind}General Public License Version {_version}, {_day}")] + [
        (_name, f"This {_work} is free software: you can redistribute it and/or modify it under the terms of the GNU {_kind}General Public License as published by the Free Software Foundation, either version {_version} of the License, or (at your option) any later version.")
        for _work in ("program", "library")
    ]
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES += [
    ("MIT", _MIT), ("MIT", f"{_MIT} {_MIT_REST}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_REST}"), ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_REST}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
_SPDX = "Apache-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 ISC MIT MPL-2.0 Unlicense".split()
TEMPLATES += [(_name, f"SPDX-License-Identifier: {_name}") for _name in _SPDX]
TEMPLATES += [(_name, f"SPDX-License-Identifier: {_name}{_end}") for _name, *_ in _GNU for _end in ("", "-only", "-or-later")]
#: Least cosine of a match.
THRESHOLD = 0.7
# Common English words, taken as anchors last.
COMMON = frozenset(
    "a above all an and any are as at be but by can do either even except following for found free from however if in into is it its list met name"
    " no not of on only or other out so subject such that the their these this to under use v way with without work you your".split()
)
# Words without weight, of which long licences and prose alike are full.
STOP = frozenset("a all an and any are as at be by do for if in is it of on or so that the this to".split())
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
TAG = r"<[^>]*>"
#: A line end and the lines without terms after it: what parts two paragraphs.
GAP = r"(?>\r\n|\n|\r)(?:[^a-z0-9\r\n]*+(?>\r\n|\n|\r))+"
#: Files that state the license of their directory, by name; an index page (a path that ends in /) does as well.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|index)(\.[^/]*)?$"


def weights() -> tuple[dict[str, float], float, list[tuple[int, str, str, float]]]:
    """Inverse document frequency of the templates' terms and of unknown terms, and unit template vectors (number, license, term, weight)."""
    terms = [Counter(re.findall(TERM, text.lower())) for _, text in TEMPLATES]
    found = Counter(w for t in terms for w in t)
    idf = {w: math.log((1 + len(terms)) / (1 + n)) + 1 for w, n in sorted(found.items())} | dict.fromkeys(sorted(STOP), 0.0)
    rows = []
    for i, ((name, _), counts) in enumerate(zip(TEMPLATES, terms)):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in counts.items()))
        rows += [(i, name, w, n * idf[w] / norm) for w, n in sorted(counts.items()) if idf[w]]
    return idf, math.log(1 + len(terms)) + 1, rows


def anchors(threshold: float = THRESHOLD) -> list[str]:
    """Terms one of which every match contains: without them no template keeps ``threshold`` of its norm."""
    rest: dict[int, list] = {}
    for i, _, word, weight in weights()[2]:
        rest.setdefault(i, []).append((weight, word))
    chosen: set[str] = set()
    for words in rest.values():
        left = sum(w * w for w, word in words if word not in chosen)
        for weight, word in sorted(words, key=lambda x: (x[1] in COMMON, len(x[1]) < 3, -x[0], x[1])):
            if left < (threshold - 1e-9) ** 2:
                break
            if word not in chosen:
                chosen.add(word)
                left -= weight * weight
    return sorted(chosen)


def may_match(text: Column, threshold: float = THRESHOLD) -> Column:
    """Whether a template keeps ``threshold`` of its norm in the terms of ``text``: no part of another text can match, by the inequality of Cauchy and Schwarz."""
    vectors = weights()[2]
    shares: dict[str, list[float]] = {}
    for template, _, term, weight in vectors:
        shares.setdefault(term, [0.0] * len(TEMPLATES))[template] = weight * weight
    held = F.array_intersect(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lit(sorted(shares)))
    table_ = F.from_json(F.lit(json.dumps(shares)), "map<string,array<double>>")
    mass = F.aggregate(held, F.array_repeat(F.lit(0.0), len(TEMPLATES)), lambda total, term: F.zip_with(total, F.element_at(table_, term), lambda a, b: a + b))
    return F.array_max(mass) >= threshold * threshold - 1e-6


def _matches(texts: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """Best template of each text: the key, license, similarity.

    Compared are every block between tags and line ends, every paragraph of
    several blocks, the first paragraphs together (2, 3, ... all of them), and the
    whole text where ``whole`` is true. Of the first paragraphs together norm and
    products are running sums, so their cost grows with the text and not with the
    number of paragraphs times the text.
    """
    spark = texts.sparkSession
    idf, unknown, vectors = weights()
    known = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    by_term: dict[str, list] = {}
    for template, license_, term, weight in vectors:
        by_term.setdefault(term, []).append((template, license_, weight))
    model = F.broadcast(spark.createDataFrame(list(by_term.items()), "term string, templates array<struct<template:int,license:string,weight:double>>"))
    hint = r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, anchors(threshold))) + r")(?![a-z0-9])"
    plain = texts.select(*key, "whole", F.lower(F.regexp_replace("body", TAG, "\n")).alias("plain"))
    # what no template can match as a whole holds no part that one matches; both branches below read what is left
    plain = stage(plain.where(may_match(F.col("plain"), threshold)), "license-texts")
    split = plain.withColumn("paragraphs", F.split("plain", GAP))
    units = F.concat(
        F.split("plain", r"[\r\n]+"),
        F.filter("paragraphs", lambda p: p.rlike(r"[\r\n]")),
        F.when(F.col("whole"), F.array("plain")).otherwise(F.array().cast("array<string>")),
    )
    hit = split.select(*key, F.explode(F.filter(F.array_distinct(units), lambda b: b.rlike(hint))).alias("block"))
    # equal blocks of one text count once; a block is known by its hash from here on
    terms = hit.select(*key, F.xxhash64("block").alias("block"), F.explode(F.regexp_extract_all("block", F.lit(TERM), F.lit(0))).alias("term"))
    # one exchange brings a block's terms together; counts, norm and products follow in the same tasks
    unit = [*key, "block"]
    counted = terms.repartition(*unit).groupBy(*unit, "term").agg(F.count(F.lit(1)).alias("tf"))
    # a block that occurs k times has k times the counts: the cosine is the same
    valued = counted.join(known, "term", "left").withColumn("value", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    # template -1 stands for the squared norm
    square = F.struct(F.lit(-1).alias("template"), F.lit(None).cast("string").alias("license"), F.col("value").alias("weight"))
    parts = F.concat(F.array(square), F.coalesce("templates", F.array().cast("array<struct<template:int,license:string,weight:double>>")))
    summed = valued.join(model, "term", "left").select(*unit, "value", F.inline(parts)).groupBy(*unit, "template", "license").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    # at most one row per template
    norm = F.max(F.when(F.col("template") == -1, F.sqrt("dot"))).alias("norm")
    dots = F.collect_list(F.when(F.col("template") >= 0, F.struct("template", "license", "dot"))).alias("dots")
    scored = summed.groupBy(*unit).agg(norm, dots).select(*key, "norm", F.inline("dots"))
    scored = scored.select(*key, "template", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity"))
    good = scored.unionByName(_heads(split, key, known, unknown, model)).where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("template")).alias("low"), "license")).alias("best")
    return good.groupBy(*key).agg(best).select(*key, "best.license", "best.similarity")


def _heads(split: DataFrame, key: list[str], known: DataFrame, unknown: float, model: DataFrame) -> DataFrame:
    """Similarity of the first paragraphs of each text to the templates, where the last of them adds to the product: the key, template, license, similarity.

    Where a paragraph adds nothing to a product the similarity falls, so no match is missed.
    """
    several = split.where(F.size("paragraphs") > 1).select(*key, F.posexplode("paragraphs").alias("k", "block"))
    terms = several.select(*key, "k", F.explode(F.regexp_extract_all("block", F.lit(TERM), F.lit(0))).alias("term"))
    # one exchange by text; the windows of one text are as long as that text
    counted = terms.repartition(*key).groupBy(*key, "term", "k").agg(F.count(F.lit(1)).alias("tf"))
    so_far = F.sum("tf").over(Window.partitionBy(*key, "term").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    valued = counted.withColumn("now", so_far).join(known, "term", "left").withColumn("idf", F.coalesce("idf", F.lit(unknown))).where("idf > 0")
    # template -1 stands for the squared norm
    grown = (F.col("now") * F.col("now") - (F.col("now") - F.col("tf")) * (F.col("now") - F.col("tf"))) * F.col("idf") * F.col("idf")
    square = F.struct(F.lit(-1).alias("template"), F.lit(None).cast("string").alias("license"), grown.alias("weight"))
    added = F.transform("templates", lambda t: F.struct(t.template.alias("template"), t.license.alias("license"), (t.weight * F.col("tf") * F.col("idf")).alias("weight")))
    parts = F.concat(F.array(square), F.coalesce(added, F.array().cast("array<struct<template:int,license:string,weight:double>>")))
    steps = valued.join(model, "term", "left").select(*key, "k", F.inline(parts)).groupBy(*key, "template", "license", "k").agg(F.sum("weight").alias("step"))
    running = F.sum("step").over(Window.partitionBy(*key, "template", "license").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    # at most one row per template
    norm = F.max(F.when(F.col("template") == -1, F.sqrt("dot"))).alias("norm")
    dots = F.collect_list(F.when(F.col("template") >= 0, F.struct("template", "license", "dot"))).alias("dots")
    scored = steps.withColumn("dot", running).groupBy(*key, "k").agg(norm, dots).select(*key, "norm", F.inline("dots"))
    return scored.select(*key, "template", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(file_id, path, license, similarity, how, from_dir) of every row of ``files`` (file_id, path, body).

    A file's own notice counts first (``how`` = header). Otherwise it takes the
    license of the nearest directory above it, its own included, that has a
    license file or index page with a notice (``inherited``). Among several such
    files of a directory the most similar notice counts, then the smaller license
    name. Without either all three are null. A null or empty body has no notice; a
    null path inherits nothing; repeated rows are each returned.
    """
    body = F.coalesce("body", F.lit(""))
    rows = files.select("file_id", "path", body.alias("body")).withColumn("code", F.xxhash64("body"))
    name = F.element_at(F.split("path", "/"), -1)
    states_license = (name == "") | name.rlike(LICENSE_FILE)
    whole = F.coalesce(states_license, F.lit(False)).alias("whole")
    own = stage(_matches(rows.select("file_id", "code", "body", whole), ["file_id", "code"], threshold), "license-own")
    slim = rows.select("file_id", "path", "code").withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    slim = slim.withColumn("dir", F.when(F.col("path").isNotNull(), F.col("dir")))
    mine = small(own, own.count())
    same = slim.file_id.eqNullSafe(mine.file_id) & (slim.code == mine.code)
    marked = slim.join(mine, same, "left").select(slim.file_id, slim.code, "path", "dir", "license", "similarity")
    states = marked.where(F.col("license").isNotNull() & F.col("dir").isNotNull() & states_license)
    stated = states.groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "license")).alias("best"))
    stated = stage(stated.select(F.col("dir").alias("above"), F.col("best.license").alias("dir_license"), (-F.col("best.far")).alias("dir_similarity")), "license-dirs")
    # ancestors of the distinct directories only
    parts = F.split("dir", "/")
    dirs = slim.where(F.col("dir").isNotNull()).select("dir").distinct().withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts))))
    above = dirs.withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = above.join(small(stated, stated.count()), "above").groupBy("dir").agg(
        F.max(F.struct("depth", "above", "dir_license", "dir_similarity")).alias("near")
    )
    nearest = nearest.select("dir", F.col("near.above").alias("from_dir"), "near.dir_license", "near.dir_similarity")
    nearest = stage(nearest, "license-nearest")
    # counted, as a host may hold any share of the files
    out = marked.join(small(nearest, nearest.count()), "dir", "left")
    header = F.col("license").isNotNull()
    return out.select(
        "file_id", "path",
        F.coalesce("license", "dir_license").alias("license"),
        F.coalesce("similarity", "dir_similarity").alias("similarity"),
        F.when(header, "header").when(F.col("dir_license").isNotNull(), "inherited").alias("how"),
        F.when(~header, F.col("from_dir")).alias("from_dir"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every page; its path is host and path of the address."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    address = F.nullif(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), F.lit(""))
    files = pages.select(F.col("page_id").alias("file_id"), address.alias("path"), F.col("html").alias("body"))
    return scan(files).withColumnRenamed("file_id", "page_id")
