"""Licence scans: Dice coefficient over word bigrams against licence templates, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.llm.common import kept

THRESHOLD = 0.8
#: Template bigrams (rows under 100 bytes) that are broadcast.
SMALL = 200_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

#: Licence (SPDX name) and the public wording of its text, header or short notice.
TEMPLATES = [
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", _MPL),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def templates(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(template, license, text)``; the position in the list names the template."""
    rows = TEMPLATES if rows is None else rows
    return spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(rows)], "template int, license string, text string")


def normal(text: Column) -> Column:
    """Lower-case letters and digits; everything else is one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bigrams(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1)))


def units(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """``row, id, unit, pos, raw``: each line, each paragraph of several lines, and the text if it has several paragraphs."""
    body = F.col("_body")
    paragraphs = F.split(body, r"\n\s*\n")
    lines = F.transform(F.split(body, "\n"), lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("pos"), x.alias("raw")))
    many = F.filter(F.transform(paragraphs, lambda x, i: F.struct(F.lit("paragraph").alias("unit"), i.alias("pos"), x.alias("raw"))), lambda p: F.contains(p["raw"], F.lit("\n")))
    whole = F.when(F.size(paragraphs) > 1, F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("pos"), body.alias("raw")))).otherwise(F.array().cast("array<struct<unit:string,pos:int,raw:string>>"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("_body"))
    return rows.select("row", "id", F.explode(F.concat(lines, many, whole)).alias("u")).select("row", "id", "u.*")


def scan(docs: DataFrame, known: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(ident, unit, pos, license, dice)`` for every unit of a text that a template matches.

    Dice is twice the shared bigrams (with repeats) over the sum of both counts. It can reach the
    threshold only if the counts differ by a factor of at most (2 - t) / t: units outside every
    template's bounds are left out before bigrams are built, and a bigram is joined only with
    templates whose bounds hold the unit. The best template of a unit counts, at ties the
    first in the list. NULL and empty texts give no rows, nor do templates of fewer than two
    words; each of several equal rows is scanned. ``known`` is a list of texts a person keeps: its
    sizes are read once, and its bigrams are broadcast if there are at most ``SMALL``, else shuffled.
    """
    worded = known.select("template", "license", F.split(normal(F.col("text")), " ").alias("w")).where(F.size("w") > 1)
    sized = worded.withColumn("size", F.size("w") - 1)
    ratio = (2 - threshold) / threshold
    sized = sized.withColumn("lo", F.ceil(F.col("size") / ratio - 1e-9)).withColumn("hi", F.floor(F.col("size") * ratio + 1e-9))
    lo, hi = sized.agg(F.min("lo"), F.max("hi")).first()
    if lo is None:
        lo, hi = math.inf, -1
    marks = sized.select("template", "license", "size", "lo", "hi", F.explode(_bigrams(F.col("w"))).alias("bigram"))
    marks = marks.groupBy("bigram", "template", "license", "size", "lo", "hi").agg(F.count(F.lit(1)).alias("in_template"))
    cut = units(docs, ident, text).select("row", "id", "unit", "pos", F.split(normal(F.col("raw")), " ").alias("w"))
    cut = cut.withColumn("n", F.size("w") - 1).where((F.col("n") >= F.lit(lo)) & (F.col("n") <= F.lit(hi)) & (F.col("n") >= 1))
    cut = cut.select("row", "id", "unit", "pos", "n", F.explode(_bigrams(F.col("w"))).alias("bigram"))
    marks = kept(marks, "template-bigrams")
    met = cut.join(F.broadcast(marks) if marks.count() <= SMALL else marks, "bigram").where("n BETWEEN lo AND hi")
    each = met.groupBy("row", "id", "unit", "pos", "n", "template", "license", "size", "bigram", "in_template").agg(F.count(F.lit(1)).alias("in_unit"))
    dice = each.groupBy("row", "id", "unit", "pos", "n", "template", "license", "size").agg(F.sum(F.least("in_unit", "in_template")).alias("shared"))
    dice = dice.withColumn("dice", 2.0 * F.col("shared") / (F.col("n") + F.col("size"))).where(F.col("dice") >= threshold)
    best = dice.groupBy("row", "id", "unit", "pos").agg(F.max(F.struct("dice", (-F.col("template")).alias("t"), "license")).alias("b"))
    return best.select(F.col("id").alias(ident), "unit", "pos", F.col("b.license").alias("license"), F.col("b.dice").alias("dice"))
