"""Licence scans in DataFrame operations only: Dice coefficients over word bigrams.

A text is scanned by its lines, its paragraphs (between blank lines) and as a
whole. Each such passage and each template is a set of word bigrams. With a
threshold t, a passage of a bigrams can match a template of b only if
t / (2 - t) * b <= a <= (2 - t) / t * b; templates are laid out by every size
that this allows, and passages find their candidates by an equi-join on size.

A match holds at least t / (2 - t) of the template's bigrams. So ``needles``
takes words until they stand in more bigrams than a match may lack: a passage
with none of them matches nothing and is never cut into words.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Texts and notices of public licences.
WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TERMS = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
APACHE_GRANT = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
APACHE_WARRANTY = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
GPL_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
GPL_COPY = "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
GPL_3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
GPL_2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
UNLICENSE = "This is free and unencumbered software released into the public domain."
UNLICENSE_GRANT = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE_GRANT),
    ("Apache-2.0", f"{APACHE_GRANT} {APACHE_WARRANTY}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", MIT_GRANT),
    ("MIT", f"{MIT_GRANT} {MIT_NOTICE} {WARRANTY}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", GPL_3),
    ("GPL-3.0", f"{GPL_3} {GPL_WARRANTY} {GPL_COPY}"),
    ("GPL-2.0", GPL_2),
    ("GPL-2.0", f"{GPL_2} {GPL_WARRANTY} {GPL_COPY}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD", BSD_GRANT),
    ("BSD-2-Clause", f"{BSD_GRANT} {BSD_TERMS} {BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{BSD_GRANT} {BSD_TERMS} {BSD_NAMES} {BSD_WARRANTY}"),
    ("ISC", ISC_GRANT),
    ("ISC", f"{ISC_GRANT} {ISC_WARRANTY}"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", UNLICENSE),
    ("Unlicense", f"{UNLICENSE} {UNLICENSE_GRANT}"),
]


def needles(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Patterns of which every lower-cased passage that matches a template holds one; [""] if some template is not plain ASCII.

    Words of six letters and more, those in most bigrams first, as long as there
    are any; then whole bigrams. Each counts for the bigrams that it is a part
    of, until more are counted than a match may lack.
    """
    t, rest = Fraction(str(threshold)), []
    for _, body in templates:
        if not body.isascii():
            return [""]
        w = re.findall(r"[a-z0-9]+", body.lower())
        pairs = set(zip(w, w[1:]))
        if pairs:
            rest.append([pairs, int(len(pairs) * (2 - 2 * t) / (2 - t)) + 1])
    out: list[str] = []
    while open_ := [x for x in rest if x[1] > 0]:
        gain: dict[str, int] = {}
        for word in {word for pairs, _ in open_ for pair in pairs for word in pair if len(word) > 5}:
            gain[word] = sum(min(need, sum(word in a or word in b for a, b in pairs)) for pairs, need in open_)
        if gain:
            best = max(gain, key=lambda x: (min(len(x), 7), gain[x], x))
            held = lambda pair, best=best: best in pair[0] or best in pair[1]
            out.append(best)
        else:
            one = max({pair for pairs, _ in open_ for pair in pairs}, key=lambda x: (len(x[0]) + len(x[1]), x))
            held = one.__eq__
            out.append(rf"{one[0]}[^\p{{L}}\p{{N}}]+{one[1]}")
        for x in open_:
            taken = set(filter(held, x[0]))
            x[0] -= taken
            x[1] -= len(taken)
    return out


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(w: Column) -> Column:
    """Distinct pairs of neighbouring words; fewer than two words: none."""
    none = F.array().cast("array<string>")
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(w) > 1, F.array_distinct(pairs)).otherwise(none)


def template_table(spark: SparkSession, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """``(licence, t, b, n)``: a row for every size n of a passage that can match the template."""
    t = Fraction(str(threshold))
    src = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "t int, licence string, body string")
    sized = src.select("licence", "t", bigrams(words(F.col("body"))).alias("b")).where(F.size("b") > 0)
    low = F.ceil(F.size("b") * F.lit(t.numerator) / F.lit(2 * t.denominator - t.numerator) - 1e-9)
    high = F.floor(F.size("b") * F.lit(2 * t.denominator - t.numerator) / F.lit(t.numerator) + 1e-9)
    return sized.select("licence", "t", "b", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("n"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, licence, dice, passages)``: the best coefficient of each licence found in a row's passages, and how many distinct passages match.

    Null and empty texts match nothing. Rows that share an id count as one
    document, so repeated rows change nothing; a null id counts like any other.
    Ties leave one row. Other columns are ignored. Each passage that holds a
    needle is cut into words and bigrams once, however long it is.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    known = template_table(spark, templates, threshold)
    most = known.agg(F.max("n")).first()[0] or 0
    some = needles(templates, threshold)
    holds = lambda text: F.lower(text).rlike("|".join(some) or "(?!)")  # noqa: E731  no templates: nothing matches
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(holds(F.col("text")))
    passages = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", r"\n\s*\n"), F.array("text")))
    # the generator evaluates its argument once a row, and each lambda its variable once a passage
    cut = F.transform(F.transform(F.filter(passages, holds), words), lambda w: F.struct(w.alias("w"), bigrams(w).alias("a")))
    grams = src.select("id", F.inline(cut)).withColumn("n", F.size("a")).where((F.col("n") > 0) & (F.col("n") <= most))
    both = F.size(F.array_intersect("a", "b"))
    # the templates are a constant of the code: their sizes bound what is broadcast
    hits = grams.join(F.broadcast(known), "n").withColumn("dice", 2 * both / (F.col("n") + F.size("b"))).where(F.col("dice") >= threshold)
    return hits.groupBy("id", "licence").agg(F.round(F.max("dice"), 6).alias("dice"), F.count_distinct("w").alias("passages"))


def scan_sql(templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> str:
    """The same of ``documents`` in DuckDB's SQL, every passage against every template."""
    quoted = ", ".join(f"('{a}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in (TEMPLATES if templates is None else templates))
    w = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')".format
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
    WITH t AS (SELECT licence, {grams} AS b FROM (SELECT licence, {w("body")} AS w FROM (VALUES {quoted}) AS v(licence, body))),
    p AS (SELECT DISTINCT doc_id, unnest(list_concat(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n\\s*\\n')), [text])) AS p FROM documents),
    g AS (SELECT doc_id, w, {grams} AS a FROM (SELECT doc_id, {w("p")} AS w FROM p) WHERE len(w) > 1),
    h AS (SELECT doc_id, licence, w, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM g, t)
    SELECT doc_id, licence, round(max(dice), 6) AS dice, count(DISTINCT w) AS passages FROM h WHERE dice >= {threshold} GROUP BY doc_id, licence"""
