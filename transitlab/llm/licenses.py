"""Licence scans: lines and paragraphs against licence templates by the Dice coefficient of their word bigrams.

Text is normalised: A-Z in lower case, runs of anything but letters and digits as
one space. Units are a document's lines, and its paragraphs of several lines (lines
up to a blank one). Of a unit with a and a template with b distinct bigrams, the
Dice coefficient 2 * shared / (a + b) can only reach t if b * t / (2 - t) <= a <=
b * (2 - t) / t, so only templates within these bounds are compared, and a unit
whose words already rule out all templates has no bigrams made. All of it is
DataFrame functions on a row's own arrays: no shuffle, whatever the sources hold.
"""

from __future__ import annotations

import re
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and short licence texts as their publishers word them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details.""",
    ),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ),
    "MPL-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    "LicenseRef-all-rights-reserved": ("All rights reserved.",),
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, in order; templates hold ASCII letters only."""
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def bounds(size: int, least: float) -> tuple[int, int]:
    """The fewest and the most bigrams of a unit whose Dice coefficient with ``size`` bigrams can reach ``least``."""
    return ceil(size * least / (2 - least) - 1e-9), floor(size * (2 - least) / least + 1e-9)


def flat_templates(templates: dict[str, tuple[str, ...]], least: float) -> list[tuple[str, list[str], int, int]]:
    """(licence, bigrams, low, high) of each template with a bigram."""
    found = [(name, template_bigrams(text)) for name, texts in sorted(templates.items()) for text in texts]
    return [(name, grams, *bounds(len(grams), least)) for name, grams in found if grams]


def _once(values: Column) -> Column:
    """The rows of an array column; what is computed below is then computed once."""
    return F.explode(values)


def _bigrams(words: Column) -> Column:
    n = F.size(words) - 1
    return F.array_distinct(
        F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    )


def scan(
    docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.8
) -> DataFrame:
    """(doc_id, unit, number, license, dice): each line or paragraph that comes near a template, with the nearest.

    ``unit`` is ``line`` or ``paragraph``, ``number`` its place from 1 (paragraphs
    of one line are lines only). Of templates that are equally near, the licence
    that is last by name counts. Null and empty texts have no units. Repeated rows
    and null ids are answered each; an empty table gives no rows. Other columns are
    not read.
    """
    flat = flat_templates(templates, least)
    low, high = min(t[2] for t in flat), max(t[3] for t in flat)
    known = F.array(
        *(
            F.struct(
                F.lit(name).alias("license"),
                F.array(*map(F.lit, grams)).alias("grams"),
                F.lit(a).alias("low"),
                F.lit(b).alias("high"),
            )
            for name, grams, a, b in flat
        )
    )
    plain = F.regexp_replace(F.translate("text", UPPER, LOWER), r"[^\p{L}\p{N}\n]+", " ")
    lines = docs.where("text is not null").select("doc_id", _once(F.array(F.split(plain, "\n"))).alias("lines"))

    def numbered(parts: Column, unit: str) -> Column:
        return F.transform(parts, lambda x, i: F.struct(F.lit(unit).alias("unit"), (i + 1).cast("long").alias("number"), F.btrim(x, F.lit(" \n")).alias("words")))

    whole = F.split(F.array_join(F.transform("lines", lambda x: F.trim(x)), "\n"), r"\n{2,}")
    paragraphs = F.filter(numbered(whole, "paragraph"), lambda u: u["words"].contains("\n"))
    units = lines.select("doc_id", _once(F.concat(numbered(F.col("lines"), "line"), paragraphs)).alias("u"))
    worded = units.select("doc_id", "u.unit", "u.number", _once(F.filter(
        F.array(F.split("u.words", r"[ \n]+")),
        lambda w: (F.size(w) > low) & (F.size(F.array_distinct(w)) <= high + 1),
    )).alias("words"))
    grams = worded.select("doc_id", "unit", "number", _once(F.array(_bigrams(F.col("words")))).alias("grams"))
    size = F.size("grams")
    near = F.transform(
        F.filter(known, lambda t: (size >= t["low"]) & (size <= t["high"])),
        lambda t: F.struct(
            (2.0 * F.size(F.array_intersect(F.col("grams"), t["grams"])) / (size + F.size(t["grams"]))).alias("dice"),
            t["license"].alias("license"),
        ),
    )
    best = grams.select("doc_id", "unit", "number", _once(F.filter(F.array(F.array_max(near)), lambda x: x["dice"] >= least)).alias("best"))
    return best.select(
        F.col("doc_id").cast("long").alias("doc_id"), "unit", "number", F.col("best.license").alias("license"), F.round("best.dice", 6).alias("dice")
    )


def oracle(least: float = 0.8) -> str:
    """The same in DuckDB, template by template without the size bounds."""
    rows = ", ".join(
        f"('{name}', [{', '.join(repr(g) for g in grams)}])" for name, grams, _, _ in flat_templates(TEMPLATES, least)
    )
    return rf"""
WITH templates(license, grams) AS (VALUES {rows}),
plain AS (
  SELECT row_number() OVER () AS r, doc_id,
    string_split(regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), chr(10)) AS lines
  FROM documents WHERE text IS NOT NULL),
trimmed AS (SELECT r, doc_id, list_transform(lines, lambda x: trim(x)) AS lines FROM plain),
paragraphs AS (
  SELECT r, doc_id, unnest(list_transform(parts, lambda x, i: {{'number': i, 'words': x}})) AS u
  FROM (SELECT r, doc_id, string_split_regex(array_to_string(lines, chr(10)), '\n{{2,}}') AS parts FROM trimmed)),
units AS (
  SELECT r, doc_id, 'line' AS unit, u.number AS number, u.words AS words
  FROM (SELECT r, doc_id, unnest(list_transform(lines, lambda x, i: {{'number': i, 'words': x}})) AS u FROM trimmed)
  UNION ALL
  SELECT r, doc_id, 'paragraph', u.number, trim(u.words, ' ' || chr(10)) FROM paragraphs
  WHERE contains(trim(u.words, ' ' || chr(10)), chr(10))),
worded AS (SELECT r, doc_id, unit, number, string_split_regex(words, '[ \n]+') AS w FROM units),
grams AS (
  SELECT r, doc_id, unit, number, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams
  FROM worded WHERE len(w) > 1),
scored AS (
  SELECT g.r, g.doc_id, g.unit, g.number, t.license,
    2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
  FROM grams g, templates t),
best AS (
  SELECT *, row_number() OVER (PARTITION BY r, unit, number ORDER BY dice DESC, license DESC) AS place
  FROM scored WHERE dice >= {least})
SELECT doc_id, unit, number, license, round(dice, 6) AS dice FROM best WHERE place = 1
"""
