"""Licence scan: passages against licence templates by the Dice coefficient of their word bigrams.

DataFrame expressions only. Two exact bounds prune: a template whose set has m bigrams can reach
the least coefficient t only with sets of m t / (2 - t) to m (2 - t) / t bigrams; and it must share
at least m t / (2 - t) of its own, so a passage without any of the template's anchors (words that
more than the other m - m t / (2 - t) bigrams hold) is never compared.

A passage that as a whole is close to no template is looked into: windows as long as a template, laid
so that one of its anchors stands in the passage where it stands in the template.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
INSIDE = 4  #: words of the shortest templates that are looked for inside longer passages: three common words are no licence there

# The paragraphs that the BSD licences share, and the third clause.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_SPDX = ("Apache-2.0", "MIT", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")

# licences' names, notices and paragraphs.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."),
    ("Proprietary", "All rights reserved."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD),
    ("BSD-2-Clause", f"{_BSD} {_BSD_1} {_BSD_2}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_3}"),
    ("BSD-3-Clause", _BSD_3),
    *((n, f"SPDX-License-Identifier: {n}") for n in _SPDX),
]


def template_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def bounds(m: int, least: float) -> tuple[int, int]:
    """Least and greatest sizes of sets that can reach the coefficient with a set of m."""
    return math.ceil(m * least / (2 - least) - 1e-9), math.floor(m * (2 - least) / least + 1e-9)


LIKED = ("license", "licensed", "gnu", "copyright", "permission", "domain", "copying")


def anchors(grams: list[str], least: float, liked: tuple[str, ...] = LIKED) -> list[str]:
    """Words of which every set that reaches the coefficient holds at least one."""
    spare, chosen, held = len(grams) - bounds(len(grams), least)[0], [], set()
    words = {w for g in grams for w in g.split()}
    while len(held) <= spare:
        touch = {w: {g for g in grams if w in g.split()} - held for w in words - set(chosen)}
        best = max(sorted(touch), key=lambda w: (bool(touch[w]), w in liked, min(len(w), 8), len(touch[w])))
        chosen.append(best)
        held |= touch[best]
    return chosen


def signs(templates: list[tuple[str, str]], least: float) -> list[list[str]]:
    """Each template's anchors; those of earlier ones are liked."""
    out: list[list[str]] = []
    for _, text in templates:
        out.append(anchors(template_bigrams(text), least, (*LIKED, *(w for held in out for w in held))))
    return out


def places(templates: list[tuple[str, str]], least: float) -> list[tuple[int, str, int]]:
    """(template, anchor, place): where anchors stand in the templates that are looked for inside passages."""
    return [(k, w, at) for k, ((_, text), held) in enumerate(zip(templates, signs(templates, least), strict=True)) for words in [template_words(text)] if len(words) >= INSIDE for at, w in enumerate(words) if w in held]


def _words(passage: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(passage), "[^a-z0-9]+", " ")), " ")


def _pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def _with(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.flatten(F.transform(F.array(value), use))


def found(text: Column, templates=None, least: float = LEAST) -> Column:
    """array<struct<licence, dice>>: each passage's closest templates, where their coefficient is at least least.

    Passages are the text's lines, and what stands between blank lines. Of one without a close
    template the closest windows count.
    """
    templates = list(templates or TEMPLATES)
    every_sign = list(dict.fromkeys(w for held in signs(templates, least) for w in held))
    known = [{"licence": n, "lo": lo, "hi": hi, "words": len(template_words(t)), "grams": g} for n, t in templates for g in [template_bigrams(t)] for lo, hi in [bounds(len(g), least)]]
    laid: dict[str, list] = {}
    for k, w, at in places(templates, least):
        laid.setdefault(w, []).append({"k": k + 1, "at": at})
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    held = literal(every_sign, "array<string>")
    known = literal(known, "array<struct<licence:string,lo:int,hi:int,words:int,grams:array<string>>>")
    laid = literal(laid, "map<string,array<struct<k:int,at:int>>>")
    # The array of one makes lower() run once for each string, not once for each sign.
    hit = lambda c: F.exists(F.array(F.lower(c)), lambda low: F.exists(held, lambda a: F.contains(low, a)))
    lines = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n")))

    def dice(s: Column, t: Column) -> Column:
        return F.struct(t["licence"].alias("licence"), (F.size(F.array_intersect(s, t["grams"])) * F.lit(2.0) / (F.size(s) + F.size(t["grams"]))).alias("dice"))

    def whole(s: Column) -> Column:
        return F.transform(F.filter(known, lambda t: (F.size(s) >= t["lo"]) & (F.size(s) <= t["hi"])), lambda t: dice(s, t))

    def windows(words: Column, grams: Column) -> Column:
        # A window is one number, template and start, so that repeats are found by hashing.
        laid_at = F.transform(words, lambda w, i: F.transform(F.filter(F.element_at(laid, w), lambda a: a["at"] <= i), lambda a: F.shiftleft(a["k"].cast("long"), 32) + (i - a["at"])))
        at = lambda x: x.bitwiseAND((1 << 32) - 1).cast("int")
        template = lambda x: F.element_at(known, F.shiftright(x, 32).cast("int"))
        fit = F.filter(F.array_distinct(F.flatten(F.filter(laid_at, lambda x: x.isNotNull()))), lambda x: at(x) + template(x)["words"] <= F.size(words))
        return F.flatten(F.transform(fit, lambda x: F.transform(F.array(template(x)), lambda t: dice(F.array_distinct(F.slice(grams, at(x) + 1, t["words"] - 1)), t))))

    def closest(near: Column) -> Column:
        def named(x: Column) -> Column:
            best = F.array_max(F.transform(x, lambda y: y["dice"]))
            return _with(best, lambda most: F.transform(F.array_distinct(F.transform(F.filter(x, lambda y: (y["dice"] >= least) & (y["dice"] == most)), lambda y: y["licence"])), lambda n: F.struct(n.alias("licence"), most.alias("dice"))))

        return _with(near, named)

    def passage(x: Column) -> Column:
        inside = lambda: closest(windows(x["w"], x["g"]))
        return _with(closest(_with(F.array_distinct(x["g"]), whole)), lambda good: F.when(F.size(good) > 0, good).otherwise(inside()))

    split = F.transform(F.filter(lines, hit), _words)
    both = F.transform(split, lambda w: F.struct(w.alias("w"), _pairs(w).alias("g")))
    return F.when(hit(text), F.flatten(F.transform(both, passage))).otherwise(F.array().cast("array<struct<licence:string,dice:double>>"))


def scan(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licences (names, comma-joined, in order), n_licences and dice (the greatest; 0 without any) for every row.

    Null, empty and one-word texts have none. Null ids and repeated rows are rows like any other;
    an empty table gives no rows; other columns are not read. Of very long texts only passages with
    an anchor are compared. No row moves.
    """
    hits = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).select("doc_id", found(F.col("t"), least=least).alias("m"))
    names = F.array_sort(F.array_distinct(F.transform("m", lambda x: x["licence"])))
    return hits.select("doc_id", F.array_join(names, ",").alias("licences"), F.size(names).cast("long").alias("n_licences"), F.coalesce(F.round(F.array_max(F.transform("m", lambda x: x["dice"])), 6), F.lit(0.0)).alias("dice"))


def oracle(least: float = LEAST) -> str:
    """The same in SQL, without pruning by size or anchor; windows are laid at the same places."""
    rows = ", ".join(f"({k}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for k, (n, t) in enumerate(TEMPLATES))
    laid = ", ".join(f"({k}, '{w}', {at})" for k, w, at in places(TEMPLATES, least))
    norm = lambda c: f"string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    grams = lambda w, a="1", n="len(w) - 1": f"list_distinct(list_transform(range({a}, {a} + {n}), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    dice = "2.0 * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g))"
    return f"""
WITH t AS (SELECT k, licence, len(w) AS n, {grams('w')} AS g FROM (SELECT k, licence, {norm('txt')} AS w FROM (VALUES {rows}) v(k, licence, txt))),
laid(k, word, place) AS (VALUES {laid}),
p AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10)) || regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS p FROM documents),
w AS (SELECT doc_id, p, {norm('p')} AS w FROM p),
s AS (SELECT doc_id, p, {grams('w')} AS g FROM w),
c AS (SELECT doc_id, p, licence, max({dice}) AS dice
      FROM s, t WHERE 2.0 * least(len(s.g), len(t.g)) / (len(s.g) + len(t.g)) >= {least} AND list_has_any(s.g, t.g)
        AND {dice} >= {least} GROUP BY ALL),
i AS (SELECT doc_id, p, w, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w ANTI JOIN c USING (doc_id, p)),
x AS (SELECT DISTINCT doc_id, p, k, n, i - place AS a, w FROM i JOIN laid USING (word) JOIN t USING (k) WHERE i - place >= 1 AND i - place + n - 1 <= len(w)),
y AS (SELECT doc_id, p, k, {grams('w', 'a', 'n - 1')} AS g FROM x),
c2 AS (SELECT * FROM c UNION ALL SELECT doc_id, p, licence, max({dice}) FROM y s JOIN t USING (k) WHERE {dice} >= {least} GROUP BY ALL),
d AS (SELECT doc_id, licence, max(dice) AS dice FROM (SELECT *, max(dice) OVER (PARTITION BY doc_id, p) AS most FROM c2) WHERE dice = most GROUP BY ALL),
a AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licences, count(*) AS n_licences, round(max(dice), 6) AS dice FROM d GROUP BY doc_id)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(n_licences, 0) AS n_licences, coalesce(dice, 0.0) AS dice
FROM documents LEFT JOIN a USING (doc_id)"""
