"""Licence scan: Dice coefficient of word bigrams against templates, pruned by size."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
LEAST = 0.8

# Published licence notices.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-header": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Proprietary": "Copyright. All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Paragraphs of notices that are published in several: template, first words, first words of what follows. Paragraphs
#: that licences share have one name. Left out are Apache's address and the middle paragraph of MIT, one line of MIT-text
#: that would count the licence again; the paragraphs beside them find both.
PARTS = {
    "AGPL-3.0-header-1": ("AGPL-3.0-header", "This program is free", "This program is dist"),
    "AGPL-3.0-header-2": ("AGPL-3.0-header", "This program is dist", "You should"),
    "AGPL-3.0-header-3": ("AGPL-3.0-header", "You should", None),
    "Apache-2.0-header-1": ("Apache-2.0-header", "Licensed under", "http://"),
    "Apache-2.0-header-2": ("Apache-2.0-header", "Unless required", None),
    "BSD-2-Clause-conditions": ("BSD-2-Clause-text", "Redistribution and", "THIS SOFTWARE"),
    "BSD-3-Clause-conditions": ("BSD-3-Clause-text", "Redistribution and", "THIS SOFTWARE"),
    "BSD-3-Clause-condition-3": ("BSD-3-Clause-text", "3. Neither", "THIS SOFTWARE"),
    "BSD-condition-1": ("BSD-3-Clause-text", "1. Redistributions", "2. Redistributions"),
    "BSD-condition-2": ("BSD-3-Clause-text", "2. Redistributions", "3. Neither"),
    "BSD-disclaimer": ("BSD-3-Clause-text", "THIS SOFTWARE", None),
    "BSD-grant": ("BSD-3-Clause-text", "Redistribution and", "1. Redistributions"),
    "GPL-2.0-header-1": ("GPL-2.0-header", "This program is free", "This program is dist"),
    "GPL-2.0-header-3": ("GPL-2.0-header", "You should", None),
    "GPL-3.0-header-1": ("GPL-3.0-header", "This program is free", "This program is dist"),
    "GPL-3.0-header-3": ("GPL-3.0-header", "You should", None),
    "GPL-header-2": ("GPL-3.0-header", "This program is dist", "You should"),
    "ISC-disclaimer": ("ISC", "THE SOFTWARE", None),
    "ISC-grant": ("ISC", "Permission to", "THE SOFTWARE"),
    "LGPL-2.1-header-1": ("LGPL-2.1-header", "This library is free", "This library is dist"),
    "LGPL-2.1-header-2": ("LGPL-2.1-header", "This library is dist", "You should"),
    "LGPL-2.1-header-3": ("LGPL-2.1-header", "You should", None),
    "LGPL-3.0-header-1": ("LGPL-3.0-header", "This program is free", "This program is dist"),
    "LGPL-3.0-header-2": ("LGPL-3.0-header", "This program is dist", "You should"),
    "LGPL-3.0-header-3": ("LGPL-3.0-header", "You should", None),
    "MIT-text-disclaimer": ("MIT-text", "THE SOFTWARE IS", None),
    "MIT-text-grant": ("MIT-text", "Permission is", "The above"),
}
for _name, (_whole, _start, _end) in PARTS.items():
    _text = TEMPLATES[_whole]
    TEMPLATES[_name] = _text[_text.index(_start) : _text.index(_end) if _end else None].strip()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARAGRAPH = "\\n[ \\t\\r]*\\n"


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def size_bounds(n: int, least: float = LEAST) -> tuple[float, float]:
    """Bigram counts that a text may have to reach `least` against a template of n: 2 min / (sum) is the most it can score."""
    return n * least / (2 - least) - 1e-9, n * (2 - least) / least + 1e-9


def cue_words(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> list[str]:
    """Words of which every match contains at least one.

    A match has at least least / (2 - least) of a template's bigrams, so it cannot miss more than the rest. Words are
    added for each template, the longest first, until their bigrams are more than that rest.
    """
    cues: list[str] = []
    for text in templates.values():
        grams = bigrams_of(text)
        may_miss = len(grams) - size_bounds(len(grams), least)[0]
        met = lambda: sum(any(c in g.split(" ") for c in cues) for g in grams)  # noqa: E731, B023
        for word in sorted(set(words_of(text)), key=lambda w: (-len(w), w)):
            if met() > may_miss + 1e-9:
                break
            if any(word in g.split(" ") for g in grams if not any(c in g.split(" ") for c in cues)):
                cues.append(word)
    return sorted(set(cues))


def normalised(text: Column) -> Column:
    """A-Z in lower case, and one blank for each run of anything but a-z and 0-9."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))


def _bigrams(words: Column) -> Column:
    """Distinct neighbours of a column of words, which must be a plain column so that it is computed once."""
    n = F.size(words) - 1
    return F.when(n > 0, F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))))


def _templates(templates: dict[str, str], least: float) -> Column:
    rows = []
    for name, text in sorted(templates.items()):
        grams = bigrams_of(text)
        low, high = size_bounds(len(grams), least)
        rows.append(F.struct(F.lit(name).alias("name"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.array(*map(F.lit, grams)).alias("grams")))
    return F.array(*rows)


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, unit, place, license and dice of each line, paragraph and whole text that matches a template.

    A paragraph counts when it has several lines, a whole text when it has several paragraphs, so no unit counts twice. A
    notice of several paragraphs counts by paragraph, and once more where the whole text is little else.
    Of several templates the best, then the first by name, is named. Units without any cue word are left out before
    they are normalised; templates whose size rules a unit out are not compared.
    """
    cue = f"(?<![a-z0-9])(?:{'|'.join(cue_words(templates, least))})(?![a-z0-9])"
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.translate(text, UPPER, LOWER)
    # No unit of a text without a cue word has one.
    rows = docs.select(F.col(id_col).alias("doc_id"), low.alias("t")).where(F.rlike("t", F.lit(cue)))
    pick = lambda units, keep: F.filter(F.transform(units, lambda u, i: F.struct(u.alias("u"), i.alias("i"))), lambda x: keep(x["u"]) & x["u"].rlike(cue))
    blocks = F.split("t", PARAGRAPH)
    kind = lambda name, units: F.transform(units, lambda x: F.struct(F.lit(name).alias("unit"), x["i"].alias("place"), x["u"].alias("u")))
    units = F.concat(
        kind("line", pick(F.split("t", "\n"), lambda u: F.lit(True))),
        kind("paragraph", pick(blocks, lambda u: u.contains("\n"))),
        kind("text", pick(F.when(F.size(blocks) > 1, F.array("t")).otherwise(F.array().cast("array<string>")), lambda u: F.lit(True))),
    )
    rows = rows.select("doc_id", F.explode(units).alias("x")).select("doc_id", "x.unit", "x.place", F.split(normalised(F.col("x.u")), " ").alias("words"))
    rows = rows.select("doc_id", "unit", "place", _bigrams(F.col("words")).alias("grams"))
    # A row for each template whose size admits the unit; the unit's bigrams are computed once, before the rows are made.
    n = F.size("grams")
    rows = rows.select("doc_id", "unit", "place", "grams", F.explode(F.filter(_templates(templates, least), lambda t: n.between(t["low"], t["high"]))).alias("t"))
    dice = 2.0 * F.size(F.array_intersect("grams", "t.grams")) / (n + F.size("t.grams"))
    rows = rows.select("doc_id", "unit", "place", F.col("t.name").alias("license"), dice.alias("dice")).where(F.col("dice") >= least)
    best = F.min(F.struct((-F.col("dice")).alias("less"), F.col("license"))).alias("best")
    rows = rows.groupBy("doc_id", "unit", "place").agg(best)
    return rows.select("doc_id", "unit", "place", F.col("best.license").alias("license"), (-F.col("best.less")).alias("dice"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, n_matches, licenses (distinct names, sorted, comma-joined), best_license and best_dice per id.

    Ids without a match have 0, an empty list and nulls. Null text is empty text, a null id is an id of its own, rows
    that repeat an id are one document (units at one place count once), an empty table gives no rows, other columns are ignored.
    """
    found = matches(docs, id_col, text_col, templates, least)
    best = F.min(F.struct((-F.col("dice")).alias("less"), F.col("license"))).alias("best")
    found = found.groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.collect_set("license").alias("names"), best)
    # Names are at most as many as the templates, so the set is bounded.
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct().alias("d")
    out = ids.join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id"), "left")
    return out.select(
        "d.doc_id",
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.array_join(F.sort_array("names"), ","), F.lit("")).alias("licenses"),
        F.col("best.license").alias("best_license"),
        (-F.col("best.less")).alias("best_dice"),
    )


def oracle_sql(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """The scan as SQL over all units and templates, without cues or size bounds."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted(templates.items()))
    norm = lambda x: f"trim(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    grams = lambda w: f"CASE WHEN len({w}) > 1 THEN list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])) END"
    return f"""
WITH t AS (SELECT * FROM (VALUES {values}) v(license, body)),
tw AS (SELECT license, string_split({norm('body')}, ' ') AS w FROM t),
tg AS (SELECT license, {grams('w')} AS tgrams FROM tw),
d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
u AS (
  SELECT doc_id, unnest(string_split(body, chr(10))) AS u FROM d
  UNION ALL SELECT * FROM (SELECT doc_id, unnest(string_split_regex(body, '\\n[ \\t\\r]*\\n')) AS u FROM d) p WHERE contains(u, chr(10))
  UNION ALL SELECT doc_id, body FROM d WHERE len(string_split_regex(body, '\\n[ \\t\\r]*\\n')) > 1),
uw AS (SELECT doc_id, row_number() OVER () AS n, string_split({norm('u')}, ' ') AS w FROM u),
ug AS (SELECT doc_id, n, {grams('w')} AS grams FROM uw),
s AS (
  SELECT doc_id, n, license, 2.0::DOUBLE * len(list_intersect(grams, tgrams)) / (len(grams) + len(tgrams)) AS dice
  FROM (SELECT * FROM ug WHERE grams IS NOT NULL AND len(list_intersect(grams, (SELECT list_distinct(flatten(list(tgrams))) FROM tg))) > 0) ug2, tg),
b AS (SELECT doc_id, n, arg_min(license, (-dice, license)) AS license, max(dice) AS dice FROM s WHERE dice >= {least} GROUP BY doc_id, n),
a AS (SELECT doc_id, count(*) AS n_matches, array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses, arg_min(license, (-dice, license)) AS best_license, max(dice) AS best_dice FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, best_license, best_dice
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN a ON a.doc_id = d.doc_id"""
