"""License scans (native): normalised text compared to licence templates by the Dice coefficient over word bigrams.

A text is lower-cased and everything but letters and digits parts its words. The units that are compared are the whole
text (line 0), each of its lines (from 1), and windows: from the beginning of each line, across the ends of lines, as
many words as a template has (fewer where the text ends), so that licences and notices that are wrapped over lines inside
a longer text are found. A window needs words of a second line. A unit's bigram set A is compared to a template's set
B by 2 |A and B| / (|A| + |B|); at a threshold t only templates with t / (2 - t) * |A| <= |B| <= (2 - t) / t * |A| can
reach it. Returned, a row per line (0 for the whole text) of which some unit reaches the threshold: doc_id, line,
license (the best; ties to the smaller name), dice. Around a long notice the lines next to its first may reach it too.

Before anything is split, a text must hold one of the templates' anchors, and so must each unit. At the threshold a
unit must share at least t / (2 - t) of a template's bigrams; anchors are beginnings of words, or bigrams, such that fewer
bigrams than that avoid all of them, so the test is exact.

The built-in templates are whole short licences, whole notices and one-line statements. The long texts behind the notices
(Apache, GPL, MPL) can be passed as templates.

Cases: null and empty texts have no units that match. Texts of one word have no bigram and match nothing. Repeated
rows give repeated results; a null doc_id is kept. An empty table gives an empty result. Extra columns are ignored.

Scale: one pass, no shuffle; the templates are literals of the plan. Lines are taken in runs of ``RUN``, so a text of
any length is never multiplied in memory by the windows over it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence texts, notices and statements, whole.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>',
}

NOT_A_WORD = "[^\\p{L}\\p{N}]+"
#: Lines whose windows are made together.
RUN = 1000
#: Letters of a word that make an anchor.
STEM = 8


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def anchors(templates: dict[str, list[str]], threshold: float) -> list[str]:
    """Beginnings of words, or bigrams, until fewer bigrams of each template avoid them than a match must share."""
    found: list[str] = []
    holds = lambda g, anchor: g == anchor or any(w.startswith(anchor) for w in g.split())
    for grams in templates.values():
        need = math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
        left = [g for g in grams if not any(holds(g, s) for s in found)]
        while left and len(left) >= need:
            stems = {w[:STEM] for g in left for w in g.split() if len(w) >= STEM - 1}
            # long ones are rare in other texts
            best = max(sorted(stems or left), key=lambda s: (sum(holds(g, s) for g in left) * len(s) ** 2, s))
            found.append(best)
            left = [g for g in left if not holds(g, best)]
    return sorted(s for s in set(found) if not any(s != t and t in s for t in found))


def one_of(anchors: list[str]) -> str:
    """A pattern for any of them; those that begin alike are tried together."""
    by_first: dict[str, list[str]] = {}
    for a in anchors:
        by_first.setdefault(a[0], []).append(NOT_A_WORD.join(map(re.escape, a[1:].split(" "))))
    return "|".join(f"{re.escape(k)}(?:{'|'.join(v)})" for k, v in sorted(by_first.items()))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), NOT_A_WORD, " "))


def pairs(words: Column) -> Column:
    """Bigrams of a list of words, in order; null if there are none."""
    n = F.size(words) - 1
    return F.when(n >= 1, F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    texts = sorted((templates or TEMPLATES).items())
    sets = {k: (len(words_of(v)), grams) for k, v in texts if (grams := bigrams_of(v))}
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    found = one_of(anchors({k: g for k, (_, g) in sets.items()}, threshold))
    longest = max(n for n, _ in sets.values())
    least, most = low * min(len(g) for _, g in sets.values()), high * max(len(g) for _, g in sets.values())
    # explode() of one element holds a value: filters above don't make Spark compute it again
    kept = lambda c, name: F.explode(F.array(c)).alias(name)
    split = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.split(normalised(x), " ").alias("words")))
    lines = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .where(F.lower("text").rlike(found))
        .select("doc_id", kept(F.filter(split, lambda x: x["words"][0] != ""), "lines"))
    )
    whole = F.array(F.struct(F.lit(0).alias("line"), F.flatten(F.transform("lines", lambda x: x["words"])).alias("words")))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / RUN).cast("int")), lambda k: F.slice("lines", k * RUN + 1, F.lit(RUN + longest)))
    onward = lambda i: F.slice(F.flatten(F.transform(F.slice("run", i, F.lit(longest)), lambda x: x["words"])), F.lit(1), F.lit(longest))
    begun = F.transform(F.sequence(F.lit(1), F.least(F.size("run"), F.lit(RUN))), lambda i: F.struct(F.element_at("run", i).alias("at"), F.when(i < F.size("run"), onward(i)).alias("onward")))
    units = (
        lines.where(F.size("lines") > 0)
        .select("doc_id", F.explode(F.concat(F.array(whole), runs)).alias("run"))
        .select("doc_id", F.explode(begun).alias("u"))
        .select("doc_id", F.col("u.at.line").alias("line"), F.col("u.at.words").alias("words"), F.col("u.onward").alias("onward"))
    )
    near = lambda c: F.coalesce(F.array_join(c, " ").rlike(found), F.lit(False))
    # the set has at most as many bigrams as the text; a long text may repeat few of them
    own = F.when((F.size("words") - 1 >= least) & near("words"), F.array_distinct(pairs(F.col("words"))))
    ahead = F.when((F.size("onward") > F.size("words")) & near("onward"), pairs(F.col("onward")))
    grams = (
        units.select("doc_id", "line", F.size("words").alias("n"), kept(F.struct(own.alias("own"), ahead.alias("ahead")), "g"))
        .where((F.col("g.own").isNotNull() & F.size("g.own").between(least, most)) | F.col("g.ahead").isNotNull())
        .select("doc_id", "line", "n", F.col("g.own").alias("own"), F.col("g.ahead").alias("ahead"))
    )

    def score(name: str, grams: list[str], unit: Column) -> Column:
        n = F.size(unit)
        # one literal, split once while the plan is made
        template = F.split(F.lit("|".join(grams)), "[|]")
        dice = 2 * F.size(F.array_intersect(unit, template)) / (n + len(grams))
        return F.when(unit.isNotNull() & (n >= low * len(grams) - 1e-9) & (n <= high * len(grams) + 1e-9), F.struct((-dice).alias("minus"), F.lit(name).alias("license")))

    lined = [score(k, g, F.col("own")) for k, (_, g) in sets.items()]
    wrapped = [F.when(F.col("n") < n, score(k, g, F.array_distinct(F.slice("ahead", 1, n - 1)))) for k, (n, g) in sets.items()]
    best = F.array_min(F.array_compact(F.array(*lined, *wrapped)))
    hits = grams.select("doc_id", F.col("line").cast("long"), kept(best, "best")).where(F.col("best.minus") <= -threshold)
    return hits.select("doc_id", "line", "best.license", (-F.col("best.minus")).alias("dice"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_ROWS = ", ".join(f"('{k}', {len(words_of(v))}, {bigrams_of(v)!r})" for k, v in sorted(TEMPLATES.items()))
ORACLE_SQL = f"""
WITH templates(license, size, b) AS (VALUES {_ROWS}),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
split AS (SELECT r, doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS unit FROM docs),
lines AS (SELECT r, doc_id, line, string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM split),
full_lines AS (SELECT *, (sum(len(w)) OVER (PARTITION BY r ORDER BY line ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM lines WHERE w[1] <> ''),
texts AS (SELECT r, doc_id, flatten(list(w ORDER BY line)) AS w FROM full_lines GROUP BY r, doc_id),
units AS (SELECT r, doc_id, 0 AS line, w, NULL AS wanted FROM texts UNION ALL SELECT r, doc_id, line, w, NULL FROM full_lines UNION ALL
  SELECT l.r, l.doc_id, line, t.w[upto - len(l.w) + 1 : upto - len(l.w) + size], license FROM full_lines l JOIN texts t USING (r), templates WHERE len(l.w) < size AND upto < len(t.w)),
sets AS (SELECT r, doc_id, line, wanted, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM units WHERE len(w) > 1),
scored AS (SELECT r, doc_id, line, license, 2 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM sets JOIN templates ON len(a) BETWEEN 0.66 * len(b) AND 1.51 * len(b) AND coalesce(wanted, license) = license)
SELECT doc_id, line::BIGINT AS line, license, dice FROM scored WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY r, line ORDER BY dice DESC, license) = 1
"""
