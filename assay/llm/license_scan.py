"""Licence scans by Dice coefficient over word bigrams, in DataFrame functions only.

Texts and templates are normalised alike: lower case, every run of characters other than letters
and digits is one space; so line breaks, comment marks and what stands before or behind a notice do
not matter.  A and B, the sets of word bigrams of a window of the text and of a template, match if
their Dice coefficient 2 |A n B| / (|A| + |B|) is at least ``least``.

Windows.  With U = |B| (2 - d) / d, every window of a text of at most U bigrams that begins and ends with
a bigram of the template is judged (one that does not is never better than the one inside it
that does), so words that were put in, left out or changed anywhere do not hide a notice.

Pruning, without loss: |A| must lie between |B| d / (2 - d) and U.  A match shares at least
d |B| / (2 - d) bigrams of the template, so it has one of any |B| - that + 1 of them; the longest ones serve
as anchors.  A text is exploded into its bigrams with their positions, which meet the anchors inside
the scan's stage.  An anchor at hand, the windows are those whose first anchor it is: they begin behind the anchor
before it.  From each beginning the window grows to U bigrams, if as many as needed are in reach, and the
number of distinct bigrams and of shared ones is kept while it grows.  Words are cut out at once, so no
row holds more of a text than one window.

Result: one row per text and template with the best window.  Defined cases: null and empty texts and
texts of one word (no bigram) match nothing; very long texts are scanned whole; windows are cut at the
ends of a text; equal rows and rows with equal or null ids each count; of equally good windows the
first counts, and of those the shortest; a template of one word is ignored; an empty table, or no templates, give no rows; only
doc_id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .common import table

LEAST = 0.8
#: Places of template bigrams that may be broadcast (60 bytes each or so, twice); more are joined by a shuffle.
BROADCAST_BIGRAMS = 500_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""


def _gnu(what: str, name: str, version: str) -> str:
    """The notice of a GNU licence, as its appendix words it."""
    return f"""{what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
{what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
You should have received a copy of the {name} along with {what.lower()}. If not, see <https://www.gnu.org/licenses/>."""


#: Licence name, wording.  Short notices first, then the well-known longer texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0", _gnu("This program", "GNU General Public License", "3")),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("GPL-2.0", _gnu("This program", "GNU General Public License", "2")),
    ("LGPL-3.0", _gnu("This library", "GNU Lesser General Public License", "3")),
    ("LGPL-2.1", _gnu("This library", "GNU Lesser General Public License", "2.1")),
    ("AGPL-3.0", _gnu("This program", "GNU Affero General Public License", "3")),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
]


def words(text: Column) -> Column:
    """The words of a normalised text; one empty word if it has none."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def pairs(w: Column) -> Column:
    """The word bigrams in order."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def bigrams(w: Column) -> Column:
    """The distinct word bigrams."""
    return F.array_distinct(pairs(w))


def _once(value: Column, name: str) -> Column:
    """A column that later filters do not compute again: they stay above the generator."""
    return F.explode(F.array(value)).alias(name)


def templates(spark: SparkSession, rows: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "template_id int, license string, template string")


_RESULT = "doc_id long, template_id int, license string, dice double, start long, found string"


def scan(docs: DataFrame, known: DataFrame, least: float = LEAST, text: str = "text") -> DataFrame:
    """One row per text and template that matches: doc_id, template_id, license, dice, start (a word's number, from 0) and found, the window's words.

    known: columns template_id, license, template.
    """
    known = known.select("template_id", "license", bigrams(words(F.col("template"))).alias("b")).withColumn("nb", F.size("b")).where("nb > 0")
    need = F.ceil(F.lit(least / (2 - least) - 1e-9) * F.col("nb")).cast("int")
    most = F.floor(F.lit((2 - least) / least + 1e-9) * F.col("nb")).cast("int")
    by_length = F.expr("array_sort(b, (x, y) -> case when length(x) <> length(y) then length(y) - length(x) when x < y then -1 when x > y then 1 else 0 end)")
    known = known.withColumn("need", need).withColumn("most", most).withColumn("chosen", F.slice(by_length, F.lit(1), F.col("nb") - F.col("need") + 1))
    anchors = known.select(F.explode("chosen").alias("bigram"), "template_id", "most").groupBy("bigram").agg(F.collect_list(F.struct("template_id", "most")).alias("of"))
    size = known.agg(F.coalesce(F.sum("nb"), F.lit(0))).first()[0]
    if not size:
        return docs.sparkSession.createDataFrame([], _RESULT)
    lists = known.select("template_id", "license", "b", "nb", "need", "most", "chosen")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col(text)).alias("w"))
    exploded = F.posexplode(pairs(F.col("w"))).alias("pos", "bigram")
    if size <= BROADCAST_BIGRAMS:
        anchors, lists = F.broadcast(anchors), F.broadcast(lists)
        met = rows.select("_row", "doc_id", "w", exploded).join(anchors, "bigram")
    else:
        rows = materialise(rows, "license-words")  # the shuffle takes bigrams alone, and words are fetched by row
        met = rows.select("_row", exploded).join(anchors, "bigram").join(rows, "_row")
    met = met.select("_row", "doc_id", "w", "pos", F.explode("of").alias("t"))
    # the bigrams up to the anchor that a window may begin with, the anchor last, and the words from the anchor on
    low = F.greatest(F.col("pos") - F.col("t.most") + 1, F.lit(0))
    left, right = F.slice("w", low + 1, F.col("pos") - low + 2), F.slice("w", F.col("pos") + 3, F.col("t.most"))
    near = met.select("_row", "doc_id", F.col("t.template_id").alias("template_id"), low.cast("long").alias("low"), _once(F.concat(left, right), "near"), (F.col("pos") - low).alias("p"))
    near = near.join(lists, "template_id").withColumn("lead", F.slice(pairs(F.col("near")), F.lit(1), F.col("p")))
    before = F.coalesce(F.array_max(F.transform("lead", lambda x, i: F.when(F.array_contains("chosen", x), i))), F.lit(-1))
    begins = F.filter(F.sequence(before + 1, F.col("p")), lambda i: (i == F.col("p")) | F.array_contains("b", F.get("lead", i)))
    begun = near.select("_row", "doc_id", "template_id", "license", "low", "near", "b", "nb", "need", "most", F.explode(begins).alias("s"))
    cut = begun.select("_row", "doc_id", "template_id", "license", "b", "nb", "need", (F.col("low") + F.col("s")).alias("start"), _once(F.slice("near", F.col("s") + 1, F.col("most") + 1), "win"))
    cut = cut.select("*", _once(pairs(F.col("win")), "g")).where(F.size(F.array_intersect("g", "b")) >= F.col("need"))
    # how far it grows: distinct bigrams a, shared ones i, places n, and the best so far with its places
    marks = F.transform("g", lambda x, i: F.struct((F.array_position("g", x) == i + 1).alias("new"), F.array_contains("b", x).alias("of")))
    begin = F.struct(F.lit(0).alias("a"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(-1.0).alias("best"), F.lit(0).alias("size"))

    def grown(acc: Column, x: Column) -> Column:
        a, i, n = acc["a"] + x["new"].cast("int"), acc["i"] + (x["new"] & x["of"]).cast("int"), acc["n"] + 1
        dice = F.when(x["of"] & (a >= F.col("nb") * (least / (2 - least)) - 1e-9) & (a <= F.col("nb") * ((2 - least) / least) + 1e-9), 2.0 * i / (a + F.col("nb"))).otherwise(-1.0)
        return F.struct(a.alias("a"), i.alias("i"), n.alias("n"), F.greatest(acc["best"], dice).alias("best"), F.when(dice > acc["best"], n).otherwise(acc["size"]).alias("size"))

    grows = cut.select("_row", "doc_id", "template_id", "license", "start", "win", _once(F.aggregate(marks, begin, grown), "m")).where(F.col("m.best") >= least)
    best = F.max(F.struct(F.col("m.best").alias("dice"), (-F.col("start")).alias("p"), F.concat_ws(" ", F.slice("win", F.lit(1), F.col("m.size") + 1)).alias("found"), "license")).alias("m")
    return grows.groupBy("_row", "doc_id", "template_id").agg(best).select("doc_id", "template_id", "m.license", "m.dice", (-F.col("m.p")).alias("start"), "m.found")


def op2_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice in documents, by the built-in templates."""
    found = scan(table(spark, sf_dir, "documents"), templates(spark))
    return found.withColumn("dice", F.round("dice", 6))


_VALUES = ", ".join(f"""({i}, '{n}', '{t.replace("'", "''")}')""" for i, (n, t) in enumerate(TEMPLATES))
_SQL_WORDS = r"list_filter(string_split(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_SQL_PAIRS = "list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"
ORACLE = f"""
WITH t AS (SELECT template_id, license, {_SQL_WORDS.format(x="template")} AS tw FROM (VALUES {_VALUES}) AS v(template_id, license, template)),
tb AS (SELECT *, {_SQL_PAIRS.format(w="tw")} AS p, list_distinct({_SQL_PAIRS.format(w="tw")}) AS b FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS.format(x="text")} AS w FROM documents),
g AS (SELECT r, unnest(range(len(w) - 1)) AS pos, unnest({_SQL_PAIRS.format(w="w")}) AS bigram FROM d WHERE len(w) > 1),
hits AS (SELECT r, template_id, pos, bigram FROM g JOIN (SELECT template_id, unnest(b) AS bigram FROM tb) USING (bigram)),
enough AS (SELECT r, template_id FROM hits JOIN tb USING (template_id) GROUP BY r, template_id, len(b) HAVING count(DISTINCT bigram) >= len(b) * {LEAST / (2 - LEAST)} - 1e-9),
wins AS (SELECT x.r, x.template_id, x.pos AS start, y.pos - x.pos + 1 AS n FROM hits x JOIN enough USING (r, template_id) JOIN hits y ON y.r = x.r AND y.template_id = x.template_id AND y.pos >= x.pos JOIN tb ON tb.template_id = x.template_id
WHERE y.pos - x.pos + 1 BETWEEN len(b) * {LEAST / (2 - LEAST)} - 1e-9 AND len(b) * {(2 - LEAST) / LEAST} + 1e-9),
a AS (SELECT r, doc_id, template_id, start, n, list_slice(w, start + 1, start + n + 1) AS win FROM wins JOIN d USING (r)),
s AS (SELECT *, list_distinct({_SQL_PAIRS.format(w="win")}) AS a FROM a),
m AS (SELECT r, doc_id, template_id, license, start, n, array_to_string(win, ' ') AS found, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM s JOIN tb USING (template_id) WHERE len(a) >= len(b) * {LEAST / (2 - LEAST)} - 1e-9)
SELECT doc_id, template_id, license, round(dice, 6) AS dice, start, found
FROM (SELECT *, row_number() OVER (PARTITION BY r, template_id ORDER BY dice DESC, start, n) AS k FROM m WHERE dice >= {LEAST}) WHERE k = 1
"""

QUERIES = {"op2_license_dice": op2_license_dice}
ORACLES = {"op2_license_dice": ORACLE}
