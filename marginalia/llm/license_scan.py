"""Licence notices and texts, found by the Dice coefficient over word bigrams.

Compared units are the lines, the sentences, the paragraphs and the whole of each text, and windows of consecutive
paragraphs. Words are letters and digits, so comment marks are none, and a line without words ends a paragraph, be it blank or
a bare comment mark. A unit with x distinct bigrams can only reach a coefficient t with a template of y if
t / (2 - t) <= x / y <= (2 - t) / t, which prunes templates before any bigram is compared; and it must hold one of some
anchors, parts of words that licences are full of or that the templates ask for.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

# Names, wordings and full texts of public licences and notices.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"
_GNU = "This {thing} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation{comma} either version {n} of the License, or (at your option) any later version."
_GNU_REST = "This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details. You should have received a copy of the GNU {name}General Public License along with this {thing}{end}"
_GNU_ENDS = (". If not, see <https://www.gnu.org/licenses/>.", "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA")
_GNU_NAMES = (("GPL-3.0-or-later", "", "3"), ("GPL-2.0-or-later", "", "2"), ("GPL-1.0-or-later", "", "1"), ("LGPL-3.0-or-later", "Lesser ", "3"), ("LGPL-2.1-or-later", "Lesser ", "2.1"), ("LGPL-2.0-or-later", "Library ", "2"), ("AGPL-3.0-or-later", "Affero ", "3"))


def _gnu_notices() -> tuple[tuple[str, str], ...]:
    """The notice of each GNU licence for a program and, of the lesser ones, for a library: its first sentence, and the whole with either end."""
    out = []
    for licence, name, n in _GNU_NAMES:
        for thing in ("program", "library") if licence.startswith("LGPL") else ("program",):
            first = _GNU.format(thing=thing, stop=";", comma=";", name=name, n=n)
            out.append((licence, first))
            out += [(licence, f"{first} {_GNU_REST.format(thing=thing, name=name, end=end)}") for end in _GNU_ENDS]
    return tuple(out)


TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_DISCLAIMER}"),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("Unlicense", _UNLICENSE),
    *_gnu_notices(),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("All-rights-reserved", "All rights reserved."),
)


#: Templates of more bigrams than this are long; windows begin and end with paragraphs that share ENDS bigrams with one.
LONG, ENDS = 30, 3
#: What ends a sentence, and a paragraph, of a lower-cased text.
SENTENCE, PARAGRAPH = r"[.!?;][ \t\r\n]+", r"\n[^a-z0-9\n]*\n"


def words(text: str) -> list[str]:
    """Runs of ASCII letters and digits, lower-cased."""
    return re.findall(r"[a-z0-9]+", text.lower())


def bigrams(text: str) -> set[str]:
    w = words(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


#: Parts of words that licence texts are full of, tried as anchors first.
STEMS = ("licens", "copyright", "redistribut", "permission", "warrant", "software", "reserved", "conditions")


def anchors(templates: tuple[tuple[str, str], ...], threshold: float) -> list[tuple[str, ...]]:
    """Parts of words, or pairs of them, of which a unit has to hold one to be compared.

    The stems come first. A long template with a stem in a tenth of its bigrams or more asks for no others: units that kept
    two thirds of its bigrams yet lost each of those are passed over, and only these. Of all other templates, no unit that
    reaches the threshold is: while the bigrams without an anchor are enough for it, the word is taken that most of such
    bigrams have: one of eight letters or more, else of five or more, else a bigram's two words.
    """
    chosen: list[tuple[str, ...]] = [(s,) for s in STEMS]
    bare = [(n, {p for p in own if not any(s in p for s in STEMS)}) for n, own in ((len(o), o) for o in (bigrams(text) for _, text in templates))]
    bare = [(n, b) for n, b in bare if n <= LONG or 10 * (n - len(b)) < n]
    while True:
        bare = [(n, b) for n, b in bare if 2 * len(b) >= threshold * (1 - 1e-9) * (len(b) + n)]
        if not bare:
            return chosen
        held = Counter(w for _, b in bare for p in b for w in set(p.split()))
        long = next((x for k in (8, 5) if (x := [w for w in held if len(w) >= k])), None)
        if long:
            chosen.append((max(long, key=lambda w: (held[w], len(w), w)),))
        else:
            pairs = Counter(p for _, b in bare for p in b)
            chosen.append(tuple(max(pairs, key=lambda p: (pairs[p], len(p), p)).split()))
        bare = [(n, {p for p in b if not all(c in p for c in chosen[-1])}) for n, b in bare]


def _unit_words(unit: Column) -> Column:
    return F.filter(F.split(unit, "[^a-z0-9]+"), lambda w: w != "")


def _may_match(text: Column, templates: tuple[tuple[str, str], ...], threshold: float) -> Column:
    """Whether a text holds an anchor. The array of one text keeps its lower-casing from being repeated for each anchor."""
    found = anchors(templates, threshold)
    return F.exists(F.array(F.lower(text)), lambda t: reduce(or_, [reduce(and_, [t.contains(w) for w in anchor]) for anchor in found]))


def _pairs(w: Column) -> Column:
    """The distinct bigrams of an array of words."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b)))


def reach_of(threshold: float) -> float:
    """How many times larger one of two sets that reach a threshold may be; what is right at it counts, however it is rounded."""
    return (2 - threshold) / threshold * (1 + 1e-9)


def window_words(templates: tuple[tuple[str, str], ...], threshold: float) -> int:
    """Words of a window of paragraphs at most."""
    return int(max(len(bigrams(t)) for _, t in templates) * reach_of(threshold)) + 1


def long_bigrams(templates: tuple[tuple[str, str], ...]) -> list[str]:
    """The bigrams of all long templates."""
    return sorted(set().union(*(b for _, t in templates if len(b := bigrams(t)) > LONG)))


def _windows(texts: DataFrame, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """(id, row, before, upto, w): each window of two paragraphs or more, from texts with two such ends; only those are shuffled.

    row tells texts apart (a 64-bit hash of id and text), before and upto count the words up to the window's start and end.
    """
    most = window_words(templates, threshold)
    known = F.array(*map(F.lit, long_bigrams(templates)))
    shares = lambda p: F.size(F.array_intersect(_pairs(_unit_words(p)), known)) >= ENDS
    rows = texts.withColumn("p", F.transform(F.split("low", PARAGRAPH), lambda p: F.struct(p.alias("p"), shares(p).alias("end"))))
    rows = rows.filter(F.size(F.filter("p", lambda p: p["end"])) > 1).withColumn("row", F.xxhash64("id", "low")).dropDuplicates(["row"]).select("id", "row", F.posexplode("p").alias("pos", "p"))
    rows = rows.select("id", "row", "pos", "p.end", _unit_words(F.col("p.p")).alias("w")).filter(F.size("w") > 0).withColumn("n", F.size("w"))
    rows = rows.withColumn("upto", F.sum("n").over(Window.partitionBy("row").orderBy("pos")))
    after = Window.partitionBy("row").orderBy("upto").rangeBetween(Window.currentRow, most)
    rows = rows.withColumn("after", F.collect_list(F.struct("upto", "end", "w")).over(after)).filter("end").withColumn("before", F.col("upto") - F.col("n"))
    ends = F.filter(F.sequence(F.lit(2), F.size("after")), lambda k: F.get("after", k - 1)["end"] & (F.get("after", k - 1)["upto"] - F.col("before") <= most))
    rows = rows.filter(F.size("after") > 1).select("id", "row", "before", "after", F.explode(ends).alias("k"))
    return rows.select("id", "row", "before", F.get("after", F.col("k") - 1)["upto"].alias("upto"), F.flatten(F.transform(F.slice("after", 1, F.col("k")), lambda x: x["w"])).alias("w"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.8, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(id_col, license, dice, units): each text and licence with a unit that reaches the threshold.

    dice is the best coefficient, units the number of distinct units that reach it. A unit counts for the template nearest to
    it alone; of equally near ones the licence that sorts first. Units are lines, sentences, paragraphs, the whole text, and
    windows of consecutive paragraphs of up to window_words words that begin and end with a paragraph that shares ENDS
    bigrams with a long template, so a licence is found above code, in a comment, and in its usual paragraphs. Units without an anchor aren't compared (see anchors). A window inside
    a larger one that reaches the threshold with another licence, by more bigrams in common, belongs to that one. Null and empty texts, and units of fewer than two words, match nothing; a null id is a group like any other;
    repeated rows count as one; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    texts = docs.filter(F.col(text_col).isNotNull()).filter(_may_match(F.col(text_col), templates, threshold)).select(F.col(id_col).alias("id"), F.lower(text_col).alias("low"))
    units = F.array_distinct(F.concat(F.split("low", "\n"), F.split("low", SENTENCE), F.split("low", PARAGRAPH), F.array("low")))
    least = min(len(bigrams(t)) for _, t in templates)
    most = max(len(bigrams(t)) for _, t in templates)
    reach = reach_of(threshold)
    unit, key = F.col("unit"), ["id", "row", "before", "upto", "w"]
    rows = texts.select("id", F.explode(units).alias("unit")).filter(_may_match(unit, templates, threshold)).select("id", _unit_words(unit).alias("w"))
    rows = rows.unionByName(_windows(texts, templates, threshold), allowMissingColumns=True).filter(F.size("w") > 1)
    rows = rows.withColumn("pairs", _pairs(F.col("w"))).withColumn("size", F.size("pairs")).filter(F.col("size").between(least / reach, most * reach)).dropDuplicates(key)
    known = spark.createDataFrame([(n, i, sorted(bigrams(t)), len(bigrams(t))) for i, (n, t) in enumerate(templates)], "license string, template int, of array<string>, of_size int")
    near = rows.join(F.broadcast(known), (F.col("size") >= F.col("of_size") / reach) & (F.col("size") <= F.col("of_size") * reach))
    near = near.withColumn("shared", F.size(F.array_intersect("pairs", "of"))).withColumn("dice", 2.0 * F.col("shared") / (F.col("size") + F.col("of_size")))
    best = near.filter(F.col("dice") >= threshold).groupBy(*key).agg(F.min(F.struct((-F.col("dice")).alias("dice"), "license", "shared")).alias("best")).select(*key, "best.*")
    # windows that matched and begin within a window's length before; those of one text are near each other, so few
    around = F.collect_list(F.struct("before", "upto", "license", "shared")).over(Window.partitionBy("row").orderBy("before").rangeBetween(-window_words(templates, threshold), 0))
    holds = lambda x: (x["upto"] >= F.col("upto")) & ((x["before"] < F.col("before")) | (x["upto"] > F.col("upto"))) & (x["license"] != F.col("license")) & (x["shared"] > F.col("shared"))
    windows = best.filter("row IS NOT NULL").withColumn("around", around).filter(~F.exists("around", holds)).drop("around")
    kept = best.filter("row IS NULL").unionByName(windows).groupBy("id", "w").agg(F.first("license").alias("license"), F.first("dice").alias("dice"))
    out = kept.groupBy("id", "license").agg(F.max(-F.col("dice")).alias("dice"), F.count("*").alias("units"))
    return out.select(F.col("id").alias(id_col), "license", "dice", "units")
