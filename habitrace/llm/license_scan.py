"""License scan: MinHash bands over overlapping text windows, exact containment.

Words are lower-cased runs of letters and digits; shingles are five words, each
a 64-bit hash. Templates are cut into windows at every place, documents at
every half window, so that every intact copy of a template holds one of its
windows, aligned. A template of n shingles is retrieved by windows of the width
that ``WIDTHS`` names for n: 8 shingles for all but short notices, down to 1 for
a notice of one shingle. Of each window the min-hash in each band is kept (one
row a band); a pair of windows with Jaccard similarity s shares a band with
probability 1 - (1 - s)^bands: 0.998 at s = 0.8 and always for an intact one.
A template long enough for an edit inside has more windows, and containment of
0.8 leaves most of them intact.

What is retrieved is verified exactly: of the template's different shingles, at
least 0.8 must lie in the part of the document around the hit.

All of it is built-in expressions. The templates are constants of the plan
(``MAX_KEYS`` bounds them), so nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.8
#: (least shingles of a template, width of its windows, bands), widest first.
WIDTHS = ((11, 8, 4), (5, 4, 2), (2, 2, 1), (1, 1, 1))
#: Window keys of all templates together, at most: some tens of thousands of words.
MAX_KEYS = 200_000

#: Public license texts and the notices by which long ones are applied.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}


def words_of(text: Column) -> Column:
    """Lower-case words; anything but letters and digits separates."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hashes of all runs of five words; fewer words: of the whole sequence; none: empty."""
    at = lambda i, k: F.get(words, i + k)
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(at(i, k) for k in range(SHINGLE))))
    short = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(n >= SHINGLE, runs).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))


def _mask(width: int, band: int) -> int:
    """One fixed permutation per width and band: the hash XOR an odd multiple of the golden ratio."""
    return (0x9E3779B97F4A7C15 * (2 * (4 * width + band) + 1)) % (1 << 63)


def keys_of(hashes: Column, width: int, bands: int, step: int) -> Column:
    """Min-hashes of the windows of ``width`` shingles at every ``step``: {key, at}, ``at`` counting from 0.

    ``hashes`` must be a column (not an expression, which each window would
    compute again). The least hash of a window is found under each band's
    permutation, which also keeps widths and bands apart.
    """
    starts = F.sequence(F.lit(0), F.size(hashes) - width, F.lit(step))

    def under(band: int) -> Column:
        def one(i: Column) -> Column:
            cells = [F.get(hashes, i + k).bitwiseXOR(F.lit(_mask(width, band))) for k in range(width)]
            return F.struct((F.least(*cells) if width > 1 else cells[0]).alias("key"), i.alias("at"))

        return F.transform(starts, one)

    made = [under(band) for band in range(bands)]
    found = F.concat(*made) if bands > 1 else made[0]
    return F.when(F.size(hashes) >= width, found).otherwise(F.array().cast("array<struct<key:bigint,at:int>>"))


def template_table(spark: SparkSession, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(template, license, n, shingles, run): one row per template text."""
    rows = [(f"{name}#{i}", name, text) for name, texts in (templates or TEMPLATES).items() for i, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "template string, license string, text string")
    run = shingles_of(words_of(F.col("text")))
    return table.select("template", "license", run.alias("run"), F.array_distinct(run).alias("shingles")).withColumn("n", F.size("shingles")).filter("n > 0")


def _template_keys(templates: DataFrame) -> DataFrame:
    """(key, template, width) of every window of every template, at the width of its size."""
    found = []
    for k, (least, width, bands) in enumerate(WIDTHS):
        own = templates.filter((F.size("run") >= least) & (F.size("run") < (WIDTHS[k - 1][0] if k else 1 << 30)))
        found.append(own.select(F.explode(keys_of(F.col("run"), width, bands, 1)).alias("k"), "template").select("k.key", "template", F.lit(width).alias("width")))
    return found[0].union(found[1]).union(found[2]).union(found[3]).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, template, license, contained, at) per document and template that occurs.

    ``contained`` is the share of the template's different shingles found
    around the best hit, ``at`` the shingle number of that hit, from 1. Of
    templates whose best hits share a place, those contained most are reported.
    Null, empty and unmatched texts give no row, and so does an empty table;
    texts of any length are scanned whole. Rows that share an id are reported
    together, as are all rows without one (their ``doc_id`` is null). Other
    columns, whatever they are called, are left out.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates)
    rows = _template_keys(known).collect()
    if len(rows) > MAX_KEYS:
        raise ValueError(f"the templates have {len(rows)} window keys, more than {MAX_KEYS}")
    keys = spark.createDataFrame([tuple(r) for r in rows], "key long, template string, width int").drop("width")
    words = docs.select(F.col(id_col).alias("doc_id"), words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("words"))
    hashed = words.select("doc_id", shingles_of(F.col("words")).alias("h"))
    windows = hashed.select("doc_id", "h", *(keys_of(F.col("h"), width, bands, max(1, width // 2)).alias(f"w{width}") for _, width, bands in WIDTHS))
    # a text without a hit has nothing to explode; a filter before would compute all of it twice
    among = []
    for width in {r.width for r in rows}:
        wanted = ", ".join(f"{r.key}L" for r in rows if r.width == width)
        among.append(f"filter(w{width}, x -> x.key in ({wanted}))")
    if not among:
        among = ["filter(w1, x -> false)"]
    hits = windows.select("doc_id", "h", F.explode(F.expr(f"concat({', '.join(among)})")).alias("hit")).select("doc_id", "h", "hit.key", (F.col("hit.at") + 1).alias("at"))
    found = hits.join(F.broadcast(keys), "key").join(F.broadcast(known.select("template", "license", "n", "shingles")), "template")
    first = F.greatest(F.col("at") - F.col("n") - WIDTHS[0][1], F.lit(1))
    share = F.size(F.array_intersect("shingles", F.slice("h", first, F.col("at") + F.col("n") + 2 * WIDTHS[0][1] - first))) / F.col("n")
    verified = found.select("doc_id", "template", "license", share.alias("contained"), "at").filter(F.col("contained") >= CONTAINED)
    best = verified.groupBy("doc_id", "template", "license").agg(F.max(F.struct("contained", (-F.col("at")).alias("before"))).alias("b"))
    told = best.select("doc_id", "template", "license", F.col("b.contained").alias("contained"), (-F.col("b.before")).cast("long").alias("at"))
    # of templates that meet at one place, those that fit best
    most = F.max("contained").over(Window.partitionBy("doc_id", "at"))
    return told.withColumn("most", most).filter("contained = most").drop("most")
