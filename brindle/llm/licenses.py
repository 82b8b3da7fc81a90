"""License scan by canonical digest lookup, in Spark's own expressions only.

A text is brought to a canonical form: lower case, without copyright lines, with one spelling for words that have several, and with
single spaces for punctuation. The digests of whole units (the document, each of its lines, each of its sentences) are then
looked up among the digests of known license texts and notices by a hash join.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCE, LINE = "\x01", "\n"

# Patterns and what they become, in this order; both Java's and RE2's regular expressions read them alike.
STEPS = (
    ("\r\n?", "\n"),
    (r"(?m)^[ \t#*/;-]*(?:copyright|\(c\)|©)[^\n]*?(?:[a-z0-9]{2}\.[ \t]+|$)", ""),
    (r"(?m)^[ \t#*/;-]*all rights reserved\.?[ \t]*$", ""),
    (r"licenc(e|ing)", "licens$1"),
    (r"non-?commercial", "non commercial"),
    (r"share-?alike", "share alike"),
    (r"no-?deriv(?:ative)?s\b", "no derivatives"),
    (r"\bversion[ \t]+([0-9])", "v$1"),
    (r"(authori|recogni|organi|customi|utili)s(e|ing|ation)", "$1z$2"),
    (r"\b(behavi|fav|hon|col)our", "$1or"),
    (r"https?://(?:www\.)?", "http "),
    (r"[.!?][ \t]+", SENTENCE),
    (r"[\x00\x02-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " "),
)

# Names of licenses as notices give them.
NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache License 2.0", "the Apache License 2.0", "Apache-2.0"),
    "MIT": ("the MIT License", "MIT License", "MIT", "the MIT Licence (Expat)"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "GPLv2", "GPL-2.0"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "GPLv3", "GPL-3.0"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "BSD-3-Clause"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "the CC0 1.0 Universal Public Domain Dedication"),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
SUBJECTS = ("", "This work is ", "This software is ", "This project is ", "This code is ", "This document is ", "This file is ", "This article is ", "This material is ")
VERBS = ("licensed under", "released under", "distributed under", "made available under", "available under", "published under")

# Whole license texts without their copyright lines.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = {
    "BSD-2-Clause": f"{_BSD}\n{_BSD_WARRANTY}",
    "BSD-3-Clause": f"{_BSD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_WARRANTY}",
    "MIT": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_WARRANTY}""",
    "ISC": f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
{_ISC_WARRANTY}""",
    "0BSD": f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
{_ISC_WARRANTY}""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": f"""This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
{_WARRANTY}
For more information, please refer to <https://unlicense.org>""",
}
# The notices of several lines by which files refer to the longer licenses, as each asks for.
def _gnu(name: str, version: int, semicolon: str = ":") -> str:
    return f"""This program is free software{semicolon} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""


HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0": _gnu("GNU General Public License", 2, ";"),
    "GPL-3.0": _gnu("GNU General Public License", 3),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", 3),
    "AGPL-3.0": _gnu("GNU Affero General Public License", 3),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
TITLES = {"BSD-2-Clause": "BSD 2-Clause License\n", "BSD-3-Clause": "BSD 3-Clause License\n", "MIT": "MIT License\n", "ISC": "ISC License\n", "0BSD": "BSD Zero Clause License\n", "Zlib": "zlib License\n", "Unlicense": ""}


def known_texts() -> list[tuple[str, str, str]]:
    """(license_id, text, kind) of everything that is known: each notice that subjects, verbs and names make, identifiers, and the whole texts and headers with and without a title."""
    return [(i, f"{s}{v} {n}", "notice") for i, names in NAMES.items() for s, v, n in product(SUBJECTS, VERBS, names)] + _other_texts()


def _other_texts() -> list[tuple[str, str, str]]:
    identifiers = [(i, f"SPDX-License-Identifier: {i}", "identifier") for i in dict.fromkeys((*NAMES, *TEXTS))]
    whole = [(i, t, "text") for i, text in TEXTS.items() for t in dict.fromkeys((text, TITLES[i] + text))]
    first_lines = [(i, text.split("\n")[0], "notice") for i, text in HEADERS.items()]
    return identifiers + whole + [(i, text, "notice") for i, text in HEADERS.items()] + first_lines


def _rows(rows) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text"), F.lit(k).alias("kind")) for i, t, k in rows])


def canonical(text: Column) -> Column:
    """A text in canonical form, where line ends and sentence ends still stand as marks."""
    out = F.lower(text)
    for pattern, becomes in STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(becomes))
    return out


def _whole(marked: Column) -> Column:
    return F.trim(F.regexp_replace(marked, F.lit(f"[ {LINE}{SENTENCE}]+"), F.lit(" ")))


def units(marked: Column) -> Column:
    """The distinct units of a text in canonical form: the whole of it, its lines and its sentences."""
    lines = F.split(F.regexp_replace(marked, F.lit(f" *{SENTENCE} *"), F.lit(" ")), LINE)
    sentences = F.split(marked, f"[{LINE}{SENTENCE}]")
    trimmed = F.transform(F.concat(lines, sentences), lambda x: F.trim(x))
    return F.array_distinct(F.concat(F.array(_whole(marked)), trimmed))


def known_digests(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(digest, license_id, kind, length) of ``known_texts`` and of ``more`` (license_id, text): texts that a user knows besides, such as the whole long licenses."""
    one = spark.range(1)
    words = lambda all_: F.explode(F.array(*map(F.lit, all_)))
    names = one.select(F.inline(_rows((i, n, "notice") for i, many in NAMES.items() for n in many))).withColumnRenamed("text", "name")
    notices = names.withColumn("subject", words(SUBJECTS)).withColumn("verb", words(VERBS)).select("license_id", F.concat("subject", "verb", F.lit(" "), "name").alias("text"), "kind")
    texts = notices.union(one.select(F.inline(_rows(_other_texts()))))
    if more is not None:
        texts = texts.union(more.select("license_id", "text", F.lit("text")))
    texts = texts.withColumn("form", _whole(canonical(F.col("text"))))
    return texts.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.min("kind").alias("kind"), F.max(F.length("form")).alias("length"))


def license_hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """(doc_id, license_id, n_units, whole_text, kinds): for each document and license, how many distinct units of the document are known texts of that license, whether the whole document is one, and what they are, of identifier, notice and text.

    Documents without a hit have no row. A null text has no units; rows with one doc_id, null included, are counted together, repeated rows as often as they stand. Only units as long as some
    known text are hashed: no other can equal one. Extra columns are not read. ``more`` (license_id, text) are further known texts, however many: the built-in ones alone are broadcast, with more of them the optimiser chooses the join by their size.
    """
    known = known_digests(docs.sparkSession, more)
    longest, shortest = known.agg(F.max("length"), F.min("length")).first()
    known = known.select("digest", "license_id", "kind")
    marked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), canonical(F.col(f"`{text_col}`")).alias("marked"))
    each = marked.select("doc_id", _whole(F.col("marked")).alias("whole"), F.explode(units(F.col("marked"))).alias("unit")).where(F.length("unit").between(shortest, longest))
    hits = each.select("doc_id", F.sha2("unit", 256).alias("digest"), (F.col("unit") == F.col("whole")).alias("is_whole")).join(F.broadcast(known) if more is None else known, "digest")
    kinds = F.array_join(F.array_sort(F.collect_set("kind")), ",")
    return hits.groupBy("doc_id", "license_id").agg(F.count("*").alias("n_units"), F.bool_or("is_whole").alias("whole_text"), kinds.alias("kinds"))


def oracle() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    form = "lower(text)"
    for pattern, becomes in STEPS:
        form = f"regexp_replace({form}, {quote(pattern)}, {quote(becomes.replace('$', chr(92)))}, 'g')"
    whole = f"trim(regexp_replace(marked, {quote(f'[ {LINE}{SENTENCE}]+')}, ' ', 'g'), ' ')"
    values = ", ".join(f"({', '.join(map(quote, row))})" for row in dict.fromkeys(known_texts()))
    return f"""
        WITH known AS (
            SELECT sha256({whole}) AS digest, min(license_id) AS license_id, min(kind) AS kind FROM (SELECT license_id, kind, {form} AS marked FROM (VALUES {values}) AS t(license_id, text, kind)) GROUP BY 1
        ), marked AS (SELECT doc_id, {form} AS marked FROM documents WHERE text IS NOT NULL),
        each AS (
            SELECT DISTINCT doc_id, row, {whole} AS whole, trim(unnest(list_concat([{whole}],
                string_split(regexp_replace(marked, {quote(f' *{SENTENCE} *')}, ' ', 'g'), chr(10)),
                string_split_regex(marked, {quote(f'[{LINE}{SENTENCE}]')}))), ' ') AS unit
            FROM (SELECT row_number() OVER () AS row, * FROM marked)
        )
        SELECT doc_id, license_id, count(*) AS n_units, bool_or(unit = whole) AS whole_text, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds
        FROM each JOIN known ON sha256(unit) = digest GROUP BY ALL
    """
