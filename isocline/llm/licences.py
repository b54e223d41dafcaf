"""Licence scans by canonical digests, with DataFrame functions only.

A text is made canonical: copyright lines go, equivalent spellings become one, case and punctuation vanish and white
space collapses. Its SHA-256 is joined with the digests of known licence texts and notices, made canonical by the same
expression. The same look-up of each line tells the notices within longer documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, small_side, staged

# Spellings that count as one, as (pattern, replacement), in lower case.
SPELLINGS = (
    (r"licen[cs](e|ed|es|ing|ee|or)\b", "licens$1"),
    (r"\bsub[- ]licen", "sublicen"),
    (r"organis", "organiz"),
    (r"\bnon[- ]commercial", "noncommercial"),
    (r"\bfavour", "favor"),
    (r"\bhttps://", "http://"),
    (r"\bgnu general public license\b", "gpl"),
    (r"\bversion (\d)", "v$1"),
)
# A notice, not a line that a sentence on copyright happens to begin.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright[ \t]*(\(c\)|©|:|by\b|[0-9])|\(c\)|©|all rights reserved)[^\n]*$"

# A line of nothing but the word and at most twelve capitalised names.
_NAME = r"(\p{Lu}[\p{L}\p{N}.,&'-]*|and|the)"
NAMED_LINE = rf"(?m)^[ \t#*/;-]*[Cc]opyright[ \t]+{_NAME}([ \t]+{_NAME}){{0,11}}[ \t]*$"

# Short public licence texts and customary notices, by SPDX identifier.
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
)
# Customary titles above whole licences.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"),
    "Zlib": ("zlib License", "The zlib/libpng License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "Unlicense": ("The Unlicense",),
}
# The digests of the canonical forms of long public licences.
DIGESTS = (
    ("Apache-2.0", "8ef46259cbb1cc814f97024f75e027f30ae5a905592c0d9785545b2af450b389"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "1048e86d09834e8b3538c8ac847735b574c48661f17ff44bc34ea749b2f685ec"),
    ("GFDL-1.3", "c3b1c157bcd70cca85d38ee97a053f8c4ab5cd320e9236d5c2b0cbf78320a064"),
    ("GPL-1.0", "227cd29a65dab6ee00f6b779e50499f35a0c46ed2f7cbd294ef3ba077075007f"),
    ("GPL-2.0", "bbca2d1fe02e2ca98a885f0285b5ed7720671a66dd93bd03c8aa77b23e9808c7"),
    ("GPL-3.0", "239ba90ba5eb438d22034cfb23aa9533987276ef2aa9f11800d78716603ab619"),
    ("LGPL-2.0", "25707b0b0ea40461ce2b95b453e1f95ef5c9c0180cf9733631f4012221e59987"),
    ("LGPL-2.1", "101228c215b533273dd3eb0e1d85b6e6aeb3bd62ebc626b235ba229ca744fad7"),
    ("LGPL-3.0", "4df2d113ee825ef23660104d6f246ff8ed2b29136e2cd6808361a218967aa148"),
    ("MPL-1.1", "fe8cafdf62e599750c20df692e47068503235a2c3bf72a8f31d959958144e0cd"),
    ("MPL-2.0", "db862751263d5122ccc59c7f2eb41bf84dd89c26f8058fba9be387afac130ba0"),
)


def _without_copyright(text: Column) -> Column:
    """A text in lower case without its copyright lines."""
    return F.regexp_replace(F.translate(F.regexp_replace(text, "(?d)" + NAMED_LINE, " "), UPPER, LOWER), "(?d)" + COPYRIGHT_LINE, " ")


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty if nothing but white space, marks and copyright lines is in it."""
    out = F.regexp_replace(_without_copyright(text), r"\s+", " ")
    for pattern, instead in SPELLINGS:
        out = F.regexp_replace(out, pattern, instead)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def lines_of(text: Column) -> Column:
    """The canonical forms of a text's lines, as canonical() gives them, in a few passes over the whole text."""
    out = F.regexp_replace(_without_copyright(text), r"[^\S\n]+", " ")
    for pattern, instead in SPELLINGS:  # none reaches beyond a line
        out = F.regexp_replace(out, pattern, instead)
    return F.transform(F.split(F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " "), "\n"), lambda x: F.trim(x))


def known_texts(known=KNOWN, titles=TITLES) -> list[tuple[str, str]]:
    """(licence, text): the known texts, and whole licences also under their customary titles."""
    return [(name, text) for name, text in known] + [(name, f"{title}\n\n{text}") for name, text in known if "\n" in text for title in titles.get(name, ())]


def known_digests(spark: SparkSession, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """digest, licence of the known texts and of longer ones that are known by their digest; of equal digests, the first identifier by name."""
    rows = spark.createDataFrame(known_texts(known), "licence string, text string").select("licence", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    if digests:
        rows = rows.unionByName(spark.createDataFrame(list(digests), "licence string, digest string"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, licence (of the entire text, or null), line_licences (sorted, of whole lines) of every row.

    known: digest, licence, with distinct digests, of any number; it is broadcast if its counted rows fit the bound, and both
    sides are shuffled otherwise. Entire texts and, for the notices within longer documents, all lines are joined by their
    digests. Texts that are null, empty or without letters and digits have a null digest and licence, and no lines. Texts of
    any length count whole. Repeated rows are scanned alike; an empty table gives an empty result. Further columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = staged(known.select("digest", "licence"), "known")
    listed = small_side(known, 300)
    lines = docs.select("doc_id", F.xxhash64("text").alias("at"), F.explode(F.array_distinct(lines_of(text))).alias("line")).where("line <> ''")
    lines = lines.select("doc_id", "at", F.sha2("line", 256).alias("digest")).join(listed, "digest")
    lines = lines.groupBy("doc_id", "at").agg(F.array_sort(F.collect_set("licence")).alias("line_licences"))
    hits = small_side(staged(lines.select(F.col("doc_id").alias("of"), F.col("at").alias("of_at"), "line_licences"), "lines"), 300)
    rows = docs.select("doc_id", F.xxhash64("text").alias("at"), canonical(text).alias("form"))
    rows = rows.select("doc_id", "at", F.when(F.col("form") != "", F.sha2("form", 256)).alias("digest"))
    found = rows.join(listed, "digest", "left").join(hits, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("at") == F.col("of_at")), "left")
    return found.select("doc_id", "digest", "licence", F.coalesce("line_licences", F.array().cast("array<string>")).alias("line_licences"))


def _sql() -> str:
    def form(x: str) -> str:
        named = NAMED_LINE.replace("'", "''")
        out = f"regexp_replace(translate(regexp_replace({x}, '{named}', ' ', 'g'), '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE}', ' ', 'g')"
        for pattern, instead in ((r"\s+", " "), *SPELLINGS, (r"[^\p{L}\p{N}]+", " ")):
            out = f"regexp_replace({out}, '{pattern}', '{instead.replace('$', chr(92))}', 'g')"
        return f"trim({out})"

    values = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in known_texts())
    digests = ", ".join(f"('{name}', '{digest}')" for name, digest in DIGESTS)
    return f"""
WITH texts AS (SELECT licence, sha256({form("text")}) AS digest FROM (VALUES {values}) v(licence, text) UNION ALL SELECT * FROM (VALUES {digests}) d(licence, digest)),
known AS (SELECT digest, min(licence) AS licence FROM texts GROUP BY 1),
docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents),
whole AS (SELECT n, CASE WHEN {form("text")} <> '' THEN sha256({form("text")}) END AS digest FROM docs),
lines AS (SELECT n, unnest(string_split(text, chr(10))) AS line FROM docs),
of_lines AS (SELECT n, list_sort(list(DISTINCT licence)) AS found FROM lines JOIN known ON sha256({form("line")}) = known.digest GROUP BY n)
SELECT doc_id, whole.digest, known.licence, coalesce(found, []::VARCHAR[]) AS line_licences
FROM docs JOIN whole USING (n) LEFT JOIN known ON whole.digest = known.digest LEFT JOIN of_lines USING (n)"""


ORACLE = _sql()
