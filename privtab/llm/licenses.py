"""Licence scan by canonical digests, in DataFrame functions only.

A text is made canonical: lower case, copyright lines out, punctuation
(comment marks too) and white space to one space, equivalent spellings to one,
empty lines out.  Spellings change inside of words only, so the canonical form
of some lines is that of each, joined.  Entire texts are looked up by a hash
join of SHA-256 digests: the document as a whole, and every run of whole lines
that begins like a known text (same first words) and has its length, however
its lines are wrapped and whatever stands before and after.

The known texts are KNOWN (spelled out) and DIGESTS (long public licences, by
the digest of their canonical form): 23 licences.  A licence that is not among
them, or one whose words were changed, is not found.

Cases: a null or empty text has no licence; a text that is empty when
canonical is never looked up; equal rows each get their result; two known
texts with one canonical form both count; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings taken as equal, after punctuation is out.
SPELLINGS = [("licenc", "licens"), ("organis", "organiz"), ("favour", "favor"), ("noncommercial", "non commercial"),
             ("sublicens", "sub licens"), ("https", "http"), ("version", "v")]
VERSION = r"(^|[ \n])v([0-9])"
COPYRIGHT = r"(^|\n)[ \t#*/;-]*(copyright[ \t]+)?(\(c\)|©|copyright[ \t]+[0-9]{4})[^\n]*"
BETWEEN_WORDS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F‘’“”–—©]+"
BETWEEN_LINES = r" ?\n[ \n]*"
#: Words that a run of lines must share with a known text to be looked up.
FIRST_WORDS = 5
#: Most known texts; their lengths and first words enter the plan as literals.
MOST_KNOWN = 10_000

# Known licence texts and notices (public texts).
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. """
_BSD_THIRD = "3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from " \
             "this software without specific prior written permission. "
_BSD_END = """THIS SOFTWARE IS PROVIDED BY {0} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {1} BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_HOLDERS = [("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDER OR CONTRIBUTORS"),
            ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT OWNER OR CONTRIBUTORS"),
            ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDERS OR CONTRIBUTORS"),
            ("THE AUTHOR AND CONTRIBUTORS", "THE AUTHOR OR CONTRIBUTORS"),
            ("THE REGENTS AND CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS")]
_NAMES = ["the copyright holder", "the University", "the author"]
_0BSD = _ISC.replace(""", provided that the above copyright notice and this permission notice appear in all copies""", "")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_GPL_NOTICE = """This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details."""
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT), ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC), ("ISC", "Licensed under the ISC License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Zlib", _ZLIB), ("Unlicense", _UNLICENSE), ("0BSD", _0BSD), ("Apache-2.0", _APACHE_NOTICE),
    ("GPL-2.0", _GPL_NOTICE.format(";", 2)), ("GPL-3.0", _GPL_NOTICE.format(":", 3)),
    *[("BSD-2-Clause", _BSD_HEAD + _BSD_END.format(*who)) for who in _HOLDERS],
    *[("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD.format(name) + _BSD_END.format(*who))
      for name in _NAMES for who in _HOLDERS],
]
# Long public licence texts by licence, first words, words, characters and SHA-256 of the canonical form.
DIGESTS = [
    ("Apache-2.0", "apache license v 2 0", 1415, 8760, "6da0a2c53447779f44454493935b3680252506bd7d7aba63f2cf2cdbae3d8651"),
    ("Apache-2.0", "apache license v 2 0", 1420, 8788, "9937cfb8ab0abaa1196aee36e78c52ce046f17f81c1228421b2ad689e16a8e5c"),
    ("Apache-2.0", "apache license v 2 0", 1421, 8797, "b6aa99213bdf3bc571217c7d1161057143e7b17338608998324a7965b3cfee52"),
    ("Apache-2.0", "apache license v 2 0", 1597, 9837, "c0ee6e64e6b22f17b8509541d56e8c5a23f560b712be1f111ba1775c76a9be5d"),
    ("Artistic-1.0-Perl", "the artistic license preamble the", 983, 5773, "4830b8c89ffe1c2d5a0734390441c41e05f2ab57847fd3e8612e425d9af2c2fe"),
    ("BSD-3-Clause", "all rights reserved redistribution and", 217, 1381, "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("CC0-1.0", "creative commons legal code cc0", 1089, 6687, "cedb306a4c3ab431b26dbc23700637b53d924e3288491e5033817cbbc51c4003"),
    ("GFDL-1.2", "gnu free documentation license v", 3319, 19329, "7d303da0ecbfb0f21175759594afc4091fc45b6012e4374827060a8c984c92d5"),
    ("GFDL-1.3", "gnu free documentation license v", 3736, 21740, "ae354d0eadcaa1bdd3a6579d21ff9fe59aaeac07b8b878948c9c36732091f2ea"),
    ("GPL-1.0", "gnu general public license v", 1639, 9318, "9c3d7bf17c4482d842f924cfd3eabf78704e670365012a22bbb81a36255ec348"),
    ("GPL-1.0", "gnu general public license v", 1644, 9346, "22203e66a843c1255475e90c5d8636d06fc968c4defc000a507f642cbf473ee2"),
    ("GPL-1.0", "gnu general public license v", 2070, 11678, "58459f5456c54942c467bdc427b260c7560203735bd305cd5f72a1b55c782c01"),
    ("GPL-2.0", "gnu general public license v", 2502, 14386, "6771bf86b91e5cdb6f9a76569f11e7dfc251721cc0c51ab23f994463178f9b1e"),
    ("GPL-2.0", "gnu general public license v", 2507, 14414, "f6c0ddecdd9bc9f9966d645ccc47f2acb2a04dd3e37cb7b934e08bcfef858382"),
    ("GPL-2.0", "gnu general public license v", 2978, 17030, "a6cef08f06df75d7d48133ab086cadee16855052967f5957c7cfb0dbaf8ef357"),
    ("GPL-3.0", "gnu general public license v", 5239, 30721, "5af1a9fa3d3026a0424e781822f3880e4143c682b31bd9e2c368883d98a3098b"),
    ("GPL-3.0", "gnu general public license v", 5244, 30749, "846d70d0fa7d106d2d30028e20e0ebff82ba88c75eadd29d52b4d306c2db0c74"),
    ("GPL-3.0", "gnu general public license v", 5687, 33175, "b9ecbb194a88ecdafc49d4a3428881f12f3db1509d5058a86cee4cc1990b743d"),
    ("LGPL-2.0", "gnu library general public license", 3862, 22137, "2aac1cfc1d0382fd04c985bad97ad5440c610f2935ef5515fca483c12e0f1df0"),
    ("LGPL-2.0", "gnu library general public license", 3867, 22165, "31c19ed20279b86a9f4d008fc8cd1fb6f2f6b1a76a4964e2b0435bb326a8fc0d"),
    ("LGPL-2.0", "gnu library general public license", 4202, 24006, "f07f47ce495ddcbc4d594474c6382be2c92a7b0b353964ba5c8c9f1e4d37ebe5"),
    ("LGPL-2.1", "gnu lesser general public license", 4062, 23189, "039ee5f450e86248a30048b3955949bbf1cb01c0356a37f81f68f7366ee384ab"),
    ("LGPL-2.1", "gnu lesser general public license", 4067, 23217, "98a728109f6c04e3a4453252dacb9b31bc06982c510cd62e9994abb966a90f28"),
    ("LGPL-2.1", "gnu lesser general public license", 4403, 25057, "e976cce05363956328ccb16d8fd878e6f9e869835ec4d63cebf2f275b5b56889"),
    ("LGPL-3.0", "gnu lesser general public license", 1231, 6912, "b732f620d8e49727b82f5c0330ec38c6b5739e4a48b007b9d690023deae07bfe"),
    ("MPL-1.1", "mozilla public license v 1", 3763, 22078, "4037172589d185606b39fc535e5b9080007a72cb0177b96bc728803197cdc25b"),
    ("MPL-2.0", "mozilla public license v 2", 2288, 13454, "4aabb31aab4622d1a14144916be84f704544c6c5640d9e12befde70bfbecdf3a"),
    ("MPL-2.0", "mozilla public license v 2", 2293, 13481, "9066fb35b6ab022c54a49715ab0f5637694d53d06be5cef4314f58bb67640855"),
    ("MPL-2.0", "mozilla public license v 2", 2415, 14134, "2ffba98bfa00f78dc27fc719cc175b7c4e11749fff1794fd9b58f29a27cc4587"),
]


def canonical(text: Column) -> Column:
    """The canonical form, one line for each line that is not empty."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "\n")
    out = F.regexp_replace(F.regexp_replace(out, BETWEEN_WORDS, " "), BETWEEN_LINES, "\n")
    out = F.btrim(out, F.lit(" \n"))
    for said, meant in SPELLINGS:
        out = F.replace(out, F.lit(said), F.lit(meant))
    return F.regexp_replace(out, VERSION, "$1v $2")


def digests(known: DataFrame) -> DataFrame:
    """(license, form_start, words, chars, digest) of known texts (license,
    text); empty ones go."""
    rows = known.select("license", F.translate(canonical(F.col("text")), "\n", " ").alias("form")).filter("form <> ''")
    return rows.select("license", F.substring_index("form", " ", FIRST_WORDS).alias("form_start"),
                       F.size(F.split("form", " ")).alias("words"), F.length("form").alias("chars"),
                       F.sha2("form", 256).alias("digest")).distinct()


def known_texts(spark) -> DataFrame:
    """The table of KNOWN and DIGESTS, as ``digests`` gives it."""
    spelled = digests(spark.createDataFrame(KNOWN, "license string, text string"))
    return spelled.union(spark.createDataFrame(DIGESTS, spelled.schema)).distinct()


def _runs(lines: Column, shapes) -> Column:
    """Runs of whole lines that could be known texts: array of (unit: number of
    the first line, digest).  ``shapes``: (first words, words, characters)."""
    n_first = min([FIRST_WORDS, *[words for _, words, _ in shapes]])
    by_start: dict[str, list] = {}
    for start, words, chars in shapes:
        by_start.setdefault(" ".join(start.split(" ")[:n_first]), []).append((words, chars))
    sizes = F.create_map(*[x for start, each in sorted(by_start.items()) for x in (
        F.lit(start), F.array(*[F.struct(F.lit(w).alias("words"), F.lit(c).alias("chars")) for w, c in sorted(each)]))])
    starts = F.transform(lines, lambda line, i: F.struct((i + 1).alias("unit"), F.substring_index(
        F.array_join(F.slice(lines, i + 1, n_first), " "), " ", n_first).alias("start")))
    near = F.filter(starts, lambda x: x["start"].isin(sorted(by_start)))

    def run(at, size):  # a line has a word or more, so a text of w words is in w lines
        text = F.array_join(F.slice(lines, at["unit"], size["words"]), "\n")
        whole = F.substring(text, size["chars"] + F.lit(1), F.lit(1)).isin("", "\n")
        return F.struct(at["unit"].alias("unit"), F.when(whole, F.sha2(F.translate(
            F.substring(text, F.lit(1), size["chars"]), "\n", " "), 256)).alias("digest"))

    runs = F.flatten(F.transform(near, lambda at: F.transform(sizes[at["start"]], lambda size: run(at, size))))
    return F.filter(runs, lambda x: x["digest"].isNotNull())


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, whole (licences, sorted and joined by comma, whose text
    the document as a whole is; else null), n_notices (lines at which a known
    text starts) and licenses (all found, sorted, joined by comma; empty if
    none).  ``known``: (license, text), at most MOST_KNOWN texts."""
    spark = docs.sparkSession
    table = known_texts(spark) if known is None else digests(known)
    shapes = [tuple(r) for r in table.select("form_start", "words", "chars").distinct().limit(MOST_KNOWN + 1).collect()]
    if len(shapes) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts")
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col).cast("string")).alias("form"),
                       F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("lines", F.filter(F.split(F.coalesce("form", F.lit("")), "\n"), lambda x: x != ""))
    whole = F.array(F.struct(F.lit(0).alias("unit"), F.when(
        F.col("form") != "", F.sha2(F.translate("form", "\n", " "), 256)).alias("digest")))
    units = F.concat(whole, _runs(F.col("lines"), shapes)) if shapes else whole
    looked = (rows.select("row", "doc_id", F.explode(units).alias("_u"))
              .select("row", "doc_id", "_u.unit", "_u.digest")
              .join(table.select("digest", "license").distinct(), "digest", "left"))
    # lists hold names of known licences only, each once
    names = looked.groupBy("row", "doc_id").agg(
        F.collect_set(F.when(F.col("unit") == 0, F.col("license"))).alias("whole"),
        F.count_distinct(F.when((F.col("unit") > 0) & F.col("license").isNotNull(), F.col("unit"))).alias("n_notices"),
        F.collect_set("license").alias("found"))
    return names.select("doc_id", F.nullif(F.array_join(F.array_sort("whole"), ","), F.lit("")).alias("whole"),
                        "n_notices", F.array_join(F.array_sort("found"), ",").alias("licenses"))


def oracle() -> str:
    """DuckDB SQL for ``scan`` over ``documents`` with the known texts."""
    def form(text: str) -> str:
        out = f"regexp_replace(lower({text}), '{COPYRIGHT}', chr(10), 'g')"
        out = f"regexp_replace({out}, '{BETWEEN_WORDS}', ' ', 'g')"
        out = f"trim(regexp_replace({out}, '{BETWEEN_LINES}', chr(10), 'g'), ' ' || chr(10))"
        for said, meant in SPELLINGS:
            out = f"replace({out}, '{said}', '{meant}')"
        return f"regexp_replace({out}, '{VERSION}', '\\1v \\2', 'g')"

    texts = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    table = ", ".join("('{}', '{}', {}, {}, '{}')".format(*r) for r in DIGESTS)
    return f"""
WITH spelled AS (SELECT license, replace({form('t')}, chr(10), ' ') AS form FROM (VALUES {texts}) v(license, t)),
known AS (SELECT DISTINCT license, split_part(form, ' ', 1) AS word, len(string_split(form, ' ')) AS words,
          length(form) AS chars, sha256(form) AS digest FROM spelled WHERE form <> ''
          UNION SELECT license, split_part(start, ' ', 1), words, chars, digest
          FROM (VALUES {table}) v(license, start, words, chars, digest)),
docs AS (SELECT doc_id, form, string_split(form, chr(10)) AS ls
         FROM (SELECT doc_id, {form('text')} AS form FROM documents) WHERE form <> ''),
starts AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS unit, unnest(ls) AS line FROM docs),
runs AS (SELECT s.doc_id, s.unit, license, chars, digest, array_to_string(ls[s.unit:s.unit + words - 1], chr(10)) AS run
         FROM starts s JOIN known ON split_part(line, ' ', 1) = word JOIN docs d ON d.doc_id = s.doc_id),
hit AS (SELECT doc_id, unit, license FROM runs WHERE substr(run, chars + 1, 1) IN ('', chr(10))
        AND sha256(replace(left(run, chars), chr(10), ' ')) = digest
        UNION ALL SELECT doc_id, 0, license FROM docs JOIN known ON sha256(replace(form, chr(10), ' ')) = digest),
per AS (SELECT doc_id, string_agg(DISTINCT CASE WHEN unit = 0 THEN license END, ',' ORDER BY CASE WHEN unit = 0 THEN license END) AS whole,
        count(DISTINCT CASE WHEN unit > 0 THEN unit END) AS n_notices,
        string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM hit GROUP BY doc_id)
SELECT d.doc_id, whole, coalesce(n_notices, 0) AS n_notices, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN per USING (doc_id)
"""
