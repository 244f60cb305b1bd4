"""Operator 2: licence scans by canonical digests. Only DataFrame functions.

A text is made canonical: lower case, copyright lines dropped, equivalent spellings unified, punctuation and white
space collapsed. Its SHA-256 is hash-joined to the digests of known licence texts and notices, once for the whole
text and once for each of its lines and paragraphs, so that a licence pasted into a longer document is found too.
A licence of several paragraphs is found as a span of whole lines: only texts whose canonical form contains a known
text are searched for spans. The whole text may start with a title line of its licence. The known digests
are a fixed list of under a hundred rows, so that side is broadcast. Texts are read once and never shuffled: what is
kept of them is the digests of parts that can match.

Null and odd input: a null or empty text has no licence. Rows are judged one by one: repeated rows, ties, null ids
and extra columns change nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

# Short public licence texts and notices, as published.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "BSD-3-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "BSL-1.0": [
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>""",
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ],
}

# Title lines of published licence files.
TITLES = {
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
}

# SHA-256 of the canonical form of whole licence texts, as published with their titles and appendices.
DIGESTS = {
    "Apache-2.0": ["ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"],
    "Artistic-1.0-Perl": ["08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"],
    "CC0-1.0": ["cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"],
    "GFDL-1.2": ["94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"],
    "GFDL-1.3": ["a45c6224f1e265fea687ecb695d2d2c336427984076c1decefd0e5bdbd334a1e"],
    "GPL-1.0": ["8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"],
    "GPL-2.0": ["efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"],
    "GPL-3.0": ["eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"],
    "LGPL-2.0": ["61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"],
    "LGPL-2.1": ["4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"],
    "LGPL-3.0": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"],
    "MPL-2.0": ["f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"],
}

# Spellings that count as one.
SPELLINGS = {"licence": "license", "licenced": "licensed", "sublicence": "sublicense", "non commercial": "noncommercial", "non infringement": "noninfringement", "acknowledgement": "acknowledgment", "copyright owner": "copyright holder", "organisation": "organization", "behaviour": "behavior", "favour": "favor", "fulfil": "fulfill", "https": "http", "share alike": "sharealike", "per cent": "percent"}

#: A line that says whose copyright it is, not what is allowed. {flags}: multi-line, any case.
COPYRIGHT = r"({flags})^[^\p{{L}}\p{{N}}\n]*(?:copyright\b|\(c\)|©)[^\n]*(?:[0-9]{{4}}|\(c\)|©|all rights reserved)[^\n]*$|^[^\p{{L}}\p{{N}}\n]*all rights reserved\.?[^\p{{L}}\p{{N}}\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, words of letters and digits with single spaces."""
    t = F.lower(F.regexp_replace(text, COPYRIGHT.format(flags="?imd"), " "))
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))  # each word has its own spaces
    for old, new in SPELLINGS.items():
        t = F.replace(t, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def known_digests(spark: SparkSession, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """(digest, licence, c: the canonical text, n_chars of it), one licence a digest."""
    rows = spark.createDataFrame([(k, t) for k, texts in notices.items() for t in texts], "licence string, text string")
    c = canonical(F.col("text"))
    return rows.select(F.sha2(c, 256).alias("digest"), "licence", c.alias("c"), F.length(c).alias("n_chars")).groupBy("digest", "c", "n_chars").agg(F.min("licence").alias("licence"))


def span_digests(text: Column, known: Column) -> Column:
    """Digests of the spans of two or more lines that are a known text, without those that are a whole paragraph.

    known: structs of (digest, c, first, last, n_words), of the known texts that the text may hold. Lines with no
    canonical words, as blank and copyright lines, count for nothing; a span starts and ends with other lines.
    """
    worded = lambda x: F.filter(F.split(x, r"\n"), lambda line: canonical(line) != "")
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")) & (F.size(worded(p)) > 1))

    def spans(k: Column, x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(x["canon"])), lambda i: F.split_part(F.element_at(x["canon"], i), F.lit(" "), F.lit(1)) == k["first"])
        # joined spellings make two words one, so that a span has twice the words at most, and each line has one
        sizes = lambda i: F.filter(F.sequence(F.lit(1), F.least(k["n_words"] * 2, F.size(x["canon"]) - i + 1)), lambda n: (n > 1) & (F.split_part(F.element_at(x["canon"], i + n - 1), F.lit(" "), F.lit(-1)) == k["last"]))
        held = F.flatten(F.transform(starts, lambda i: F.filter(sizes(i), lambda n: canonical(F.array_join(F.slice(x["lines"], i, n), "\n")) == k["c"])))
        return F.array_repeat(k["digest"], (F.size(held) - F.size(F.filter(x["copied"], lambda p: p == k["c"]))).cast("int"))

    one = F.array(F.struct(worded(text).alias("lines"), F.transform(worded(text), canonical).alias("canon"), F.transform(paragraphs, canonical).alias("copied")))
    found = F.flatten(F.transform(one, lambda x: F.flatten(F.transform(known, lambda k: spans(k, x)))))
    return F.when(F.size(known) > 0, found).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, notices: dict[str, list[str]] = NOTICES, digests: dict[str, list[str]] = DIGESTS) -> DataFrame:
    """(doc_id, whole_licence, licences, n_parts), a row per row of docs.

    whole_licence: of the entire text; licences: of its lines and paragraphs and itself, sorted, comma-joined, empty
    for none; n_parts: lines, paragraphs and other spans of lines that are known. Only digests of parts as long as a known text are looked
    up, which is a necessary condition and loses nothing. digests: of canonical whole texts, for licences whose texts
    are too long to keep here; they are found as entire texts only.
    """
    known = materialize(known_digests(docs.sparkSession, notices).coalesce(1))
    titled = known_digests(docs.sparkSession, {k: [f"{x}\n{t}" for x in TITLES.get(k, []) for t in ts] for k, ts in notices.items()})
    bodies = [(r.digest, r.c, r.c.split(" ")) for r in known.collect()]
    inner = lambda w: " ".join(w[1:-1])  # the ends may meet other words in the whole text
    texts = F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(c).alias("c"), F.lit(w[0]).alias("first"), F.lit(w[-1]).alias("last"), F.lit(len(w)).alias("n_words"), F.lit(inner(w)).alias("inner")) for d, c, w in bodies])
    lengths = F.array(*[F.lit(r.n_chars) for r in known.select("n_chars").distinct().collect()])  # as many as notices, at most
    t = F.col("t")
    paragraphs = F.filter(F.split(t, r"\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
    parts = F.filter(F.transform(F.concat(F.split(t, r"\n"), paragraphs), canonical), lambda c: F.array_contains(lengths, F.length(c)))
    digested = materialize(
        docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
        .select("doc_id", "t", canonical(t).alias("c"))
        .select("doc_id", "t", F.sha2("c", 256).alias("whole"), F.filter(texts, lambda k: F.contains(F.col("c"), k["inner"])).alias("may"))
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "whole", F.concat(F.transform(parts, lambda c: F.sha2(c, 256)), span_digests(t, F.col("may"))).alias("parts"))
    )
    lookup = F.broadcast(known.select("digest", "licence"))  # a fixed list of notices
    # a fixed list too: known texts, the same with a title, and the digests of long ones
    full = docs.sparkSession.createDataFrame([(k, d) for k, ds in digests.items() for d in ds] or [("", "")], "licence string, digest string")
    own = known.select("digest", "licence").union(titled.select("digest", "licence")).union(full.select("digest", "licence"))
    own = F.broadcast(own.groupBy(F.col("digest").alias("whole")).agg(F.min("licence").alias("whole_licence")))
    found = digested.select("row", F.explode("parts").alias("digest")).join(lookup, "digest").groupBy("row").agg(F.collect_set("licence").alias("some"), F.count("*").alias("n_parts"))
    every = F.array_sort(F.array_distinct(F.filter(F.concat(F.array("whole_licence"), F.coalesce("some", F.array().cast("array<string>"))), lambda x: x.isNotNull())))
    return digested.join(own, "whole", "left").join(found, "row", "left").select("doc_id", "whole_licence", F.array_join(every, ",").alias("licences"), F.coalesce("n_parts", F.lit(0)).cast("bigint").alias("n_parts"))


def op2_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op2_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def canon(x: str) -> str:
        t = f"lower(regexp_replace({x}, {quoted(COPYRIGHT.format(flags='?im'))}, ' ', 'g'))"
        t = f"' ' || trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' '"
        for old, new in SPELLINGS.items():
            t = f"replace({t}, ' {old.replace(' ', '  ')} ', ' {new} ')"
        return f"trim(replace({t}, '  ', ' '))"

    long = ", ".join(f"('{d}', {quoted(k)})" for k, ds in DIGESTS.items() for d in ds)
    notices = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, ts in NOTICES.items() for t in ts)
    return f"""
WITH k AS (SELECT c, min(licence) AS licence FROM (SELECT licence, {canon('t')} AS c FROM (VALUES {notices}) v(licence, t)) GROUP BY c),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, licence FROM (SELECT doc_id, {canon('t')} AS c FROM d) e JOIN (SELECT sha256(c) AS digest, licence FROM k UNION ALL VALUES {long}) f ON f.digest = sha256(e.c)),
p AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS part FROM d
      UNION ALL SELECT doc_id, part FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '\n[ \t\r]*\n')) AS part FROM d) WHERE contains(part, chr(10))),
h AS (SELECT doc_id, licence FROM (SELECT doc_id, {canon('part')} AS c FROM p) JOIN k USING (c))
SELECT d.doc_id, w.licence AS whole_licence, coalesce((SELECT string_agg(DISTINCT licence, ',' ORDER BY licence) FROM (SELECT doc_id, licence FROM h UNION SELECT doc_id, licence FROM w) u WHERE u.doc_id = d.doc_id), '') AS licences,
  (SELECT count(*) FROM h WHERE h.doc_id = d.doc_id)::BIGINT AS n_parts
FROM d LEFT JOIN w ON w.doc_id = d.doc_id"""


QUERIES = {"op2_licence_scan": op2_licence_scan}
SQL = {"op2_licence_scan": op2_sql()}
