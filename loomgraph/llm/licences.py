"""Operator 1 [native]: licence scan by canonical digests.

A text is made canonical: lower case; copyright lines leave (with a year, or short ones without), as does a notice that
runs into the terms or is wrapped before them, and a line that reserves all rights, if there is more; every run of other characters than letters and digits is one space; equivalent spellings become one (licence/license, authorise/authorize, favour/favor, labelling/labeling,
acknowledgement/acknowledgment, owner/holder, whilst/while, sub-license, non-commercial). Spelling rules work on word
ends of any word; both sides of the comparison pass through them. Entire texts are hash-joined by their SHA-256 to the
digests of known licences; that side is a fixed list and is broadcast. So that short notices inside a document are
found too, each line is digested as an entire text of its own and looked up in the same list.

Texts of any length are read whole, by some twenty passes of expressions. Null texts count as empty. An empty canonical text has no licence. Repeated rows are judged each; empty tables give no
rows; other columns are not read. Only SQL functions work on the rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and notices by SPDX id.
MIT_TERMS = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
ISC_TERMS = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ZLIB_TERMS = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""
NUMBERS = re.compile(r"(?m)^[0-9]\. ")  # some copies have bullets
KNOWN = (
    ("MIT", MIT_TERMS), ("MIT", "MIT License\n" + MIT_TERMS), ("MIT", "The MIT License (MIT)\n" + MIT_TERMS), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC_TERMS), ("ISC", "ISC License\n" + ISC_TERMS), ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", BSD_HEAD + BSD_END), ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_HEAD + BSD_END), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", NUMBERS.sub("* ", BSD_HEAD + BSD_END)), ("BSD-2-Clause", "BSD 2-Clause License\n" + NUMBERS.sub("* ", BSD_HEAD + BSD_END)), ("BSD-3-Clause", NUMBERS.sub("* ", BSD_HEAD + BSD_THIRD + BSD_END)), ("BSD-3-Clause", "BSD 3-Clause License\n" + NUMBERS.sub("* ", BSD_HEAD + BSD_THIRD + BSD_END)),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_HEAD + BSD_THIRD + BSD_END), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Zlib", ZLIB_TERMS), ("Zlib", "zlib License\n" + ZLIB_TERMS),
    ("Apache-2.0", APACHE_NOTICE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
)
# Digests of the canonical form of longer texts.
DIGESTS = (
    ("Apache-2.0", "b2eb4bb4eb8c24c863faf8a793591d133aa83c30827cb7a8e3ea5da99596624a"),
    ("GPL-1.0", "ebbc279de33932ad9a3a205e38d89804c806aaf63bbcf6e848812db90f1329f0"),
    ("GPL-2.0", "a01369c0d31c7a25fb260692b0ec795b4ce818346c69a5a3f35fd678e4694b50"),
    ("GPL-3.0", "2e8b2e9465815a2d4eb284964a350ac4e532adbf2bfe6dd2b6ca2b37a2e275fb"),
    ("LGPL-2.0", "b5e116396a7acd0088e3358f1570ae40e5531b030b8a35578901fc22d89cf094"),
    ("LGPL-2.1", "5dce766b4e29f335e7549b88187a3f569e1fa746581b37e75541bf59e1e3b258"),
    ("LGPL-3.0", "35e5d974a8212b3f9c8443711419341c089421e7e83036e3a03c620d52388172"),
    ("MPL-1.1", "8a2fadd8b0f8200dfb8f823e50bbd61857e6b4eda80652df9f45fc4b2855d2be"),
    ("MPL-1.1", "93948bc4b479cbcce7049afc430ca008fa114fbcd60d3621972b73f690e2257e"),
    ("MPL-2.0", "d3929ffce090e16529f985f979bcf99bd663dd66ac7683124314b7ccc7093a64"),
    ("CC0-1.0", "9a96d4de22d3909633285aaded7417e629b1f4701bb15e0d94c49dda91e5cac5"),
    ("GFDL-1.2", "3c1eb6634d615a130dfe1fd3e5701876240e8354ac73cb73ec40183c5d810683"),
    ("GFDL-1.3", "84d1a4cc8dce4d0a52346a25b674599664229d3b0d244b7a1720d9bd29fb9fcb"),
    ("Unlicense", "3ea79017bacc7f6cea976a19e7bacdea54beda4c271299d4ac63f3127e8df094"),
)
# Patterns (of both Java and RE2) and what takes their place, in this order.
NOTICE = r"(?:spdx-filecopyrighttext|copyright|©|\(c\))[^\n]{0,40}?(?:19|20)[0-9][0-9]"
OPENING = r"(permission is hereby granted, free of charge|permission to use, copy, modify|redistribution and use in source and binary forms|this software is provided 'as-is', without)"
# A notice right before the terms, on one line with them or wrapped over up to three; the terms' first words stay, and so does a line that reserves all rights.
HEAD = NOTICE + r"[^\n]{0,200}?(?:\n[^\n]{1,120}?){0,2}?(\n[ \t]*all rights reserved[^\n]{0,5})?[ \t\r\n]*" + OPENING
# Lines with a year.
DATED_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©|spdx-filecopyrighttext)[^\n]{0,200}(19|20)[0-9][0-9][^\n]{0,300}$"
MARKS = ("copyright", "(c)", "©")
# Lines without a year, of Java only: short ones that no prose goes on with; "(c)" alone also marks items of a list.
PROSE = r"(?:holders?|owners?|ownership|notices?|licen[cs]e[sd]?|laws?|and|or|in|is|of|to|on|as|for|under|that|which|may|shall|are|was|has|from|over|with|treaty|treaties|protections?|infringements?|interests?|act|statements?|claims?|information|permissions?|status|terms?|rights?|works?|materials?|disclaimers?)(?![\p{L}\p{N}])"
COPYRIGHT_LINE = (
    r"(?:^|\n)[^\p{L}\p{N}\n(©]*(?:"
    r"(?:copyright[ \t]*(?:\(c\)|©)|©|\(c\)[ \t]*copyright|spdx-filecopyrighttext)[^\n]{0,200}(?![^\n])"
    r"|copyright(?:[ \t]*:)?[ \t]+(?:by[ \t]+)?(?!" + PROSE + r")[^ \t\n][^\n]{0,100}(?![^\n])"
    r"|\(c\)[ \t]+[^\n]{0,80}[^;:,\n](?=\n[ \t\r]*(?:\n|$)|\s*$))"
)
RULES = (
    ("&", " and "),
    (r"[^\p{L}\p{N}\n]+", " "),
    (r"is(e|ed|es|er|ers|ing|ation|ations)( |\n|$)", r"iz$1$2"),
    (r"our(s|ed|ing|able|ite)?( |\n|$)", r"or$1$2"),
    (r"enc(e|ed|es|ing|er|ers)( |\n|$)", r"ens$1$2"),
    (r"ll(ed|ing)( |\n|$)", r"l$1$2"),
    (r"(dg)ement(s)?( |\n|$)", r"$1ment$2$3"),
    (r"( |\n|^)copyright owner", r"$1copyright holder"),
    (r"( |\n|^)sub licens", r"$1sublicens"),
    (r"( |\n|^)non commercial", r"$1noncommercial"),
    (r"( |\n|^)whilst( |\n|$)", r"$1while$2"),
    (r"( |\n|^)https( |\n|$)", r"$1http$2"),
)


def lines_of(text: Column) -> Column:
    """The text in canonical spelling, its line feeds kept."""
    text = F.lower(text)
    marked = reduce(lambda a, b: a | b, [text.contains(m) for m in MARKS])
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, HEAD, "\n$1\n$2"), "(?d)" + DATED_LINE, "\n"), COPYRIGHT_LINE, "\n")
    text = F.when(marked, bare).otherwise(text)
    for pattern, by in RULES:
        text = F.regexp_replace(text, pattern, by)
    return text


RESERVED = r"(^|\n) ?all rights reserved ?(\n|$)"


def canonical(lines: Column) -> Column:
    """One line of an entire text, without the line that reserves all rights if there is more."""
    short = F.trim(F.regexp_replace(F.regexp_replace(lines, RESERVED, "\n"), r"[ \n]+", " "))
    return F.when(short == "", F.trim(F.regexp_replace(lines, r"[ \n]+", " "))).otherwise(short)


def known(spark: SparkSession) -> DataFrame:
    """license, digest of the fixed list: a row for each text."""
    rows = spark.createDataFrame([*KNOWN], "license string, text string")
    return rows.select("license", F.sha2(canonical(lines_of(F.col("text"))), 256).alias("digest")).distinct()


def scan(docs: DataFrame, more=DIGESTS) -> DataFrame:
    """doc_id, n_chars, digest, license (of the entire text; null if unknown), notices (of single lines, sorted, joined by commas).

    more: (license, digest) of further entire texts.
    """
    # one row for each known text: a broadcast of a fixed size
    by_digest = {r.digest: r.license for r in known(docs.sparkSession).collect()}
    table = docs.sparkSession.createDataFrame([(i, d) for d, i in ({d: i for i, d in more} | by_digest).items()], "license string, digest string")
    lookup = F.create_map(*[F.lit(x) for pair in sorted(by_digest.items()) for x in pair])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.length("text").cast("long").alias("n_chars"), lines_of(F.col("text")).alias("lines"))
    found = F.transform(F.split("lines", "\n"), lambda x: F.try_element_at(lookup, F.sha2(F.trim(x), 256)))
    rows = rows.select("doc_id", "n_chars", F.sha2(canonical(F.col("lines")), 256).alias("digest"), F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), ",").alias("notices"))
    return rows.join(F.broadcast(table), "digest", "left").select("doc_id", "n_chars", "digest", "license", "notices")


def _sql(text: str) -> str:
    head = HEAD.replace("'", "''")
    out = f"regexp_replace(regexp_replace(lower({text}), '{head}', chr(10) || '\\1' || chr(10) || '\\2', 'g'), '{DATED_LINE}', chr(10), 'g')"
    for pattern, by in RULES:
        out = f"regexp_replace({out}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return out


def _canonical_sql(lines: str) -> str:
    short = rf"trim(regexp_replace(regexp_replace({lines}, '{RESERVED}', chr(10), 'g'), '[ \n]+', ' ', 'g'), ' ')"
    return rf"(CASE WHEN {short} = '' THEN trim(regexp_replace({lines}, '[ \n]+', ' ', 'g'), ' ') ELSE {short} END)"


_VALUES = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
ORACLE = f"""
WITH known AS (SELECT DISTINCT license, sha256({_canonical_sql(_sql('text'))}) AS digest FROM (VALUES {_VALUES}) AS v(license, text)),
rows AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS n_chars, {_sql("coalesce(text, '')")} AS lines FROM documents),
single AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT r, sha256(trim(unnest(string_split(lines, chr(10))), ' ')) AS digest FROM rows) JOIN known USING (digest) GROUP BY r)
SELECT doc_id::BIGINT AS doc_id, n_chars::BIGINT AS n_chars, digest, license, coalesce(notices, '') AS notices
FROM (SELECT *, sha256({_canonical_sql('lines')}) AS digest FROM rows) LEFT JOIN known USING (digest) LEFT JOIN single USING (r)
"""
