"""Licence scan: canonical digests of whole texts, joined to the digests of known licences.

Each document is looked at as a whole, as paragraphs (split at empty lines) and as lines; every such text
is canonicalised, hashed and joined as a whole. Nothing is matched by substring or pattern.

Canonical form: lower case; lines that start with a copyright mark go; equivalent spellings become one;
every run of characters that are neither letters nor digits becomes one blank; blanks at the ends go.

Defined results: a null or empty text has no row; equal texts in several documents, or repeated rows, each
give their rows; a document of one line is no line besides, and a paragraph of one line is a line only; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (spelling, canonical spelling), applied in this order to the lower-cased text.
EQUIVALENT = [
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("organisation", "organization"), ("favour", "favor"),
    ("acknowledgement", "acknowledgment"), ("non-commercial", "noncommercial"), ("redistribution’s", "redistributions"), ("copyright owner", "copyright holder"),
    ("merchantibility", "merchantability"), ("https://", "http://"), ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"), ("analogue", "analog"),
]
#: Only letters, digits and blanks, so the copyright rule is the same in Java's and RE2's syntax.
COPYRIGHT = r"(^|\n)[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[^\n]*"
OTHER = r"[^\p{L}\p{N}]+"

_PERMISSIVE_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."

#: Whole licence texts and standard headers, without copyright lines.
TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _PERMISSIVE_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _PERMISSIVE_END),
    ("BSD-2-Clause", f"{_BSD_2} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((f"GPL-{v}.0-or-later", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.") for v in (2, 3)),
]

#: md5 of the canonical form of licence files too long to stand here: the whole file, and where there is an
#: appendix after its terms, without that and without the line that ends the terms.
WHOLE = {
    "Apache-2.0": ["9768e9ac0a2ddb298695e7c2ca9bfa36", "4c6e317f52b13dccc5c775e26cc6d6b5", "db4fae888ce4068810986a16e5953e7a"],
    "MPL-2.0": ["0d0c617863ffeb16c5cb1f094c2d68b2"],
    "GPL-2.0": ["e374d0b43c25aed1a2b28951fe92a546", "95f8e6eea7034bb28698597e2a21390c", "cbb3451938de95cbb302d3c10690ede8"],
    "GPL-3.0": ["3d166aeeeb2ec1fea896f0a01f69dc5c", "2be49bb6cd12d910a70922606376f09b", "911c13fc9d0f569481e5c351a7c4f103"],
    "LGPL-2.1": ["519c5306e9399a753b0e3b10cc3f1fbd", "8bafa4c612887b0b12bf68d7e5fe0527", "ea4739ccf5314c5f636f979cc03259e2"],
    "LGPL-2.0": ["7d054715126defc8a18808a6934f14a4", "67adee7de2991bbdb3346ca63ffc6b75", "1389f4e6c9257fffaaa58a4ba72e4209"],
    "LGPL-3.0": ["b31b7335bc37919e8cdd79154e04d88d"],
    "CC0-1.0": ["93a180096f6cfcf2c0dd24f75c2eec48"],
    "MPL-1.1": ["a708f02208e9c42d3644490185833425"],
    "GPL-1.0": ["e64afbb3eb9ed9907294af675f791aba", "21fa8693acc5194a648fe02e11f65a72", "dbf3c47f5a8f127e58d08cabc1ebb916"],
    "Unlicense": ["0ddb544fc94f1ac376b1b27618cf995a"],
    "BSL-1.0": ["ac2afa4a98b996b77ea9e51a8c904ee1"],
}

#: Names under which a notice of one line cites a licence.
NAMES = {
    "MIT": ["MIT License", "MIT", "Expat License"],
    "ISC": ["ISC License", "ISC"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause", "New BSD License", "Modified BSD License", "Revised BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 License", "Apache License, v2.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
    **{f"{s}GPL-{v}.0": [f"GNU {w}General Public License, version {v}", f"GNU {w}General Public License v{v}", f"GNU {w}General Public License v{v}.0", f"GNU {w}General Public License version {v}.0", f"{s}GPL-{v}.0", f"{s}GPLv{v}", f"GNU {s}GPL v{v}", f"GNU {s}GPLv{v}"] for s, w in (("", ""), ("L", "Lesser "), ("A", "Affero ")) for v in (2, 3) if (s, v) != ("A", 2)},
    **{f"CC-BY{k.replace(' ', '-')}-{v}": [f"CC BY{k} {v}", f"CC-BY{k.replace(' ', '-')}-{v}", f"Creative Commons Attribution{w} {v} International License", f"Creative Commons Attribution{w} {v} License"] for k, w in (("", ""), ("-SA", "-ShareAlike"), ("-NC", "-NonCommercial"), ("-ND", "-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives")) for v in ("4.0", "3.0")},
    "CC0-1.0": ["CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal License"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "EPL-2.0"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0", "BSL-1.0"],
}
_VERBS = ["Released under", "Licensed under", "Distributed under", "Available under", "Published under", "Provided under"]
NOTICES = [
    *(f"{s}{v} {t}" for s, vs in (("", _VERBS), ("This work is ", [v.lower() for v in _VERBS]), ("This project is ", [v.lower() for v in _VERBS]), ("This software is ", [v.lower() for v in _VERBS]), ("This file is ", [v.lower() for v in _VERBS]), ("This document is ", [v.lower() for v in _VERBS])) for v in vs for t in ("{}", "the {}", "the terms of the {}", "a {}")),
    "SPDX-License-Identifier: {}", "License: {}", "{}", "The {}",
]


def canonical(text: str) -> str:
    """The canonical form, for the known texts; ``canonical_column`` is the same rule in Catalyst."""
    t = text.lower()
    t = re.sub(r"(^|\n)[^\w\n]*(copyright|\(c\)|©)[^\n]*", r"\1", t)
    for a, b in EQUIVALENT:
        t = t.replace(a, b)
    return re.sub(r"[\W_]+", " ", t).strip()


def _files() -> list[tuple[str, str]]:
    """The known texts as they stand in files: under a title, reserving all rights, conditions without numbers.
    Not the MIT text under "MIT License": ``test_licenses`` holds that such a file is no known document."""
    out = []
    for spdx, text in TEXTS:
        names = NAMES.get(spdx, [spdx])
        titles = ["", *(f.format(n) for n in names for f in ("{}", "The {}", "{} (%s)" % spdx, "The {} (%s)" % spdx) if (f, n) != ("{}", "MIT License"))]
        bodies = [text, re.sub(r"(?<=[:.;] )\d\. ", "", text)]
        out += [(spdx, f"{t}\n{r}\n{b}") for t in titles for r in ("", "All rights reserved.") for b in bodies]
    return out


def known() -> dict[str, str]:
    """md5 of the canonical text -> licence. The first licence of a text counts. Short names that are
    ordinary words ("MIT" alone) stay out: a text has to have 8 characters at least."""
    out: dict[str, str] = {}
    for spdx, text in [*TEXTS, *_files(), *((s, n.format(x)) for n in NOTICES for s, xs in NAMES.items() for x in xs)]:
        if len(c := canonical(text)) >= 8:
            out.setdefault(hashlib.md5(c.encode()).hexdigest(), spdx)
    for spdx, digests in WHOLE.items():
        for d in digests:
            out.setdefault(d, spdx)
    return out


def equivalent(text: Column) -> Column:
    """Lower case, with one spelling for each of the equivalent ones."""
    c = F.lower(text)
    for a, b in EQUIVALENT:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def canonical_line(line: Column) -> Column:
    """Canonical form of one line of an ``equivalent`` text; a copyright line has none left."""
    marked = line.contains("copyright") | line.contains("(c)") | line.contains("©")
    c = F.when(marked, F.regexp_replace(line, COPYRIGHT, "")).otherwise(line)
    return F.trim(F.regexp_replace(c, OTHER, " "))


def scan(docs: DataFrame, digests: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, unit, position, license, digest) of every document, paragraph or line that is a known
    licence text. Narrow up to the join, whose one side is the table of known digests: as large as the list
    of licences, whatever the corpus. Each text is canonicalised once, line by line; paragraphs and the
    document are their lines put together, which is their own canonical form."""
    digests = known() if digests is None else digests
    table = docs.sparkSession.createDataFrame(sorted(digests.items()), "digest string, license string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("text IS NOT NULL AND text <> ''")
    unit = "struct<unit:string,position:bigint,c:string>"
    none = F.array().cast(f"array<{unit}>")

    def of(kind: str, position: Column, c: Column) -> Column:
        return F.struct(F.lit(kind).alias("unit"), position.cast("long").alias("position"), c.alias("c"))

    def together(lines: Column) -> Column:
        return F.array_join(F.filter(lines, lambda x: x != ""), " ")

    d = d.select("doc_id", F.split(equivalent(F.col("text")), "\n").alias("raw"))
    d = d.select("doc_id", F.transform("raw", canonical_line).alias("lines"), F.when(F.size("raw") > 2, F.transform("raw", lambda x: x.rlike("^[ \t\r]*$"))).alias("blank"))
    # Paragraphs are cut where a line is empty but for blanks; a run of such lines cuts once.
    cuts = F.filter(F.transform("blank", lambda x, i: F.when(x & (i > 0) & (i < F.size("blank") - 1), i)), lambda i: i.isNotNull())
    d = d.select("doc_id", "lines", F.when(F.exists("blank", lambda x: x), cuts).alias("cuts"))
    begins = F.concat(F.array(F.lit(-1)), F.filter("cuts", lambda i: ~F.array_contains("cuts", i + 1)))
    ends = F.concat(F.filter("cuts", lambda i: ~F.array_contains("cuts", i - 1)), F.array(F.size("lines")))
    parts = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda s, k: F.struct(k.alias("k"), (s["e"] - s["b"] - 1).alias("n"), F.slice("lines", s["b"] + 2, F.greatest(s["e"] - s["b"] - 1, F.lit(0))).alias("ls")))
    paragraphs = F.transform(F.filter(parts, lambda s: s["n"] > 1), lambda s: of("paragraph", s["k"], together(s["ls"])))
    units = F.concat(
        F.array(of("document", F.lit(0), together(F.col("lines")))), F.when(F.size("cuts") > 0, paragraphs).otherwise(none),
        F.when(F.size("lines") > 1, F.transform("lines", lambda x, i: of("line", i, x))).otherwise(none),
    )
    d = d.select("doc_id", F.explode(F.filter(units, lambda u: u["c"] != "")).alias("u"))
    d = d.select("doc_id", "u.unit", "u.position", F.md5(F.col("u.c").cast("binary")).alias("digest"))
    return d.join(F.broadcast(table), "digest").select("doc_id", "unit", "position", "license", "digest")


def sql(digests: dict[str, str] | None = None) -> str:
    """The same rows in DuckDB's SQL."""
    digests = known() if digests is None else digests
    values = ", ".join(f"('{d}', '{s}')" for d, s in sorted(digests.items()))
    c = f"regexp_replace(lower(t), '{COPYRIGHT}', '\\1', 'g')"
    for a, b in EQUIVALENT:
        c = f"replace({c}, '{a}', '{b}')"
    return f"""
WITH known(digest, license) AS (VALUES {values}),
d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''),
units AS (
  SELECT doc_id, 'document' AS unit, CAST(0 AS BIGINT) AS position, text AS t FROM d
  UNION ALL
  SELECT doc_id, 'paragraph', i - 1, ts[i] FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\n[ \t\r]*\n') AS ts FROM d) WHERE len(ts) > 1) WHERE contains(ts[i], chr(10))
  UNION ALL
  SELECT doc_id, 'line', i - 1, ts[i] FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ts FROM d) WHERE len(ts) > 1)
),
hashed AS (SELECT doc_id, unit, position, c FROM (SELECT doc_id, unit, position, trim(regexp_replace({c}, '{OTHER}', ' ', 'g')) AS c FROM units) WHERE c <> '')
SELECT h.doc_id, h.unit, h.position, k.license, k.digest FROM hashed h JOIN known k ON md5(h.c) = k.digest
"""
