"""License scans by canonical digests, with DataFrame operations only.

A text is put into a canonical form: lower case, without copyright lines, with one
spelling of equivalent words, and words parted by single spaces. Its digest is joined
with the digests of known license texts; each line's digest with those of notices.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Words that license texts spell in two ways, and the spelling kept.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "organisation": "organization",
    "organisations": "organizations",
    "authorised": "authorized",
    "authorisation": "authorization",
    "recognised": "recognized",
    "utilisation": "utilization",
    "favour": "favor",
    "behaviour": "behavior",
    "honour": "honor",
    "acknowledgement": "acknowledgment",
    "acknowledgements": "acknowledgments",
    "judgement": "judgment",
    "fulfil": "fulfill",
    "programme": "program",
    "wilful": "willful",
    "owner": "holder",
    "owners": "holders",
    "https": "http",
}

# License names as notices give them, by SPDX identifier.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause", "New BSD License"),
    "ISC": ("ISC License", "ISC"),
    "Zlib": ("zlib License", "Zlib"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
}
PHRASES = ("licensed under {}", "released under {}", "distributed under {}", "available under {}", "made available under {}", "published under {}", "license: {}", "SPDX-License-Identifier: {}")
SUBJECTS = ("", "this work is ", "this file is ", "this code is ", "this software is ", "this project is ")

# Whole license texts.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_USE = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_NOTICE = """, provided that the above copyright notice and this permission notice appear in all copies"""
_ISC_END = """. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
may not be removed or altered from any source distribution."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""
TEXTS = {
    "MIT": (_MIT, "MIT License\n" + _MIT, "The MIT License (MIT)\n" + _MIT),
    "ISC": (_ISC_USE + _ISC_NOTICE + _ISC_END, "ISC License\n" + _ISC_USE + _ISC_NOTICE + _ISC_END),
    "0BSD": (_ISC_USE + _ISC_END, "BSD Zero Clause License\n" + _ISC_USE + _ISC_END),
    "BSD-2-Clause": (_BSD_START + _BSD_END, "BSD 2-Clause License\n" + _BSD_START + _BSD_END),
    "BSD-3-Clause": (_BSD_START + _BSD_THIRD + _BSD_END, "BSD 3-Clause License\n" + _BSD_START + _BSD_THIRD + _BSD_END),
    "Zlib": (_ZLIB, "zlib License\n" + _ZLIB),
    "Apache-2.0": (_APACHE_HEADER,),
}

COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(?:copyright\s|\(c\)\s|©)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: str) -> str:
    """The canonical form, for the few known texts; ``canonical_words`` is its equal for columns."""
    kept = re.sub(COPYRIGHT_LINE, r"\1", text.lower())
    return " ".join(SPELLINGS.get(w, w) for w in re.sub(r"[\W_]+", " ", kept).split())


def canonical_words(text: Column, copyright_lines: bool = True) -> Column:
    """The words of a text's canonical form before spellings are made one."""
    lower = F.lower(text)
    kept = F.regexp_replace(lower, COPYRIGHT_LINE, "$1") if copyright_lines else lower
    return F.trim(F.regexp_replace(kept, NOT_WORD, " "))


def one_spelling(words: Column) -> Column:
    """Words parted by spaces, each in the spelling that is kept."""

    def kept(word: Column) -> Column:
        out = None
        for old, new in SPELLINGS.items():
            out = F.when(word == old, F.lit(new)) if out is None else out.when(word == old, F.lit(new))
        return out.otherwise(word)

    return F.array_join(F.transform(F.split(words, " "), kept), " ")


def known_texts() -> list[tuple[str, str, str, int]]:
    """(digest, scope, license, words) of the known texts and of notices by rule: name, phrase and subject."""
    found: dict[tuple[str, str], tuple[str, int]] = {}
    for license_, texts in TEXTS.items():
        for text in texts:
            form = canonical(text)
            found.setdefault((hashlib.sha256(form.encode()).hexdigest(), "text"), (license_, form.count(" ") + 1))
    for license_, names in NAMES.items():
        for name in names:
            for phrase in PHRASES:
                for article in ("", "the "):
                    for subject in SUBJECTS:
                        form = canonical(subject + phrase.format(article + name))
                        found.setdefault((hashlib.sha256(form.encode()).hexdigest(), "line"), (license_, form.count(" ") + 1))
    return [(digest, scope, *rest) for (digest, scope), rest in found.items()]


def scan_licenses(df: DataFrame, text: str = "text", row_id: str = "doc_id", known: list[tuple[str, str, str, int]] | None = None) -> DataFrame:
    """Whole texts and lines of ``df`` that are a known license text or notice.

    Returns a row for each match: doc_id, scope ("text" or "line"), line (number from
    0; null for whole texts), license and digest (SHA-256 of the canonical form). A
    whole text must be the license in all its words, but for copyright lines; a line
    must be the notice. Every text is read to its end. A text's words are counted
    first, and only those with as many as some known text are spelled anew.

    Null and empty texts match nothing. Repeated rows and lines match each; an empty
    table gives an empty result. Other columns are not read.
    """
    spark: SparkSession = df.sparkSession
    known = known_texts() if known is None else known
    # As many rows as the list of known texts.
    digests = F.broadcast(spark.createDataFrame(known, "digest string, k_scope string, license string, k_words int"))
    rows = df.select(F.col(row_id).alias("doc_id"), F.col(text).alias("t"))
    counts = {scope: sorted({k[3] for k in known if k[1] == scope}) for scope in ("text", "line")}
    size = F.size(F.split("words", " "))
    whole = rows.select("doc_id", F.lit(None).cast("long").alias("line"), F.lit("text").alias("scope"), canonical_words(F.col("t")).alias("words"))
    whole = whole.where((F.col("words") != "") & size.isin(counts["text"]))
    lines = rows.select("doc_id", F.posexplode(F.split("t", "\n")).alias("line", "t"))
    lines = lines.select("doc_id", F.col("line").cast("long").alias("line"), F.lit("line").alias("scope"), canonical_words(F.col("t"), False).alias("words"))
    lines = lines.where((F.col("words") != "") & size.isin(counts["line"]))
    units = whole.unionByName(lines).withColumn("digest", F.sha2(one_spelling(F.col("words")), 256))
    return units.join(digests, ["digest"]).where(F.col("scope") == F.col("k_scope")).select("doc_id", "scope", "line", "license", "digest")
