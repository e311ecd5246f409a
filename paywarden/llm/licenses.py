"""Licence scan by canonical digest: normalise a whole text, hash it, hash-join it to known digests.

A unit of text is a whole document, one of its lines or, if asked for, one of its
paragraphs of several lines, so that a notice at the end of a document or in a file's
head is found by the same lookup as a document that is a licence file. Names and
spellings below are fixed values; whole texts lie in `license_texts`.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.llm.common import blank

# Spellings that licence matching treats as equal, from left to right.
SPELLINGS = (
    ("licence", "license"), ("licencing", "licensing"), ("sub-license", "sublicense"), ("sub license", "sublicense"),
    ("organisation", "organization"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("favour", "favor"), ("fulfil ", "fulfill "), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labour", "labor"), ("merchantibility", "merchantability"), ("non-commercial", "noncommercial"),
    ("per cent", "percent"), ("programme", "program"), ("recognised", "recognized"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"), ("https://", "http://"),
    ("all rights reserved", ""),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TERMS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""

# Public licence texts and notices, without their copyright lines.
KNOWN = (
    ("MIT", _MIT), ("MIT", f"MIT License {_MIT}"), ("MIT", f"The MIT License {_MIT}"), ("MIT", f"The MIT License (MIT) {_MIT}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_TERMS}"),
    ("ISC", f"ISC License {_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_TERMS}"),
    ("0BSD", f"{_ISC_GRANT}. {_ISC_TERMS}"),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_END}"), ("BSD-2-Clause", f"BSD 2-Clause License {_BSD_START} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_NAME} {_BSD_END}"), ("BSD-3-Clause", f"BSD 3-Clause License {_BSD_START} {_BSD_NAME} {_BSD_END}"),
    ("Zlib", _ZLIB), ("Zlib", f"zlib License {_ZLIB}"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)

_FREE = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
_LIBRARY = _FREE.replace("program", "library")
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."

# Heads of source files, each a paragraph.
HEADS = (
    ("Apache-2.0", f"{_APACHE} You may obtain a copy of the License at"), ("Apache-2.0", _APACHE),
    *[("GPL-2.0", _FREE.format(c, "General Public License", d, 2)) for c in ";:" for d in ";,"],
    *[("GPL-3.0", _FREE.format(c, "General Public License", d, 3)) for c in ";:" for d in ";,"],
    *[("AGPL-3.0", _FREE.format(c, "Affero General Public License", d, 3)) for c in ";:" for d in ";,"],
    ("LGPL-2.0", _LIBRARY.format(";", "Library General Public License", ";", 2)),
    *[(f"LGPL-{n}", t.format(";", "Lesser General Public License", ";", m)) for t in (_FREE, _LIBRARY) for n, m in (("2.1", "2.1"), ("3.0", "3"))],
    ("MPL-2.0", _MPL), ("MPL-2.0", _MPL.split(" If ")[0]),
)


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of the shipped full texts, each with and without what follows its terms, as wrapped and with a line per paragraph.

    Copyright lines go before texts are compared, and how a text is wrapped decides
    which lines begin with that word.
    """
    out = []
    for f in sorted(files("paywarden.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name):
        if not f.name.endswith(".txt"):
            continue
        text = f.read_text("utf-8").replace("\f", "\n")
        end = re.search(r"END OF TERMS AND CONDITIONS", text)
        for t in [text, *([text[: end.start()], text[: end.end()]] if end else [])]:
            flat = "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", t))
            out += [(f.name.removesuffix(".txt"), v) for v in (t, flat)]
    return out


# Expressions that both engines read alike.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
NOT_WORD = "[^a-z0-9\\n\\x{80}-\\x{10FFFF}]+"


def canonical_lines(text: Column) -> Column:
    """Lower case, equal spellings, no copyright lines; runs of punctuation become one blank, lines stay."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.regexp_replace(t, NOT_WORD, " ")


def canonical_text(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \\n]+", " "))


def known_digests(spark, known=KNOWN) -> DataFrame:
    """(digest, license) of the known texts: pairs, or a frame (license, text) such as a data set read by its path."""
    texts = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license string, text string")
    digest = F.sha2(canonical_text(canonical_lines(F.col("text"))), 256)
    return texts.select(digest.alias("digest"), "license").distinct()


def paragraphs_of(lines: Column) -> Column:
    """The paragraphs of two and more lines; blank lines part them, also those left of comment signs and copyright lines."""
    parts = F.split(F.regexp_replace(lines, "(?m)^ +| +$", ""), "\n\n+")
    return F.transform(F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^\n|\n$", "")), lambda p: F.contains(p, F.lit("\n"))), canonical_text)


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", known=KNOWN, paragraphs: bool = False) -> DataFrame:
    """Per id: the licence the whole text is, the licences of its lines, and how many lines are notices.

    With `paragraphs` those of several lines are looked up too and count like a line.

    Null and empty texts match nothing; rows that share an id are one document.
    Returns doc_id, text_license, notice_licenses (sorted names joined by commas,
    null if none), n_notices.
    """
    spark = docs.sparkSession
    lines = docs.select(F.col(id_column).alias("doc_id"), canonical_lines(blank(text_column)).alias("t"))
    units = lines.select(
        "doc_id",
        F.posexplode(F.concat(F.array(canonical_text(F.col("t"))), F.split("t", "\n"), *([paragraphs_of(F.col("t"))] if paragraphs else []))).alias("unit", "u"),
    ).select("doc_id", "unit", F.sha2(F.trim("u"), 256).alias("digest"))
    digests = known_digests(spark, known)
    found = (
        units.join(digests if isinstance(known, DataFrame) else F.broadcast(digests), "digest")
        .groupBy("doc_id")
        .agg(
            F.min(F.when(F.col("unit") == 0, F.col("license"))).alias("text_license"),
            F.array_join(F.sort_array(F.collect_set(F.when(F.col("unit") > 0, F.col("license")))), ",").alias("names"),
            F.count(F.when(F.col("unit") > 0, 1)).alias("n_notices"),
        )
    )
    ids = docs.select(F.col(id_column).alias("doc_id")).distinct()
    return ids.join(found, ids["doc_id"].eqNullSafe(found["doc_id"]), "left").select(
        ids["doc_id"], "text_license", F.expr("nullif(names, '')").alias("notice_licenses"),
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
    )


def oracle(known=KNOWN) -> str:
    def lines(c: str) -> str:
        t = f"regexp_replace(lower({c}), '{COPYRIGHT_LINE}', chr(10), 'g')"
        for old, new in SPELLINGS:
            t = f"replace({t}, '{old}', '{new}')"
        return f"regexp_replace({t}, '{NOT_WORD}', ' ', 'g')"

    whole = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'))".format
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in known)
    return f"""
WITH k AS (SELECT DISTINCT n AS license, {whole(lines('t'))} AS u FROM (VALUES {values}) v(n, t)),
d AS (SELECT doc_id, {lines("coalesce(text, '')")} AS t FROM documents),
u AS (SELECT doc_id, 0 AS unit, {whole('t')} AS u FROM d
      UNION ALL SELECT doc_id, 1 AS unit, trim(unnest(string_split(t, chr(10)))) AS u FROM d),
f AS (SELECT doc_id, min(license) FILTER (unit = 0) AS text_license,
             string_agg(DISTINCT license, ',' ORDER BY license) FILTER (unit = 1) AS notice_licenses,
             count(*) FILTER (unit = 1) AS n_notices
      FROM u JOIN k USING (u) GROUP BY doc_id)
SELECT doc_id, text_license, notice_licenses, coalesce(n_notices, 0) AS n_notices
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN f USING (doc_id)
"""
