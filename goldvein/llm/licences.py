"""Licence scan by canonical digests (operator 6), in DataFrame functions alone.

A text is made canonical: lower case, lines that only state a copyright holder removed, equivalent spellings unified,
punctuation and white space collapsed. The SHA-256 of the entire canonical text, and of each of its lines (notices
stand on lines of their own), is hash-joined to the digests of known licences. Those come from ``KNOWN`` by the same
expressions, or from any table (licence, text) given instead; its size is known to Spark, which broadcasts it if small
and shuffles otherwise.

Result, one row for each different pair of doc_id and text: text_licence (the licence whose whole text the document is,
else null; the smallest name if several match), line_licences (distinct names found on lines, sorted, comma-joined, '' if none),
n_licence_lines (lines matched, repeats counted).

Nulls and ties: a null text has no canonical form and matches nothing, as does one without letters or digits. Rows
that repeat both doc_id and text give one row; null doc_ids are ids like any other. Very long texts are taken whole.
Empty table: no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only

MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_USE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

#: Public licence texts and notices, (licence, text).
KNOWN = [
    ("MIT", f"MIT License\n\nCopyright (c) 2024 A\n\n{MIT_GRANT}\n\n{MIT_NOTICE}\n\n{MIT_WARRANTY}"),
    ("MIT", f"{MIT_GRANT}\n\n{MIT_NOTICE}\n\n{MIT_WARRANTY}"),
    ("MIT", f"The MIT License (MIT)\n\n{MIT_GRANT}\n\n{MIT_NOTICE}\n\n{MIT_WARRANTY}"),
    ("BSD-2-Clause", f"{BSD_USE}\n\n{BSD_1}\n\n{BSD_2}\n\n{BSD_WARRANTY}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{BSD_USE}\n\n{BSD_1}\n\n{BSD_2}\n\n{BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{BSD_USE}\n\n{BSD_1}\n\n{BSD_2}\n\n{BSD_3}\n\n{BSD_WARRANTY}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{BSD_USE}\n\n{BSD_1}\n\n{BSD_2}\n\n{BSD_3}\n\n{BSD_WARRANTY}"),
    ("ISC", f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_WARRANTY}"),
    ("ISC", f"ISC License\n\n{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_WARRANTY}"),
    ("0BSD", f"{ISC_GRANT}.\n\n{ISC_WARRANTY}"),
    ("MIT", "Licensed under the MIT License."), ("MIT", "This work is licensed under the MIT License."), ("MIT", "Released under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Proprietary", "All rights reserved."), ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Whole texts kept as files, named after the licence.
KNOWN += [(p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]

#: Applied in turn to lower-case text; patterns that Java and RE2 read alike.
RULES = [
    (r"(?m)^[^a-z0-9\n]*(the )?copyright[ ]*(\(c\)|©|[0-9]{4}|\[|<)[^\n]*$", ""),
    (r"(?m)^[^a-z0-9\n]*(\(c\)|©)[ ]*[0-9][^\n]*$", ""),
    (r"licen[cs](e|es|ed|ing|or|ee)\b", "licens$1"),
    (r"sub-licens", "sublicens"),
    (r"non-(commercial|infringement)", "non$1"),
    (r"\b(organi|authori|recogni)s(e|ed|ation|ing)\b", "$1z$2"),
    (r"per cent", "percent"),
    (r"https://", "http://"),
    (r"&", " and "),
    (r"[^\p{L}\p{N}\n]+", " "),
    (r"version ([0-9])", "v $1"),
    (r" *\n[ \n]*", "\n"),
]
UNITS_TEXT, UNITS_LINE = 0, 1


def canonical(text: Column) -> Column:
    """The canonical text with its line ends kept, trimmed."""
    out = F.lower(text)
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, r"^[ \n]+|[ \n]+$", ""))


def whole(canon: Column) -> Column:
    return F.translate(canon, "\n", " ")


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, licence), one row per digest. Without a table given, those of KNOWN."""
    if known is None:
        quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
        known = spark.sql("select * from values " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in KNOWN) + " as t(licence, text)")
    digest = F.sha2(whole(canonical(F.col("text"))), 256).alias("digest")
    return known.filter("text is not null").select(digest, "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_licence, line_licences, n_licence_lines: one row for each different pair of doc_id and text."""
    table = known_digests(docs.sparkSession, known)
    canon = only(docs, "doc_id", "text").select("doc_id", F.md5("text").alias("text_key"), canonical(F.col("text")).alias("canon"))
    text = F.array(F.struct(F.lit(UNITS_TEXT).alias("kind"), F.sha2(whole(F.col("canon")), 256).alias("digest")))
    lines = F.transform(F.split("canon", "\n"), lambda x: F.struct(F.lit(UNITS_LINE).alias("kind"), F.sha2(F.trim(x), 256).alias("digest")))
    units = canon.select("doc_id", "text_key", F.explode(F.when(F.col("canon").isNull() | (F.col("canon") == ""), F.array(F.struct(F.lit(UNITS_TEXT).alias("kind"), F.lit(None).cast("string").alias("digest")))).otherwise(F.concat(text, lines))).alias("u"))
    found = units.select("doc_id", "text_key", "u.kind", "u.digest").join(table, "digest", "left").filter(f"kind = {UNITS_TEXT} or licence is not null")
    return found.groupBy("doc_id", "text_key").agg(
        F.min(F.when(F.col("kind") == UNITS_TEXT, F.col("licence"))).alias("text_licence"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == UNITS_LINE, F.col("licence")))), ",").alias("line_licences"),
        F.expr(f"cast(count_if(kind = {UNITS_LINE}) div count_if(kind = {UNITS_TEXT}) as bigint)").alias("n_licence_lines"),  # rows that repeat both have a text unit each
    ).drop("text_key")


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        x = f"lower({x})"
        for pattern, to in RULES:
            x = f"regexp_replace({x}, {q(pattern)}, {q(to.replace('$', chr(92)))}, 'g')"
        return f"trim(regexp_replace({x}, '^[ \\n]+|[ \\n]+$', '', 'g'))"

    rows = ", ".join(f"({q(a)}, {q(b)})" for a, b in KNOWN)
    flat = lambda x: f"replace({x}, chr(10), ' ')"
    return f"""
    with known as (select sha256({flat(canon('text'))}) as digest, min(licence) as licence from (values {rows}) t(licence, text) group by 1),
    canon as (select doc_id, md5(text) as text_key, {canon('text')} as c from (select distinct doc_id, text from documents)),
    units as (select doc_id, text_key, 0 as kind, case when c <> '' then sha256({flat('c')}) end as digest from canon
      union all select doc_id, text_key, 1, sha256(trim(x)) from (select doc_id, text_key, unnest(string_split(c, chr(10))) as x from canon where c <> '')),
    found as (select doc_id, text_key, kind, licence from units left join known using (digest) where kind = 0 or licence is not null)
    select doc_id, min(case when kind = 0 then licence end) as text_licence,
      coalesce(string_agg(distinct case when kind = 1 then licence end, ',' order by case when kind = 1 then licence end), '') as line_licences,
      cast(sum(kind) as bigint) as n_licence_lines
    from found group by doc_id, text_key"""
