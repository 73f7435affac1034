"""Operator 7: licence scan by canonical digests, in DataFrame functions alone.

A text is brought to a canonical form (lower case, without copyright lines, equivalent spellings made one, punctuation and white
space to single blanks), so that wrapping, comment signs and case do not matter. Digests of canonical forms are hash-joined with
those of known licences: the digest of the whole text, that of each passage that starts with a licence's first words and is as
long as the licence, and those of lines against one-line notices. The table of known ones is fixed, so it is broadcast; digests
that no entry has are left out inside the row, and the texts are read once.

Null texts match nothing; so do texts that become empty; equal rows agree; texts of any length are taken whole; rows that share
a doc_id are told apart and each has its own licences; a text may hold several licences, named in order and once each; an empty
table gives an empty one; columns besides doc_id and text, of whatever name, are not read.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality_rules import let

COPYRIGHT = r"(^|\n)[^a-z0-9\n(]*(copyright[^\n]*([0-9]{4}|\(c\)|©|[\[<{(](year|yyyy))|\(c\)[ \t]*[0-9]{4}|©)[^\n]*"
RESERVED = r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*"
MARKS = r"[^a-z0-9\n\x{80}-\x{10ffff}]+"
# Spellings that count as the same.
SPELLINGS = [("licenc", "licens"), ("isation", "ization"), ("favour", "favor"), ("behaviour", "behavior"), ("non-infringement", "noninfringement"), ("https://", "http://"), ("©", "(c)")]

# Texts of licences, and notices of one line that stand for one.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
TEXTS = [
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC), ("0BSD", ZERO_BSD), ("0BSD", "BSD Zero Clause License\n\n" + ZERO_BSD),
    ("BSD-2-Clause", f"{BSD_START}\n\n{BSD_END}"), ("BSD-2-Clause", f"BSD 2-Clause License\n\n{BSD_START}\n\n{BSD_END}"), ("BSD-3-Clause", f"{BSD_START}\n\n{BSD_THIRD}\n\n{BSD_END}"), ("BSD-3-Clause", f"BSD 3-Clause License\n\n{BSD_START}\n\n{BSD_THIRD}\n\n{BSD_END}"),
    ("Zlib", ZLIB), ("Zlib", "zlib License\n\n" + ZLIB), ("Unlicense", UNLICENSE),
]
NOTICES = [
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License v3.0."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Released under CC0 1.0."), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


# Of long licences the first words, the length and the SHA-256 of the canonical body, and the SHA-256 of the
# canonical text with its preamble and appendix.
BODIES = [
("Apache-2.0", "terms and conditions for use reproduction and distribution 1 definitions", 8796, "7b0bb1d8dbcbea1c802d3a288b3fd4d1c82b219c4c4282bea036884ebf036aea", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("GPL-1.0", "0 this license agreement applies to any program or other work", 7155, "62f899ce3dcfbe979aa13b91d2cc3747693edb153465273224804803abf0d8e6", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "0 this license applies to any program or other work", 11730, "1a0524000c0190cf8019a4a5f65feced5a540034c263305187bca508946746a0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "terms and conditions 0 definitions this license refers to version 3", 27605, "04262fba2959e57aa1f32dd635b7cd2b84b6e83a6fa26338f8ef193b2d0d2b60", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "0 this license agreement applies to any software library", 17115, "f7344413883843e7d1573de4503a655db51fac962f28637faea5aab17cdb96cd", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "0 this license agreement applies to any software library", 17578, "4a9e77d344bd3c1d1c3896678e8fa85edcf80961b089b307ba0db8c826a6dcb7", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "this version of the gnu lesser general public license incorporates", 6930, "3c109b32fc12cedb18f514c338498353cbbafbc7ad3aa3aed8c864396943f25a", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "1 definitions 1 0 1 commercial use means", 20977, "4fbf4b1f3d8cf5d05e627fcb1b0dded60f72dbb2e5c2bc5bb929a8db71982f2d", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "1 definitions 1 1 contributor means each", 13626, "8f27174c93cb7f68399e5e71af858fdef9c2151b9de96b0dd9bab40a165711b3", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("CC0-1.0", "statement of purpose the laws of most jurisdictions", 6182, "4f8ab63ace774f37529081c81e2730a88143bf70e67392bd3c3701bd0a175152", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "0 preamble the purpose of this license is to make a manual", 18160, "da4c85448f47d22603d951c573ac545a667904a5f6eab0104964d422566c7ed2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "0 preamble the purpose of this license is to make a manual", 20632, "1fdd53f1ef0ad288d6e9388b799ce36ae0484d524c9a2d2408a6f2f8e6dc5cef", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("Artistic-1.0", "preamble the intent of this document is to state the conditions", 5812, "4eaaa9e33aeef0af0ff83ab5edac0ad421a1da9cc861c564630460107b4b772c", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
]
#: The first words, in canonical form, of the short licences above.
OPENINGS = [
    ("MIT", MIT, "permission is hereby granted free of charge to any person obtaining a copy"), ("ISC", ISC, "permission to use copy modify and or distribute this software"), ("0BSD", ZERO_BSD, "permission to use copy modify and or distribute this software"),
    ("BSD-2-Clause", f"{BSD_START}\n\n{BSD_END}", "redistribution and use in source and binary forms with or without modification"), ("BSD-3-Clause", f"{BSD_START}\n\n{BSD_THIRD}\n\n{BSD_END}", "redistribution and use in source and binary forms with or without modification"),
    ("Zlib", ZLIB, "this software is provided as is without any express or implied warranty in no event"), ("Unlicense", UNLICENSE, "this is free and unencumbered software released into the public domain"),
]
#: Every opening stands in a text that holds one of these, which is quickly seen.
HINTS = ("licens", "permi", "copyright")


def canonical_lines(text: Column) -> Column:
    """The canonical form of text's lines that have one."""
    x = reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), SPELLINGS[:-1], F.lower(text))
    x = F.regexp_replace(F.regexp_replace(x, COPYRIGHT, "$1"), RESERVED, "$1")
    x = F.regexp_replace(F.replace(x, F.lit(SPELLINGS[-1][0]), F.lit(SPELLINGS[-1][1])), MARKS, " ")
    return F.filter(F.transform(F.split(x, "\n", -1), lambda line: F.trim(line)), lambda line: line != "")


def whole(lines: Column) -> Column:
    return F.array_join(lines, " ")


def known(spark: SparkSession) -> DataFrame:
    """license, kind (text, body or notice), opening (of bodies), n (their length), digest: a few rows."""
    rows = [(x, "text", None, e) for x, e in TEXTS] + [(x, "body", o, e) for x, e, o in OPENINGS] + [(x, "notice", None, e) for x, e in NOTICES]
    given = spark.createDataFrame(rows, "license string, kind string, opening string, entry string").withColumn("entry", whole(canonical_lines(F.col("entry"))))
    short = given.select("license", "kind", "opening", F.length("entry").alias("n"), F.sha2("entry", 256).alias("digest"))
    fixed = [(x, "body", o, n, d) for x, o, n, d, _ in BODIES] + [(x, "text", None, None, d) for x, _, _, *both in BODIES for d in both]
    return short.unionByName(spark.createDataFrame(fixed, short.schema)).distinct()


def matches(lines: Column, entries: list) -> Column:
    """A struct of lines: digest (of the whole), and found: the digests of passages and lines that an entry has."""
    notices, lengths = ({r[c] for r in entries if r["kind"] == "notice"} for c in ("digest", "n"))
    openings: dict[str, list] = {}
    for r in entries:
        if r["kind"] == "body":
            openings.setdefault(r["opening"], []).append(r)
    none = F.array().cast("array<string>")

    def passages(x: Column) -> Column:
        """Digests of the passages of x that are a licence's body."""

        def at(opening: str, rows: list) -> Column:
            rest = F.slice(F.split(x, opening, -1), 2, 1 << 30)
            cuts = lambda tail: F.array(*(F.sha2(F.substring(F.concat(F.lit(opening), tail), 1, r["n"]), 256) for r in rows))
            return F.when(x.contains(opening), F.filter(F.flatten(F.transform(rest, cuts)), lambda d: d.isin([r["digest"] for r in rows]))).otherwise(none)

        hinted = reduce(operator.or_, (x.contains(h) for h in HINTS))
        return F.when(hinted, F.flatten(F.array(*(at(o, rows) for o, rows in openings.items())))).otherwise(none)

    def of(x: Column) -> Column:
        listed = F.filter(F.transform(F.filter(lines, lambda y: F.length(y).isin(lengths)), lambda y: F.sha2(y, 256)), lambda d: d.isin(notices))
        return F.struct(F.when(x != "", F.sha2(x, 256)).alias("digest"), F.concat(passages(x), listed).alias("found"))

    return let(whole(lines), of)


def scan(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Rows: doc_id, license (whose text the whole document is, or null), contains (licences whose text stands
    in it), notices (licences that a line names), both in order, joined by commas, or null, and n_notice_lines."""
    table = known(docs.sparkSession)
    entries = table.collect()  # fixed and small: some sixty rows
    found = let(canonical_lines(F.col("text")), lambda x: matches(x, entries))
    rows = docs.select("doc_id", found.alias("m")).select("doc_id", "m.*").withColumn("rid", F.monotonically_increasing_id())
    rows = common.materialize(rows, "licences")  # without texts, which are so read once
    texts = F.broadcast(table.where("kind = 'text'").groupBy("digest").agg(F.min("license").alias("license")))
    parts = F.broadcast(table.where("kind <> 'text'").select("digest", "kind", F.col("license").alias("name")))
    names = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name")))), ",")
    hits = rows.where(F.size("found") > 0).select("rid", F.explode("found").alias("digest")).join(parts, "digest")
    hits = hits.groupBy("rid").agg(names("body").alias("contains"), names("notice").alias("notices"), F.count_if(F.col("kind") == "notice").alias("n_notice_lines"))
    out = rows.join(texts, "digest", "left").join(hits, "rid", "left")
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return out.select("doc_id", "license", blank("contains"), blank("notices"), F.coalesce("n_notice_lines", F.lit(0)).alias("n_notice_lines"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir).select("doc_id", "text"))


def _sql_lines(text: str) -> str:
    x = reduce(lambda x, s: f"replace({x}, '{s[0]}', '{s[1]}')", SPELLINGS[:-1], f"lower({text})")
    x = rf"regexp_replace(regexp_replace({x}, '{COPYRIGHT}', '\1', 'g'), '{RESERVED}', '\1', 'g')"
    x = f"regexp_replace(replace({x}, '{SPELLINGS[-1][0]}', '{SPELLINGS[-1][1]}'), '{MARKS}', ' ', 'g')"
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda y: trim(y, ' ')), lambda y: y <> '')"


def _values(rows: list) -> str:
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


SQL = f"""
WITH given(license, kind, opening, entry) AS (VALUES {_values([(x, 'text', '', e) for x, e in TEXTS] + [(x, 'body', o, e) for x, e, o in OPENINGS] + [(x, 'notice', '', e) for x, e in NOTICES])}),
short AS (SELECT license, kind, opening, array_to_string({_sql_lines('entry')}, ' ') AS entry FROM given),
fixed(license, kind, opening, n, digest) AS (VALUES {_values([(x, 'body', o, n, d) for x, o, n, d, _ in BODIES] + [(x, 'text', '', 0, d) for x, _, _, *both in BODIES for d in both])}),
known AS (SELECT license, kind, opening, length(entry) AS n, sha256(entry) AS digest FROM short UNION SELECT * FROM fixed),
docs AS (SELECT doc_id, {_sql_lines('text')} AS lines FROM documents),
wholes AS (SELECT doc_id, array_to_string(lines, ' ') AS whole FROM docs WHERE len(lines) > 0),
texts AS (SELECT doc_id, min(license) AS license FROM wholes w JOIN known k ON sha256(w.whole) = k.digest AND k.kind = 'text' GROUP BY doc_id),
bodies AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS contains FROM wholes w JOIN known k ON k.kind = 'body' AND contains(w.whole, k.opening)
  WHERE list_contains(list_transform(string_split(w.whole, k.opening)[2:], lambda y: sha256(substr(k.opening || y, 1, k.n))), k.digest) GROUP BY doc_id),
notices AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n
  FROM (SELECT doc_id, sha256(line) AS digest FROM (SELECT doc_id, unnest(lines) AS line FROM docs)) d
  JOIN known k ON d.digest = k.digest AND k.kind = 'notice' GROUP BY doc_id)
SELECT d.doc_id, t.license, b.contains, n.notices, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notice_lines
FROM docs d LEFT JOIN texts t ON d.doc_id = t.doc_id LEFT JOIN bodies b ON d.doc_id = b.doc_id LEFT JOIN notices n ON d.doc_id = n.doc_id
"""
