"""Licence texts by canonical digest.

A text is brought to a canonical form: lower case, copyright lines gone, equivalent spellings made one, everything but
letters and digits a single space. Its SHA-256 is looked up, by a hash join, among the digests of known licence texts,
which are brought to that form by the same expressions. Both a whole document and each of its lines are texts that
are looked up; a match is always of an entire text, never of a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ramplake.llm.common import identity

# Public licence texts and notices, by SPDX identifier.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = (
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC),
    ("BSD-2-Clause", f"{BSD_HEAD}\n\n{BSD_TAIL}"), ("BSD-3-Clause", f"{BSD_HEAD}\n\n{BSD_THIRD}\n\n{BSD_TAIL}"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
)
# Spellings that count as the same.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("favour", "favor"), ("organisation", "organization"), ("©", "(c)"))
COPYRIGHT = r"^\W*(copyright|\(c\))\W*(\(c\)\W*)?([0-9]{4}|<|by\b|the\b|$).*$"


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; copyright lines become empty."""
    low = F.lower(line)
    for old, new in SPELLINGS:
        low = F.replace(low, F.lit(old), F.lit(new))
    plain = F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))
    holder = (F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)"))) & F.rlike(low, F.lit(COPYRIGHT))
    return F.when(holder, F.lit("")).otherwise(plain)


def canonical_lines(text: Column) -> Column:
    """Canonical forms of a text's lines that are left, in order."""
    return F.filter(F.transform(F.split(text, "\n"), canonical_line), lambda x: x != "")


def digest(lines: Column) -> Column:
    """Digest of a text; null if nothing is left of it."""
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def known_digests(spark: SparkSession, known: tuple = KNOWN) -> DataFrame:
    """Columns digest and license: a row for each known text."""
    rows = spark.createDataFrame([(name, text) for name, text in known], "license string, known string")
    return rows.select(digest(canonical_lines(F.col("known"))).alias("digest"), "license").filter("digest IS NOT NULL").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, *, known: tuple = KNOWN, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Columns doc_id, text_license, line_licenses and n_license_lines, a row for each row of `docs`.

    text_license: the licence whose text the whole document is, or null. line_licenses: sorted names of those that a line
    of it is, n_license_lines: such lines. Null and empty texts match nothing. Repeated rows (same id and text) get the
    same result, an empty table gives an empty one, other columns aren't read. Very long texts are one row each; only
    digests leave the scan.
    """
    lines = canonical_lines(F.col(text))
    whole = F.array(F.struct(F.lit(-1).alias("line"), digest(lines).alias("digest")))
    units = F.concat(whole, F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.sha2(x, 256).alias("digest"))))
    found = docs.select(identity(text, doc).alias("id"), F.explode(units).alias("unit")).select("id", "unit.line", "unit.digest")
    hits = found.join(F.broadcast(known_digests(docs.sparkSession, known)), "digest")  # as many rows as known texts
    # as a set: repeated rows hit once
    by_doc = hits.groupBy("id").agg(F.collect_set(F.struct("line", "license")).alias("hits"))
    on_lines = F.filter("hits", lambda h: h["line"] >= 0)
    by_doc = by_doc.select(
        "id", F.array_min(F.transform(F.filter("hits", lambda h: h["line"] < 0), lambda h: h["license"])).alias("text_license"),
        F.sort_array(F.array_distinct(F.transform(on_lines, lambda h: h["license"]))).alias("line_licenses"), F.size(on_lines).cast("long").alias("n_license_lines"))
    ids = docs.select(F.col(doc).cast("long").alias("doc_id"), identity(text, doc).alias("own"))
    joined = ids.join(by_doc, ids["own"].eqNullSafe(by_doc["id"]), "left")
    empty = F.array().cast("array<string>")
    return joined.select("doc_id", "text_license", F.coalesce("line_licenses", empty).alias("line_licenses"), F.coalesce("n_license_lines", F.lit(0).cast("long")).alias("n_license_lines"))


def oracle(known: tuple = KNOWN) -> str:
    """The same scan in SQL, with the known texts as rows."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    low = "lower({})"
    for old, new in SPELLINGS:
        low = f"replace({low}, {quoted(old)}, {quoted(new)})"
    # in this engine \\W takes ASCII letters only; the expressions here meet ASCII marks around the word
    def canonical(x: str) -> str:
        return f"CASE WHEN regexp_matches({low.format(x)}, {quoted(COPYRIGHT)}) THEN '' ELSE trim(regexp_replace({low.format(x)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) END"

    rows = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(known))
    return f"""
WITH known AS (SELECT * FROM (VALUES {rows}) AS t(k, license, body)),
known_lines AS (SELECT k, license, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM known),
digests AS (
  SELECT digest, min(license) AS license FROM (
    SELECT k, license, string_agg(c, ' ' ORDER BY i) AS digest FROM (SELECT k, license, i, {canonical("line")} AS c FROM known_lines) WHERE c <> '' GROUP BY k, license) GROUP BY digest),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
filled AS (SELECT doc_id, i, c FROM (SELECT doc_id, i, {canonical("line")} AS c FROM lines) WHERE c <> ''),
whole AS (SELECT doc_id, license FROM (SELECT doc_id, string_agg(c, ' ' ORDER BY i) AS digest FROM filled GROUP BY doc_id) JOIN digests USING (digest)),
by_line AS (SELECT doc_id, list_sort(list_distinct(list(license))) AS line_licenses, count(*) AS n FROM filled JOIN digests ON c = digest GROUP BY doc_id)
SELECT d.doc_id, w.license AS text_license, array_to_string(coalesce(line_licenses, []), ',') AS line_licenses, coalesce(n, 0)::BIGINT AS n_license_lines
FROM documents d LEFT JOIN whole w ON d.doc_id = w.doc_id LEFT JOIN by_line b ON d.doc_id = b.doc_id
"""
