"""License scan by canonical digests, in DataFrame functions alone.

A text becomes canonical line by line: lower case, copyright lines dropped,
anything but letters and digits made a space, equivalent spellings made one,
runs of spaces made one. The canonical lines, joined by a space and without
lines that only reserve all rights, are digested, and the digest is hash-joined
to the digests of known licences: short texts are given in `TEXTS`, whole
licences of many pages by their digests in `DIGESTS`, and `known_files` makes
more rows from files. What stands within other texts is found by the same join
on three kinds of units: single lines, two lines that follow one another, and
blocks between blank lines. Units of a length that no known text has can't match
and are dropped before they are digested. Known licences are a table of constant
size, so that it is broadcast.

Defined results: a null or empty text has the digest of the empty text and no
licence; repeated rows have a result each; where one digest is that of two licences the
first name counts; an empty table gives an empty result; other columns are not
read. A long text takes a small multiple of its size in memory, for its lines, their
pairs and its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import table

# Texts of public licences and of usual notices.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_UNLICENSE = "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <https://unlicense.org>"
TEXTS = (
    *(("MIT", f"{title}{_MIT_GRANT}\n{_MIT_KEEP}\n{_MIT_AS_IS}") for title in ("MIT License\n", "The MIT License\n", "The MIT License (MIT)\n")),
    ("MIT", f"{_MIT_GRANT}\n{_MIT_KEEP}\n{_MIT_AS_IS}"),
    *(("ISC", f"{title}{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_AS_IS}") for title in ("ISC License\n", "The ISC License\n")),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_AS_IS}"),
    *(("0BSD", f"{title}{_ISC_GRANT}.\n{_ISC_AS_IS}") for title in ("", "BSD Zero Clause License\n", "Zero-Clause BSD\n")),
    *(("BSD-2-Clause", f"{title}{_BSD_GRANT}\n{_BSD_1}\n{_BSD_2}\n{_BSD_AS_IS}") for title in ("", "BSD 2-Clause License\n", "The 2-Clause BSD License\n")),
    *(("BSD-3-Clause", f"{title}{_BSD_GRANT}\n{_BSD_1}\n{_BSD_2}\n{_BSD_3}\n{_BSD_AS_IS}") for title in ("", "BSD 3-Clause License\n", "The 3-Clause BSD License\n")),
    ("Unlicense", _UNLICENSE),
    ("MIT", _MIT_GRANT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    *((f"{short}-{v}.0", f"This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {full}General Public License as published by the Free Software Foundation{where} version {v} of the License, or (at your option) any later version.") for short, full in (("GPL", ""), ("AGPL", "Affero ")) for v in (2, 3) for mark in (":", ";") for where in (", either", "; either")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("all-rights-reserved", "All rights reserved."),
)
#: SHA-256 of the canonical texts of longer licences: whole, and without what follows their terms.
DIGESTS = (
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Apache-2.0", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f"),
    ("Apache-2.0", "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "e259b3e0bf831ddcd5351d255b832a3eccf42a266790e35dd570e35b737e30f2"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),
    ("GPL-1.0", "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0", "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-2.0", "c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "9672a697b80e59f5b1b0201e64d65dee8762b193cdd934dc5bcf2b57350a2ead"),
)
#: Spellings that count as one, in canonical form, whole words each.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("organisations", "organizations"), ("recognise", "recognize"),
    ("v2", "version 2"), ("v3", "version 3"), ("v", "version"), ("ver", "version"), ("https", "http"), ("noncommercial", "non commercial"),
)
#: Spellings of two words, which may stand on two lines.
PAIRS = (("sub license", "sublicense"), ("sub licenses", "sublicenses"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"))
#: A line that names an owner or a year.
COPYRIGHT = r"^\W*(copyright|\(c\)|©)\W.*(\(c\)|©|[0-9]{4}|rights reserved).*$"
#: A line that names an owner alone, where it isn't all in capitals: words with a capital, but for a few between them ...
OWNER = r"^\W*Copyright\W+(by\s+)?[A-Z]\S*(\s+(and|of|the|de|van|von|&|[A-Z0-9(<\"\x27]\S*))*\s*$"
#: ... unless it goes on as the licences' own sentences do, in any case.
SENTENCE = r"^\W*copyright\W+(holders?|owners?|notices?|laws?|licen[sc]es?|statements?|and|or|in|is|of|to|for)\b"
RESERVED = "all rights reserved"


def canonical_line(line: Column) -> Column:
    """A line in canonical form; '' for a copyright line."""
    low = F.lower(line)
    out = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]+", "  "), F.lit(" "))
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(f" {one} "), F.lit(f" {other.replace(' ', '  ')} "))
    out = F.trim(F.regexp_replace(out, " +", " "))
    dated = low.rlike(COPYRIGHT) | (line.rlike(OWNER) & ~low.rlike(SENTENCE))
    return F.when((F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©"))) & dated, F.lit("")).otherwise(out)


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form; blank and copyright lines are ''."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line)


def joined(text: Column) -> Column:
    """Canonical lines that were joined by a space, with the spellings of two words made one."""
    out = F.concat(F.lit(" "), text, F.lit(" "))
    for one, other in PAIRS:
        out = F.replace(out, F.lit(f" {one} "), F.lit(f" {other} "))
    return F.trim(out)


def canonical_text(lines: Column) -> Column:
    return joined(F.array_join(F.filter(lines, lambda x: (x != "") & (x != RESERVED)), " "))


def units(lines: Column) -> Column:
    """The lines, each two that follow one another, and the blocks of three lines or more between blank lines."""
    n = F.array_size(lines) - 1
    alone = F.transform(F.filter(lines, lambda x: x != ""), joined)
    two = F.zip_with(F.slice(lines, 1, n), F.slice(lines, 2, n), lambda a, b: F.when((a != "") & (b != ""), joined(F.concat(a, F.lit(" "), b))))
    blocks = F.filter(F.split(F.array_join(lines, "\n"), "\n\n+"), lambda x: x.rlike("[^\n]\n+[^\n]+\n+[^\n]"))
    return F.concat(alone, F.array_compact(two), F.transform(blocks, lambda x: joined(F.trim(F.translate(x, "\n", " ")))))


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] = TEXTS, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """digest, license, length (of the canonical text; null where only its digest is known): one row for each digest."""
    rows = F.array(*(F.struct(F.lit(a).alias("license"), F.lit(b).alias("text")) for a, b in texts))
    found = spark.range(1).select(F.inline(rows)).select("license", F.when(F.col("text").contains("reserved") & (F.length("text") < 30), F.lit(RESERVED)).otherwise(canonical_text(canonical_lines(F.col("text")))).alias("text"))
    found = found.select("license", F.sha2("text", 256).alias("digest"), F.length("text").alias("length"))
    if digests:
        more = F.array(*(F.struct(F.lit(a).alias("license"), F.lit(b).alias("digest")) for a, b in digests))
        found = found.unionByName(spark.range(1).select(F.inline(more)).withColumn("length", F.lit(None).cast("int")))
    return found.groupBy("digest").agg(F.min("license").alias("license"), F.min("length").alias("length"))


def known_files(spark: SparkSession, path: str) -> DataFrame:
    """license (the file's name without .txt) and digest of each text file: what `known` takes as digests."""
    files = spark.read.text(path, wholetext=True).select("value", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), "\\.txt$", "").alias("license"))
    return files.select("license", F.sha2(canonical_text(canonical_lines(F.col("value"))), 256).alias("digest"))


def scan(docs: DataFrame, texts: tuple[tuple[str, str], ...] = TEXTS, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """doc_id, canonical_sha256, license (of the entire text), notices (of its units, sorted), n_notices."""
    licences = known(docs.sparkSession, texts, digests)
    lengths = sorted(r["length"] for r in licences.select("length").distinct().collect() if r["length"])  # of constant size
    lines = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), canonical_lines(F.col("text")).alias("lines"))
    some = F.filter(units(F.col("lines")), lambda x: F.length(x).isin(lengths))
    rows = lines.select("doc_id", "row", F.sha2(canonical_text(F.col("lines")), 256).alias("entire"), F.explode_outer(some).alias("unit"))
    # The rows of a document stand together, so that all but a few of its units are combined before the shuffle.
    found = rows.withColumn("digest", F.sha2("unit", 256)).join(F.broadcast(licences.select("digest", F.col("license").alias("notice"))), "digest", "left")
    per_text = found.groupBy("doc_id", "row", "entire").agg(F.collect_set("notice").alias("notices"), F.count("notice").alias("n_notices"))
    return per_text.join(F.broadcast(licences.select(F.col("digest").alias("entire"), "license")), "entire", "left").select(
        "doc_id", F.col("entire").alias("canonical_sha256"), "license", F.array_join(F.sort_array("notices"), ",").alias("notices"), "n_notices"
    )


def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in TEXTS)
    digests = "".join(f" UNION ALL SELECT {quoted(a)}, {quoted(b)}" for a, b in DIGESTS)
    spelling = ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in SPELLINGS)
    pair = "".join(f" WHEN {quoted(a)} THEN {quoted(b)}" for a, b in PAIRS)
    # Words are looked up one by one; a pair of words is made one where its second word stands.
    return f"""
WITH spelling AS (SELECT MAP {{{spelling}}} AS one),
texts(license, text) AS (VALUES {values}),
sources AS (SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 't', row_number() OVER (), text FROM texts),
cut AS (SELECT kind, id, string_split(text, chr(10)) AS raw FROM sources),
canon AS (
  SELECT kind, id, list_transform(raw, lambda x: CASE
    WHEN regexp_matches(lower(x), '{COPYRIGHT}') OR (regexp_matches(x, '{OWNER}') AND NOT regexp_matches(lower(x), '{SENTENCE}')) THEN ''
    ELSE array_to_string(list_transform(list_filter(string_split_regex(lower(x), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: coalesce(one[w], w)), ' ') END) AS lines
  FROM cut, spelling),
pieces AS (
  SELECT kind, id, 'whole' AS what, array_to_string(list_filter(lines, lambda x: x NOT IN ('', '{RESERVED}')), ' ') AS text FROM canon
  UNION ALL SELECT kind, id, 'unit', unnest(list_filter(lines, lambda x: x <> '')) FROM canon WHERE kind = 'd'
  UNION ALL SELECT kind, id, 'unit', unnest(list_filter(list_transform(range(1, len(lines)), lambda i: CASE WHEN lines[i] <> '' AND lines[i + 1] <> '' THEN lines[i] || ' ' || lines[i + 1] END), lambda x: x IS NOT NULL)) FROM canon WHERE kind = 'd'
  UNION ALL SELECT kind, id, 'unit', replace(b, chr(10), ' ') FROM (
    SELECT kind, id, trim(unnest(string_split_regex(array_to_string(lines, chr(10)), '\n\n+')), chr(10)) AS b FROM canon WHERE kind = 'd') WHERE len(string_split(b, chr(10))) >= 3),
paired AS (
  SELECT kind, id, what, array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE w[i] || ' ' || coalesce(w[i + 1], ''){pair} ELSE
    CASE WHEN i > 1 AND (CASE w[i - 1] || ' ' || w[i]{pair} END) IS NOT NULL THEN NULL ELSE w[i] END END), lambda x: x IS NOT NULL), ' ') AS text
  FROM (SELECT kind, id, what, string_split(text, ' ') AS w FROM pieces)),
known AS (
  SELECT digest, min(license) AS license FROM (
    SELECT license, sha256(CASE WHEN t.text = 'All rights reserved.' THEN '{RESERVED}' ELSE p.text END) AS digest FROM paired p JOIN (SELECT row_number() OVER () AS id, * FROM texts) t USING (id) WHERE p.kind = 't'
    {digests}) GROUP BY 1),
notices AS (SELECT id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices FROM paired JOIN known ON sha256(text) = digest WHERE kind = 'd' AND what = 'unit' GROUP BY 1)
SELECT p.id AS doc_id, sha256(p.text) AS canonical_sha256, k.license, coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0) AS n_notices
FROM paired p LEFT JOIN known k ON sha256(p.text) = k.digest LEFT JOIN notices n ON p.id = n.id WHERE p.kind = 'd' AND p.what = 'whole'
"""


ORACLE = _oracle()
