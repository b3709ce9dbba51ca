"""Operator 1: licence scan by canonical digests.

A text is lower-cased, its copyright lines go, equivalent spellings are made one, punctuation and white space
become one space. The digest of what is left is hash-joined with the digests of known licences: their full
texts, and the notices made from each licence name and each notice form. Whole documents and their single lines
are looked up, each as an entire text. The known table is built here and small, so it is broadcast.

Only units that hold one of MARKS are normalised; every known text and notice holds one, which a test asserts, so none is missed.
Defined cases: null or empty text has no licence; several licences are listed in order, once each; equal rows
give equal rows; very long texts are looked up whole; ties do not arise, as a digest names one licence; an empty table gives
no rows; other columns are ignored, whatever their names. Texts of Apache-2.0, the GPL family, MPL, BSD-3 and CC are not in the table,
only their notices.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import _common as C

#: Words of which each known text and notice has one.
MARKS = r"(?i)licen[cs]e|permission|redistribut|(?:released|distributed|available) under"
#: A copyright line, one with a sign, a year or a holder after "by", up to its end or to a notice that begins after it; what it ends with is kept. A wrapped
#: line of a licence that begins with "copyright notice" or "copyright holders" is none.
COPYRIGHT = r"(?:copyright[ \t]*(?:\(c\)|©|by\b|:|[0-9]{4})|copyright [^\n]*?\b(?:19|20)[0-9]{2}\b|\(c\)|©)[^\n]*?(?:[.;,][ \t]+((?:this [a-z]+ is )?(?:licen[cs]ed|released|distributed|available) under )|$)"
#: Equivalent spellings, applied in order to lower-case text.
EQUIVALENT = (
    (r"licence", "license"),
    (r"&", " and "),
    (r"https?://", ""),
    (r"all rights reserved", " "),
    (r"\(the ['\"“]license['\"”]\)", " "),
    (r"(?m)^[ \t]*(?:[0-9]{1,2}[.)]|[*•-])[ \t]+", " "),
    (r"\(c\)|©", "copyright"),
    (r"non-?commercial", "noncommercial"),
    (r"sub-license", "sublicense"),
    (r"gnu general public license|gpl", "gpl"),
    (r"\bversion\s+([0-9])", "v$1"),
    (r"\bv ([0-9])", "v$1"),
    (r"([0-9])\.0\b", "$1"),
)
#: id -> names, of which the notices are made.
NAMES = {
    "MIT": ("MIT License", "MIT license terms"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL v2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL v3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL v3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL v3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC License",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
}
SUBJECTS = ("", "this work is ", "this text is ", "this file is ", "this document is ", "this software is ", "this project is ")
VERBS = ("licensed under ", "released under ", "distributed under ", "available under ")
ARTICLES = ("", "the ", "the terms of the ")
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}


def canonical(col: Column) -> Column:
    """The normal form as an expression."""
    out = F.lower(col)
    out = F.regexp_replace(out, r"(?m)^[^\p{L}\n]*" + COPYRIGHT, " $1")
    for find, put in EQUIVALENT:
        out = F.regexp_replace(out, find, put)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def canonical_text(text: str) -> str:
    """The same for one string; the table of known licences is built with it."""
    out = re.sub(r"(?m)^[^a-z\n]*" + COPYRIGHT, r" \1", text.lower())
    for find, put in EQUIVALENT:
        out = re.sub(find, put.replace("$1", r"\1"), out, flags=re.ASCII)
    return re.sub(r"[^a-z0-9]+", " ", out).strip()


def known() -> list[tuple[str, str, str]]:
    """(digest, id, kind), one per digest."""
    found: dict[str, tuple[str, str]] = {}
    put = lambda text, name, kind: found.setdefault(hashlib.sha256(canonical_text(text).encode()).hexdigest(), (name, kind))
    for name, text in TEXTS.items():
        put(text, name, "text")
        for title in (NAMES[name][0], f"The {NAMES[name][0]}", f"{NAMES[name][0]} ({name})", f"The {NAMES[name][0]} ({name})"):
            put(f"{title}\n\n{text}", name, "text")
    for name, forms in NAMES.items():
        for ending in ("", "-only", "-or-later") if "GPL" in name else ("",):
            put(f"SPDX-License-Identifier: {name}{ending}", name, "notice")
        for form in forms:
            for subject in SUBJECTS:
                for verb in VERBS:
                    for article in ARTICLES:
                        put(f"{subject}{verb}{article}{form}", name, "notice")
                        if "license" not in form.lower():
                            put(f"{subject}{verb}{article}{form} license", name, "notice")
    return [(d, *x) for d, x in sorted(found.items())]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (ids in order, joined by commas, empty if none), whole_text (the document is a licence), n_notices of docs(doc_id, text)."""
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(known(), "digest string, license string, kind string"))
    units = docs.select(
        *C.row_key(),
        F.explode(
            F.concat(
                F.transform(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(MARKS)), lambda x: F.struct(x.alias("unit"), F.lit(False).alias("whole"))),
                F.when(F.col("text").rlike(MARKS), F.array(F.struct(F.col("text").alias("unit"), F.lit(True).alias("whole")))).otherwise(F.array().cast("array<struct<unit:string,whole:boolean>>")),
            )
        ).alias("u"),
    )
    hits = units.select("_d", "_t", "u.whole", F.sha2(canonical(F.col("u.unit")).cast("binary"), 256).alias("digest")).join(table, "digest")
    by_row = hits.groupBy("_d", "_t").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"), F.max("whole").alias("whole_text"), F.count_if(~F.col("whole")).alias("n_notices"))
    # a row that is there twice has its units twice: counts are of distinct rows
    times = docs.select(*C.row_key()).groupBy("_d", "_t").agg(F.count("*").alias("_n"))
    by_row = by_row.join(times, ["_d", "_t"]).withColumn("n_notices", F.expr("n_notices div _n")).drop("_n")
    return docs.select("doc_id", *C.row_key()).join(by_row, ["_d", "_t"], "left").select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("whole_text", F.lit(False)).alias("whole_text"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))


def oracle() -> str:
    norm = "lower(unit)"
    norm = f"regexp_replace({norm}, '(?m)^[^\\pL\\n]*{COPYRIGHT}', ' \\1', 'g')"
    for find, put in EQUIVALENT:
        norm = f"regexp_replace({norm}, '{find}', '{put.replace('$1', chr(92) + '1')}', 'g')"
    norm = f"trim(regexp_replace({norm}, '[^\\pL\\pN]+', ' ', 'g'))"
    rows = ", ".join(f"('{d}', '{name}')" for d, name, _ in known())
    return f"""
WITH known(digest, license) AS (VALUES {rows}),
units AS (
  SELECT doc_id, false AS whole, unnest(string_split(text, chr(10))) AS unit FROM documents
  UNION ALL SELECT doc_id, true, text FROM documents
), hits AS (SELECT doc_id, whole, license FROM units JOIN known ON known.digest = sha256({norm}) WHERE regexp_matches(unit, '{MARKS}')),
found AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, bool_or(whole) AS whole_text, count(*) FILTER (WHERE NOT whole) AS n_notices FROM hits GROUP BY doc_id)
SELECT documents.doc_id, coalesce(licenses, '') AS licenses, coalesce(whole_text, false) AS whole_text, coalesce(n_notices, 0)::BIGINT AS n_notices
FROM documents LEFT JOIN found ON documents.doc_id = found.doc_id
"""
