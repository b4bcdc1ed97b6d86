"""License scans by canonical digest lookup.

A text is brought to a canonical form: lower case, copyright lines dropped, equivalent
spellings made one, punctuation and white space reduced to single spaces.  The SHA-256 of the
whole form is joined with the digests of known licence texts, made by the same expressions.
Each line of the canonical text is looked up likewise, which finds one-line licence notices
at any place.

Defined results: null and empty texts have the digest of the empty form and match nothing;
every row is looked up by its own text, also with a null or repeated ``doc_id``; several known texts with one
canonical form report the smallest id; other columns are ignored.
"""
from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import saved, table, text_or_empty

FOLDER = Path(__file__).parent / "licenses"

# Licence texts and one-line notices; more are in FOLDER.
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
          "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
          "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
          "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
              "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
              "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
              "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
              "USE OR PERFORMANCE OF THIS SOFTWARE.")
KNOWN = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the Software.\n\n" + _AS_IS),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
            + _ISC_AS_IS),
    ("0BSD", "BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with "
             "or without fee is hereby granted.\n\n" + _ISC_AS_IS),
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
)

# Spellings that licence matching treats alike; the right side is used.  They
# are applied after punctuation has become single spaces.
SPELLINGS = (
    ("sub licen[cs]e", "sublicense"), ("licence", "license"), ("non commercial", "noncommercial"),
    ("non infring", "noninfring"), ("holder", "owner"), ("organis", "organiz"),
    ("recognis", "recogniz"), ("authoris", "authoriz"), ("favour", "favor"), ("behaviour", "behavior"),
    ("labour", "labor"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("per cent", "percent"),
    ("http ", "https "),
)
_COPYRIGHT = r"(^|\n)[ \t/*#;-]*(copyright[ \t]*(\(c\)|©|[0-9])|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*"


def canonical_lines(text):
    """The non-empty canonical lines of a text, in order."""
    t = F.regexp_replace(F.lower(text), _COPYRIGHT, "\n")
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}\n]+", " ")
    for old, new in SPELLINGS:
        t = F.regexp_replace(t, old, new)
    return F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def digest(lines):
    return F.sha2(F.array_join(lines, " "), 256)


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id) of ``known(license_id, text)``."""
    return (known.select("license_id", digest(canonical_lines(text_or_empty())).alias("digest"),
                         F.size(canonical_lines(text_or_empty())).alias("n"))
            .where("n > 0").groupBy("digest").agg(F.min("license_id").alias("license_id")))


def built_in_texts() -> list[tuple[str, str]]:
    """(license_id, text): ``KNOWN``, its licences without their titles, and what lies in
    ``licenses/``: licence texts (a file's name is the id, up to '__'), and notices and SPDX
    tags made of the forms and names in ``notices.json``."""
    rows = [*KNOWN, *[(i, t.split("\n\n", 1)[1]) for i, t in KNOWN if "\n\n" in t]]
    rows += [(f.stem.split("__")[0], f.read_text(encoding="utf-8")) for f in sorted(FOLDER.glob("*.txt"))]
    said = json.loads((FOLDER / "notices.json").read_text(encoding="utf-8"))
    rows += [(f"{i}-notice", form.format(n=n)) for i, names in said["names"].items() for n in names for form in said["forms"]]
    rows += [(f"{i}-notice", f"SPDX-License-Identifier: {tag}") for i, tags in said["spdx"].items() for tag in tags]
    return rows


def built_in(spark) -> DataFrame:
    rows = json.dumps([{"license_id": i, "text": t} for i, t in built_in_texts()])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<license_id:string,text:string>>")))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_digest, license_id, notices): the licence that the whole text is, or null,
    and the ids of the known texts that stand as a line of it, sorted and comma-joined."""
    if known is None:
        digests = F.broadcast(known_digests(built_in(docs.sparkSession)))  # one row for each built-in text
    else:
        digests = saved(known_digests(known), "known-digests")  # the planner knows its size
    # rows meet their notices by a digest of their text
    base = docs.select("doc_id", F.sha2(text_or_empty(), 256).alias("_text"), canonical_lines(text_or_empty()).alias("_lines"))
    whole = base.select("doc_id", "_text", digest(F.col("_lines")).alias("text_digest")).join(
        digests.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    lines = base.select("_text", F.explode(F.array_distinct("_lines")).alias("_line"))
    notices = (lines.select("_text", F.sha2("_line", 256).alias("digest")).join(digests, "digest")
               .groupBy("_text").agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("notices")))
    return whole.join(notices, "_text", "left").select(
        "doc_id", "text_digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents against the built-in licence texts and notices."""
    return scan(table(spark, sf_dir, "documents"))


def _sql_lines(text: str) -> str:
    t = f"regexp_replace(lower({text}), '{_COPYRIGHT}', chr(10), 'g')"
    t = f"regexp_replace(replace({t}, '&', ' and '), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for old, new in SPELLINGS:
        t = f"regexp_replace({t}, '{old}', '{new}', 'g')"
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


_QUOTED = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in built_in_texts())
SQL = f"""
WITH k AS (
  SELECT sha256(array_to_string({_sql_lines("t")}, ' ')) AS digest, min(i) AS license_id
  FROM (VALUES {_QUOTED}) v(i, t) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text, {_sql_lines("coalesce(text, '')")} AS ls FROM documents),
w AS (SELECT doc_id, text, sha256(array_to_string(ls, ' ')) AS text_digest FROM d),
n AS (
  SELECT text, string_agg(license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT DISTINCT text, license_id
        FROM (SELECT text, sha256(unnest(ls)) AS digest FROM d) l JOIN k USING (digest)) GROUP BY text)
SELECT w.doc_id, w.text_digest, k.license_id, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN k ON w.text_digest = k.digest LEFT JOIN n ON w.text = n.text
"""
