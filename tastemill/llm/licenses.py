"""Licence scan: canonical digests of entire texts, looked up in a table of known licences.

A text is brought to a canonical form - lower case, without copyright lines, words of letters and digits only, equivalent
spellings made one - and its md5 is joined with the digests of the known licences. The units that are looked up are the
whole document and each of its lines, so that a notice line inside other text is found by its entire text as well.

Only DataFrame functions. Defined results: units without a word have no digest and match nothing, so NULL, empty and blank
texts give no rows; rows that share a doc_id are counted together; a licence listed twice counts once; two licences of
equal canonical form are both reported. Other columns are ignored.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm.words import plain_words

# Equivalent words of the public licence matching guidelines (variant, canonical spelling).
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "catalogue": "catalog", "categorise": "categorize", "centre": "center", "emphasised": "emphasized",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful", "https": "http",
}

#: A line that states a copyright: the word with the sign, a year or a place for one; a wrapped line of a licence that begins with
#: "copyright notice" or "(c) You must" does not.
COPYRIGHT_LINE = (
    r"(?im)^[ \t/*#;-]*(©|\(c\)[ \t]*(copyright|[0-9])|copyright[ \t:,]*(\(c\)|©|[<\[{](yyyy|year))|copyright[^\n]*\b(19|20)[0-9]{2}\b)"
    r"[^\n]*$"
)

#: Full texts with the titles they are known under; a licence file has one title or none.
TEXTS = Path(__file__).with_name("license_texts.json")
RESERVED = "All rights reserved."

# Notice lines, among them those of the test tables, and two short licences.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        'granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
        "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
]


def known_licenses(spark: SparkSession) -> DataFrame:
    """The built-in table (license_id, text): ``KNOWN``, and the full texts with and without title and ``RESERVED`` line; pass a
    longer one of the same columns to ``scan`` where there is one."""
    full = [
        (entry["license_id"], "\n".join([*title, *reserved, entry["text"]]))
        for entry in json.loads(TEXTS.read_text("utf-8"))
        for title in [[], *([t] for t in entry["titles"])]
        for reserved in ([], [RESERVED])
    ]
    return spark.createDataFrame(full + KNOWN, "license_id string, text string")


def digest(text: Column) -> Column:
    """md5 of the canonical form, NULL where no word is left."""
    words = plain_words(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, ""))
    table = F.create_map(*[F.lit(x) for pair in EQUIVALENT.items() for x in pair])
    # the membership test is a hash lookup; a map is searched from end to end, so only for the words that are in it
    same = F.transform(words, lambda w: F.when(w.isin(list(EQUIVALENT)), F.element_at(table, w)).otherwise(w))
    form = F.array_join(same, " ")
    return F.when(form != "", F.md5(form.cast("binary")))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, scope ('text': the whole document, 'line'), license_id, n_units of all matches of ``docs(doc_id, text)``."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("line").alias("scope"), x.alias("unit")))
    whole = F.array(F.struct(F.lit("text").alias("scope"), F.col("text").alias("unit")))
    units = docs.filter(F.col("text").isNotNull()).select("doc_id", F.explode(F.concat(whole, lines)).alias("u"))
    hashed = units.select("doc_id", "u.scope", digest(F.col("u.unit")).alias("digest")).filter(F.col("digest").isNotNull())
    table = known.select("license_id", digest(F.col("text")).alias("digest")).filter(F.col("digest").isNotNull()).distinct()
    found = hashed.join(table, "digest")
    return found.groupBy("doc_id", "scope", "license_id").agg(F.count(F.lit(1)).alias("n_units"))


def comparison_sql() -> str:
    """The scan for ``KNOWN`` over ``documents`` in SQL; the full texts of ``TEXTS`` are not in it."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    known = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in KNOWN)
    pairs = ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in EQUIVALENT.items())

    def form(text: str) -> str:
        plain = f"regexp_replace({text}, '(?im)^[ \\t/*#;-]*(copyright|\\(c\\)|©)[^\\n]*$', '', 'g')"
        words = rf"list_filter(regexp_split_to_array(lower({plain}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
        return f"array_to_string(list_transform({words}, lambda w: coalesce(map_extract(MAP {{{pairs}}}, w)[1], w)), ' ')"

    return f"""
WITH units AS (
    SELECT doc_id, 'text' AS scope, text AS unit FROM documents
    UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents
), hashed AS (SELECT doc_id, scope, {form("unit")} AS form FROM units),
known AS (SELECT DISTINCT license_id, {form("text")} AS form FROM (VALUES {known}) AS k(license_id, text))
SELECT doc_id, scope, license_id, count(*) AS n_units FROM hashed JOIN known USING (form) WHERE form <> ''
GROUP BY doc_id, scope, license_id
"""
