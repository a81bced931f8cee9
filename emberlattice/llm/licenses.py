"""Licence scans: canonical digests of entire texts, hash-joined to known licences. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlattice.llm.license_texts import TEXTS

#: Known notices and licence texts by SPDX id (public texts).
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((name, f"{title}\n\n{text}") for name, titles, text in TEXTS for title in titles),
]

#: A line that opens with the word or a sign and names a year, a sign or a holder's rights; a sentence of a licence that wraps at "copyright" stays.
COPYRIGHT_LINE = (
    r"(^|\n)[^\p{L}\p{N}\n]*(copyright[^\n]*(\(c\)|©|\p{N}{4}|[<\[]year|yyyy|all rights reserved)"
    r"|\(c\)[^\n]*(\p{N}{4}|[<\[]year|all rights reserved)|©|all rights reserved)[^\n]*"
)
NOT_WORDS = r"[^\p{L}\p{N}]+"

#: Spellings that count as one (fixed pairs, applied in this order).
SPELLINGS = [
    ("licenc", "licens"), ("isation", "ization"), ("organis", "organiz"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("utilis", "utiliz"),
    ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("favour", "favor"), ("honour", "honor"), ("labour", "labor"), ("centre", "center"),
    ("programme", "program"), ("whilst", "while"), ("fulfilment", "fulfillment"), ("non commercial", "noncommercial"), ("sub license", "sublicense"),
    ("per cent", "percent"), ("https", "http"), ("copyright owner", "copyright holder"),
]


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words parted by one space, one spelling for each word."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    out = F.trim(F.regexp_replace(out, NOT_WORDS, " "))
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(known: DataFrame, id_col: str = "license_id", text_col: str = "text") -> DataFrame:
    """One row per digest; of several licences with one canonical text the smallest id counts. Empty texts are left out."""
    own = known.select(known[id_col].cast("string").alias("license_id"), known[text_col].alias("text"))
    own = own.filter(canonical(F.col("text")) != "")
    return own.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Joins the canonical digest of each entire text, and of each entire line, to the digests of known licences.

    Returns id_col, digest, license_id (null: the entire text is no known licence), n_license_lines (lines that are one) and
    line_licenses (their ids, sorted and comma-joined). A null text has the digest of an empty one; texts and lines whose canonical form is empty match
    nothing; rows with null or repeated ids keep a result each; an empty table gives no rows. Other columns are never read.
    Without `known` the built-in list is used, a row a text of this module, which is broadcast; another one is joined as Spark sees fit.
    """
    spark = docs.sparkSession
    if known is None:
        digests = F.broadcast(known_digests(spark.createDataFrame(KNOWN, "license_id string, text string")))
    else:
        digests = known_digests(known)
    source = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    lines = (
        source.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .select("doc_id", "key", "at", digest(F.col("line")).alias("digest"))
        .join(digests, "digest")
        .groupBy("doc_id", "key")
        .agg(F.countDistinct("at").alias("n_license_lines"), F.concat_ws(",", F.array_sort(F.collect_set("license_id"))).alias("line_licenses"))
    )
    whole = source.select("doc_id", "key", digest(F.col("text")).alias("digest")).join(digests, "digest", "left").alias("w")
    joined = whole.join(lines.alias("l"), F.col("w.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("w.key") == F.col("l.key")), "left")
    return joined.select(
        F.col("w.doc_id").alias(id_col),
        "digest",
        "license_id",
        F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
        F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
    )


def canonical_sql(text: str) -> str:
    """The same canonical form in DuckDB's SQL."""
    out = f"trim(regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT_LINE}', chr(10), 'g'), '{NOT_WORDS}', ' ', 'g'))"
    for other, one in SPELLINGS:
        out = f"replace({out}, '{other}', '{one}')"
    return out


def scan_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    return f"""
WITH k AS (
    SELECT sha256({canonical_sql("t")}) AS digest, min(i) AS license_id FROM (VALUES {rows}) v(i, t) WHERE {canonical_sql("t")} <> '' GROUP BY 1
),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
found AS (
    SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
    FROM (SELECT doc_id, sha256({canonical_sql("line")}) AS digest FROM lines) JOIN k USING (digest) GROUP BY doc_id
)
SELECT doc_id, digest, license_id, coalesce(n, 0)::BIGINT AS n_license_lines, coalesce(ids, '') AS line_licenses
FROM (SELECT doc_id, sha256({canonical_sql("text")}) AS digest FROM d) LEFT JOIN k USING (digest) LEFT JOIN found USING (doc_id)
"""
