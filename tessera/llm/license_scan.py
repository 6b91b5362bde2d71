"""License scanning by canonical digests: normalised texts are hash-joined to the digests of known licenses.

DataFrame functions only."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import computed

# License ids and the notices and texts that state them.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This software is licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
]
# Spellings taken as one, in this order, after lower-casing and punctuation.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("favour", "favor"), ("while", "whilst"), ("non commercial", "noncommercial"), ("v 2", "version 2"), ("v 3", "version 3"), ("v2", "version 2"), ("v3", "version 3")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT = r"^(copyright|©|\(c\)|all rights reserved)[^\n]*$"


def texts() -> list[tuple[str, str]]:
    """(license, text) of the licenses' own texts, one file each."""
    return [(f.stem, f.read_text()) for f in sorted(Path(__file__).with_name("licenses").glob("*.txt"))]


def plain(text: Column) -> Column:
    """Lines in lower case (A-Z), without copyright lines; each run of other characters than letters and digits
    is one space. Line breaks stay."""
    out = F.translate(text, UPPER + "\r", LOWER + "\n")
    out = F.regexp_replace(out, "(?m)" + COPYRIGHT, "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    return F.regexp_replace(out, r" ?\n ?", "\n")


def respelt(text: Column) -> Column:
    """A plain text with equivalent spellings replaced and its ends trimmed."""
    out = text
    for old, new in SPELLINGS:
        out = F.regexp_replace(out, rf"(?<![^ \n]){old}(?![^ \n])", new)
    return F.trim(F.when(text.rlike("|".join(old for old, _ in SPELLINGS)), out).otherwise(text))


def canonical(df: DataFrame, column: str) -> DataFrame:
    """df with the canonical form of a column in `_c`."""
    return computed(computed(df, _p=plain(F.coalesce(F.col(column), F.lit("")))), _c=respelt(F.col("_p"))).drop("_p")


def digest(canonical_text: Column) -> Column:
    """SHA-256 of a canonical text on one line."""
    return F.sha2(F.trim(F.regexp_replace(canonical_text, r"\s+", " ")), 256)


def known_texts(spark: SparkSession, known: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """(license, line) of known texts, in canonical form on one line."""
    frame = known if isinstance(known, DataFrame) else spark.createDataFrame(known, "license string, text string")
    return canonical(frame.toDF("license", "text"), "text").select("license", F.trim(F.regexp_replace("_c", r"\s+", " ")).alias("line"))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """(digest, license) of known texts; of equal canonical texts the least id holds."""
    return known_texts(spark, known).groupBy(digest(F.col("line")).alias("digest")).agg(F.min("license").alias("license"))


def passages(texts: DataFrame, held: DataFrame) -> DataFrame:
    """texts (_c: canonical texts) with the digests, in `_runs`, of runs of two lines or more that can be known texts
    (held: line), however these are broken into lines: from a line that begins like one, as many words, if a line
    ends there. What begins and how many words are collected."""
    found = held.where("line <> ''").select(F.slice(F.split("line", " "), 1, 2).alias("begin"), F.size(F.split("line", " ")).alias("n")).distinct().collect()
    sizes = sorted({r["n"] for r in found if r["n"] > 1})
    if not sizes:
        return texts.withColumn("_runs", F.array().cast("array<string>"))
    begins = "(?m)^(?:" + "|".join(sorted({r"[ \n]+".join(map(re.escape, r["begin"])) for r in found})) + r")(?![^ \n])"
    # Line breaks become words of their own; `_at` has the places of the other words.
    broken = F.when(F.col("_c").rlike(begins), F.filter(F.split(F.regexp_replace("_c", "\n", " \n "), " +"), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    rows = computed(texts, _t=broken)
    rows = computed(rows, _at=F.filter(F.when(F.size("_t") > 0, F.sequence(F.lit(0), F.size("_t") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get("_t", i) != "\n"), _w=F.filter("_t", lambda x: x != "\n"))
    ends = lambda i: F.coalesce(F.get("_t", i), F.lit("\n")) == "\n"
    first = F.filter(F.when(F.size("_at") > 0, F.sequence(F.lit(0), F.size("_at") - 1)).otherwise(F.array().cast("array<int>")), lambda s: F.get("_w", s).isin(*{r["begin"][0] for r in found}) & ((F.get("_at", s) == 0) | (F.get("_t", F.greatest(F.lit(0), F.get("_at", s) - 1)) == "\n")))
    rows = computed(rows, _first=first)
    whole = lambda s, n: (s + n <= F.size("_at")) & (F.get("_at", s + n - 1) - F.get("_at", s) >= n) & ends(F.get("_at", s + n - 1) + 1)
    runs = F.flatten(F.transform("_first", lambda s: F.filter(F.transform(F.array(*map(F.lit, sizes)), lambda n: F.when(whole(s, n), digest(F.array_join(F.slice("_w", s + 1, n), " ")))), lambda d: d.isNotNull())))
    return computed(rows, _runs=runs).drop("_t", "_at", "_w", "_first")


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | DataFrame | None = None, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per id: license of the whole text (null if it is none), licenses that lines state, single ones or
    runs of several (sorted, distinct), and how many lines or runs do.

    Entire texts are compared: a document's canonical text, that of each of its lines, and that of runs of its lines
    must equal a known one (as default KNOWN and the licenses' own texts). Null and empty texts match nothing. Rows
    that repeat an id are taken together; null is one id. All lines of a row meet in one map task, so a hot id sends
    one partial row from each task. The known digests are joined without a hint: Spark broadcasts them while they
    are small."""
    known = KNOWN + texts() if known is None else known
    rows = canonical(docs.select(F.col(id_column), F.col(column).alias("_text")), "_text").drop("_text")
    rows = passages(rows, known_texts(docs.sparkSession, known))
    part = lambda whole, d: F.struct(F.lit(whole).alias("whole"), d.alias("digest"))
    digests = F.concat(F.array(part(True, digest(F.col("_c")))), F.transform(F.split("_c", "\n"), lambda x: part(False, F.sha2(x, 256))), F.transform("_runs", lambda d: part(False, d)))
    parts = rows.select(id_column, F.explode(digests).alias("_p")).select(id_column, "_p.whole", "_p.digest")
    met = parts.join(known_digests(docs.sparkSession, known), "digest", "left")
    # Two levels: a document's many lines shrink to its few licenses before licenses are listed.
    met = met.groupBy(id_column, "whole", "license").agg(F.count("license").alias("n"))
    return met.groupBy(id_column).agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.coalesce(F.array_join(F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ","), F.lit("")).alias("line_licenses"),
        F.sum(F.when(~F.col("whole"), F.col("n")).otherwise(0)).alias("n_license_lines"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every whole text of documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql_canonical(x: str) -> str:
    x = f"translate({x}, '{UPPER}' || chr(13), '{LOWER}' || chr(10))"
    x = rf"regexp_replace({x}, '(?m){COPYRIGHT}', '', 'g')"
    x = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    x = rf"regexp_replace({x}, ' ?\n ?', chr(10), 'g')"
    for old, new in SPELLINGS:
        # Twice, as neighbours share their separator.
        for _ in range(2):
            x = rf"regexp_replace({x}, '(^|[ \n]){old}($|[ \n])', '\1{new}\2', 'g')"
    return f"trim({x}, ' ')"


SQL = (
    "WITH known(license, t) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in KNOWN) + "),\n"
    rf"k AS (SELECT sha256(trim(regexp_replace({_sql_canonical('t')}, '\s+', ' ', 'g'))) AS digest, min(license) AS license FROM known GROUP BY 1),"
    f"\nc AS (SELECT doc_id, {_sql_canonical('''coalesce(text, '')''')} AS c FROM documents),\n"
    rf"p AS (SELECT doc_id, true AS whole, sha256(trim(regexp_replace(c, '\s+', ' ', 'g'))) AS digest FROM c UNION ALL SELECT doc_id, false, sha256(x) FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS x FROM c))"
    "\nSELECT doc_id, min(license) FILTER (whole) AS license, coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (NOT whole), '') AS line_licenses, count(license) FILTER (NOT whole) AS n_license_lines"
    "\nFROM p LEFT JOIN k USING (digest) GROUP BY doc_id"
)
