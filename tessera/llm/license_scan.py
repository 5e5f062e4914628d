"""Licence scan: canonical digests of entire texts, hash-joined to those of known licences.

Canonical form: lower case, lines that state a copyright or reserve all rights
dropped, everything but letters and digits to one space, equivalent spellings to
one of them. The digest is SHA-256 of that form. Only built-in expressions; the
known licences are a table of one row per licence (its size is the caller's
list, not the data's) and are broadcast, so documents are never shuffled.

Defined results: a null text counts as empty; a text whose canonical form is
empty has digest of the empty string and matches nothing. Repeated rows each get
their row. Columns of the input pass through ``scan``; its own columns replace
equally named ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, SPELLINGS, TEXTS
from .shared import read_table, unused

#: Copyright with (c), a placeholder or a year, (c) with either, the sign, or rights reserved alone: not licence text that is wrapped before such a word.
NOTICE_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*(?:copyright\b(?:[^\p{L}\p{N}\n]*(?:\(c\)|©|[<\[{])|[^\n]*\b(?:19|20)\d\d\b)[^\n]*|\(c\)[ \t]*(?:copyright\b|(?:19|20)\d\d|[<\[{])[^\n]*|©[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    c = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOTICE_LINE, "")
    # Two spaces between words: then equal neighbours don't share the space that both need.
    c = F.concat(F.lit(" "), F.regexp_replace(c, NOT_WORD, "  "), F.lit(" "))
    for a, b in SPELLINGS.items():
        c = F.replace(c, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(c, " +", " "))


def known(spark: SparkSession, texts: dict[str, str] = TEXTS, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """license_id and digest of each known licence, by its text or by its digest; of equal canonical forms the first id by name."""
    rows = spark.createDataFrame(sorted(texts.items()), "license_id string, text string").select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    rows = rows.unionAll(spark.createDataFrame(sorted(digests.items()), "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``docs`` with canon_chars, digest, license_id (null: none) and is_license."""
    licenses = known(docs.sparkSession) if licenses is None else licenses
    kept = [c for c in docs.columns if c not in ("canon_chars", "digest", "license_id", "is_license")]
    own = unused(docs, "_canon")
    d = docs.select(*kept, canonical(F.col(text)).alias(own))
    d = d.select(*kept, F.length(own).cast("long").alias("canon_chars"), F.sha2(own, 256).alias("digest"))
    return d.join(F.broadcast(licenses), "digest", "left").select(*kept, "canon_chars", "digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _sql() -> str:
    def canon(x: str) -> str:
        c = f"regexp_replace(lower(coalesce({x}, '')), '{NOTICE_LINE}', '', 'g')"
        c = f"' ' || regexp_replace({c}, '{NOT_WORD}', '  ', 'g') || ' '"
        for a, b in SPELLINGS.items():
            c = f"replace({c}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
        return f"trim(regexp_replace({c}, ' +', ' ', 'g'))"

    q = lambda s: "'" + s.replace("'", "''") + "'"
    return f"""
WITH k AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, sha256({canon("text")}) AS digest
           FROM (VALUES {", ".join(f"({q(a)}, {q(b)})" for a, b in sorted(TEXTS.items()))}) AS v(license_id, text)
           UNION ALL SELECT * FROM (VALUES {", ".join(f"({q(a)}, {q(b)})" for a, b in sorted(DIGESTS.items()))}) AS v(license_id, digest)) GROUP BY 1),
c AS (SELECT doc_id, {canon("text")} AS canon FROM documents),
d AS (SELECT doc_id, length(canon)::BIGINT AS canon_chars, sha256(canon) AS digest FROM c)
SELECT doc_id, canon_chars, digest, license_id, license_id IS NOT NULL AS is_license FROM d LEFT JOIN k USING (digest)
"""


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE_SQL = {"op5_license_scan": _sql()}
