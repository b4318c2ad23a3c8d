"""License scans: canonical digests looked up by a hash join.

The canonical form of a text drops copyright lines, lowers case, turns
everything but letters and digits into single spaces and rewrites equivalent
spellings. Its SHA-256 is joined with the digests of known licences: entire
texts with known texts, and entire lines with known one-line notices. The
known digests are a fixed list of a few dozen rows, so they go to every task
and no text is shuffled. It is all SQL functions. Long licences are known by
the digests of their published texts, whole, and up to the end of their terms.
Comment marks before lines are punctuation and vanish; copyright lines go with
their comment marks, with or without a year.

Defined results: a null or empty text has the digest of the empty string and
no licence; a null id stays null; repeated rows each give a row; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import doc_text
from quire.llm.license_texts import DIGESTS, NOTICES, TEXTS

#: Spellings taken as one, in the order in which they are rewritten.
SPELLINGS = [
    (r"licenc", "licens"),
    (r"\borganisation", "organization"),
    (r"\bauthoris", "authoriz"),
    (r"\bfavour", "favor"),
    (r"\bnon infring", "noninfring"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bsub licens", "sublicens"),
    (r"\bv(?:ersion)? (\d)", "version $1"),
    (r"\bv(\d)", "version $1"),
    (r"\bcreative commons\b", "cc"),
]
#: What may stand before a copyright line: indents and comment marks.
_LEAD = r"[ \t]*(?:(?:rem|dnl)[ \t]+|[#*/;%!<>|.-]+[ \t]*)?"
#: Whole lines that state a copyright: with a sign, a year or a place for one; of "the ... authors" and the like; of a firm; and what follows such lines.
COPYRIGHT_LINE = (
    rf"(?mi)^{_LEAD}(?:(?:portions[ \t]+)?copyright\b[ \t:]*(?:\(c\)|©|[12][0-9]{{3}}|[\[{{<]y)"
    r"|copyright[ \t]+(?:by[ \t]+)?the[ \t][^\n]*\b(?:authors|contributors|developers|maintainers|project|team|foundation)[ \t.,]*$"
    r"|(?-i:Copyright|COPYRIGHT)[ \t]+(?-i:[A-Z])[^\n]*\b(?:inc|llc|ltd|gmbh|corp|corporation|foundation|authors)[ \t.,]*$"
    r"|\(c\)[ \t]*[12][0-9]{3}|©|spdx-filecopyrighttext:|all rights reserved).*$"
)
#: Every notice holds one of these, so other lines need no digest.
MARKERS = ("licen", "spdx")


def canonical(text: Column) -> Column:
    out = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, ""))
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for pattern, spelling in SPELLINGS:
        out = F.regexp_replace(out, pattern, spelling)
    return out


def known(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(digest, license) of known texts."""
    texts = spark.createDataFrame(rows, "license string, text string")
    return texts.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license").distinct()


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest of the canonical text, license of an entire text that is
    known, and the licences of its notice lines, in order, with their number."""
    spark = docs.sparkSession
    rows = doc_text(docs, id_col, text_col)
    marked = lambda line: F.lower(line).contains(MARKERS[0]) | F.lower(line).contains(MARKERS[1])
    notices = {r.digest: r.license for r in known(spark, NOTICES).collect()}  # a fixed list
    by_digest = F.create_map(*[F.lit(x) for pair in notices.items() for x in pair])
    # a notice's lookup stays in its row: the known notices are a constant
    named = F.transform(F.filter(F.split("text", "\n", -1), marked), lambda line: F.try_element_at(by_digest, F.sha2(canonical(line), 256)))
    found = rows.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.filter(named, lambda x: x.isNotNull()).alias("named"))
    texts = known(spark, TEXTS).unionByName(spark.createDataFrame(DIGESTS, "license string, digest string"))
    joined = found.join(F.broadcast(texts), "digest", "left")
    return joined.select("doc_id", "digest", "license", F.array_sort(F.array_distinct("named")).alias("notices"), F.size("named").cast("long").alias("n_notices"))


def _sql_canonical(column: str) -> str:
    """The canonical form for DuckDB."""
    out = f"trim(regexp_replace(lower(regexp_replace({column}, '{COPYRIGHT_LINE}', '', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for pattern, spelling in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{spelling.replace('$', chr(92))}', 'g')"
    return out


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in rows)


ORACLE = f"""
WITH known AS (SELECT DISTINCT sha256({_sql_canonical("t")}) AS digest, license FROM (VALUES {_values(TEXTS)}) AS k(license, t)
  UNION ALL SELECT digest, license FROM (VALUES {_values(DIGESTS)}) AS k(license, digest)),
notice AS (SELECT DISTINCT sha256({_sql_canonical("t")}) AS digest, license FROM (VALUES {_values(NOTICES)}) AS k(license, t)),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d),
named AS (
  SELECT row, license FROM (SELECT row, sha256({_sql_canonical("line")}) AS digest FROM lines WHERE lower(line) LIKE '%licen%' OR lower(line) LIKE '%spdx%') JOIN notice USING (digest)),
grouped AS (SELECT row, list_sort(list_distinct(list(license))) AS notices, count(*) AS n FROM named GROUP BY row),
c AS (SELECT row, doc_id, sha256({_sql_canonical("text")}) AS digest FROM d)
SELECT doc_id, digest, license, array_to_string(notices, ',') AS notices, coalesce(n, 0)::BIGINT AS n_notices
FROM c LEFT JOIN known USING (digest) LEFT JOIN grouped USING (row)
"""
