"""Quality rules: a short-circuit cascade, ordered on a sample by rejection per cost.

Each rule is a SQL condition that rejects a row. On a bounded sample the rules
run one by one; a rule's cost is the time of its job less that of a job
without a rule, its selectivity the share of sample rows it rejects. Rules are
then ordered by rejection per cost and put into one CASE, so a row pays for a
rule only if all rules before it let the row pass. The order changes what a
run costs, never a verdict. All of it is DataFrame and SQL functions; the
statistics of a text need no shuffle, so no text or group can be too large for
more than its own row.

Defined results: a null or empty text has no words and fails the base rule; a
null id stays null; repeated rows each give a row; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import doc_text, stored

#: Rows of the sample on which rules are measured, as expected.
SAMPLE_ROWS = 2000
MIN_WORDS = 50
REPEAT_PERCENT = 50

#: The rules of a text: a true condition rejects.
RULES: dict[str, str] = {
    "symbols": "10 * n_symbols > n_words",
    "word_length": "2 * word_chars < 5 * n_words or word_chars > 15 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "exclaiming": "10 * regexp_count(text, '[!?]') > 3 * n_words",
    "shouting": r"10 * regexp_count(text, '\\p{Lu}') > 4 * word_chars",
    "few_letters": r"10 * regexp_count(text, '\\p{L}') < 6 * word_chars",
    "unfinished_lines": r"10 * regexp_count(text, '(\\.\\.\\.|…)[ \\t]*(\\n|$)') > 3 * n_lines",
    "bullet_lines": r"10 * regexp_count(text, '(^|\\n)[ \\t]*[-*•][ \\t]') > 9 * n_lines",
}


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the counts that rules use. Words in repeated windows:
    each window of three words becomes one number, its hash above its place;
    sorted, equal hashes are neighbours, and the places of those that have one
    cover up to three words each."""
    space = r"[\\x20\\x09-\\x0D]+"
    words = doc_text(docs, id_col, text_col).select("doc_id", "text", F.expr(f"array_remove(split(text, '{space}', -1), '')").alias("w"), F.split("text", "\n", -1).alias("all_lines"))
    counted = words.select(
        "doc_id",
        "text",
        "w",
        F.expr("cast(size(w) as bigint)").alias("n_words"),
        F.expr("cast(length(array_join(w, '')) as bigint)").alias("word_chars"),
        F.expr("cast(regexp_count(text, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr(r"filter(all_lines, x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.expr("coalesce(cast(ceil(log2(size(w) + 1D)) as int), 0)").alias("b"),
    )
    marked = counted.select(
        "doc_id",
        "text",
        "n_words",
        "word_chars",
        "n_symbols",
        "b",
        F.expr("cast(size(lines) as bigint)").alias("n_lines"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr("if(n_words < 3, array(), sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), b) | i)))").alias("s"),
    )
    placed = marked.withColumn(
        "p",
        F.expr(
            "if(size(s) < 2, array(), sort_array(transform(filter(sequence(0, size(s) - 1), j ->"
            " shiftrightunsigned(get(s, j), b) = shiftrightunsigned(coalesce(get(s, j + 1), ~get(s, j)), b)"
            " or shiftrightunsigned(get(s, j), b) = shiftrightunsigned(coalesce(get(s, j - 1), ~get(s, j)), b)),"
            " j -> coalesce(get(s, j), 0L) & (shiftleft(1L, b) - 1L))))"
        ),
    )
    return placed.select(
        "doc_id",
        "text",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.expr("if(size(p) = 0, 0L, aggregate(sequence(0, size(p) - 1), 0L, (n, j) -> n + least(3L, coalesce(get(p, j + 1) - get(p, j), 3L))))").alias("n_repeat_words"),
    )


def sampled(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """About so many of the rows, drawn before anything is worked out for them."""
    return docs.sample(False, min(1.0, sample_rows / max(docs.count(), 1)), seed)


def measured(sample: DataFrame, rules: dict[str, str]) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected) of each rule on a sample, in the order to run them."""
    sample = stored(sample, "rule-sample")

    def run(condition: str) -> tuple[float, float]:
        began = time.perf_counter()
        n, hits = sample.agg(F.count(F.lit(1)), F.expr(f"count_if({condition})")).first()
        return time.perf_counter() - began, hits / max(n, 1)

    run("false")
    base = run("length(text) < 0")[0]
    found = [(name, max(seconds - base, 1e-4), share) for name, (seconds, share) in ((name, run(c)) for name, c in rules.items())]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1]))


def cascade(rows: DataFrame, sample: DataFrame, rules: dict[str, str] | None = None, first: str = "false") -> DataFrame:
    """`rows` with `passes`: no rule rejects the row. The rules are ordered on
    `sample`. Rows where `first` holds fail before any rule runs."""
    rules = RULES if rules is None else rules
    order = [name for name, _, _ in measured(sample, rules)]
    branches = "".join(f" when {rules[name]} then false" for name in order)
    return rows.withColumn("passes", F.expr(f"case when {first} then false{branches} else true end"))


BASE_FAILED = f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)"

ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         row_number() OVER () AS row
  FROM documents),
windows AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
covered AS (
  SELECT row, count(DISTINCT i + k) AS n_repeat_words
  FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY row),
s AS (
  SELECT doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR 10 * n_symbols > n_words OR 2 * word_chars < 5 * n_words OR word_chars > 15 * n_words
            OR 10 * n_dup_lines > 3 * n_lines
            OR 10 * len(regexp_extract_all(text, '[!?]')) > 3 * n_words
            OR 10 * len(regexp_extract_all(text, '\p{Lu}')) > 4 * word_chars
            OR 10 * len(regexp_extract_all(text, '\p{L}')) < 6 * word_chars
            OR 10 * len(regexp_extract_all(text, '(\.\.\.|…)[ \t]*(\n|$)')) > 3 * n_lines
            OR 10 * len(regexp_extract_all(text, '(^|\n)[ \t]*[-*•][ \t]')) > 9 * n_lines) AS kept
FROM s
"""


def quality_rules(docs: DataFrame, rules: dict[str, str] | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of each text, whether the base rule fails, and whether the row is kept."""
    sample = text_statistics(sampled(docs, sample_rows), id_col, text_col)
    rows = cascade(text_statistics(docs, id_col, text_col), sample, rules, BASE_FAILED)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(BASE_FAILED).alias("base_failed"), F.col("passes").alias("kept")
    )
