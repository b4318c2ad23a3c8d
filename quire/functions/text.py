"""Unicode-exact text Column functions (cleaning, keys, flags, verdicts).

All functions take and return ``Column`` objects and compile to JVM-side
expressions (``regexp_replace``, ``translate``, ``rlike`` ...), so they stay
inside whole-stage codegen. Java's ``\\w``/``\\s`` are ASCII-only, so the
character classes are spelled out explicitly (see ``quire.constants``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c: Column | str) -> Column:
    """Runs of Unicode whitespace become one space, then both ends are
    stripped. After collapsing, only U+0020 can sit at the ends, which is
    exactly what ``trim`` removes."""
    return F.trim(F.regexp_replace(_col(c), K.SPACE_RUN, " "))


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()``: Unicode whitespace removed at both ends only."""
    return F.regexp_replace(_col(c), "^" + K.SPACE_RUN + "|" + K.SPACE_RUN + "$", "")


def strip_urls(c: Column | str) -> Column:
    """``https?://`` followed by non-space characters is removed."""
    return F.regexp_replace(_col(c), K.java(K.URL_CLEAN), "")


def strip_mentions(c: Column | str) -> Column:
    """``@`` followed by Unicode word characters is removed."""
    return F.regexp_replace(_col(c), K.java(K.MENTION_CLEAN), "")


def clean(c: Column | str) -> Column:
    """T4: URLs, then mentions, then whitespace collapse."""
    return collapse_ws(strip_mentions(strip_urls(c)))


def dedup_key(c: Column | str) -> Column:
    """T5: lower-case, collapse whitespace, strip."""
    return collapse_ws(F.lower(_col(c)))


def normalize(c: Column | str) -> Column:
    """Lower-case, typographic quotes/dashes to ASCII, collapse."""
    return collapse_ws(F.translate(F.lower(_col(c)), "’“”—–", "'\"\"--"))


def word_set(c: Column | str) -> Column:
    """Distinct ``[a-z0-9']+`` words of the normalized text."""
    return F.array_distinct(F.regexp_extract_all(normalize(c), F.lit("[a-z0-9']+"), 0))


def opening_key(c: Column | str, words: int = K.OPENING_WORDS) -> Column:
    """First words of the plain lower-cased text (no typographic
    normalisation, so a curly apostrophe splits a word)."""
    toks = F.regexp_extract_all(F.lower(_col(c)), F.lit("[A-Za-z0-9']+"), 0)
    return F.array_join(F.slice(toks, 1, words), " ")


def char_length(c: Column | str) -> Column:
    """Length in code points (same as Python ``len``)."""
    return F.length(_col(c))


def length_group(c: Column | str) -> Column:
    """Actual length group by the band upper bounds."""
    n = F.length(_col(c))
    out = None
    for name, _lo, hi, _p in K.LENGTH_BANDS[:-1]:
        out = (F.when(n <= hi, F.lit(name)) if out is None else out.when(n <= hi, F.lit(name)))
    return out.otherwise(F.lit(K.LENGTH_BANDS[-1][0]))


def has_marker(c: Column | str, marker: str) -> Column:
    """Literal containment (``?`` in the reference; a parameter here)."""
    return _col(c).contains(marker)


def has_emoji(c: Column | str) -> Column:
    """T11: 'likely emoji' = any code point above U+1F000."""
    return _col(c).rlike(K.java(K.EMOJI))


def count_char(c: Column | str, ch: str) -> Column:
    c = _col(c)
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def any_match(c: Column | str, templates: list[str]) -> Column:
    """Any of the patterns matches (one alternation; F9)."""
    return _col(c).rlike("|".join("(?:" + K.java(t) + ")" for t in templates))


def count_matches(c: Column | str, templates: list[str]) -> Column:
    """Number of patterns that match at least once (v2 boilerplate)."""
    c = _col(c)
    return reduce(lambda a, b: a + b, [c.rlike(K.java(t)).cast("int") for t in templates])


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``. Projections
    share repeated subexpressions, but a predicate that Catalyst inlines
    into a filter would otherwise re-run an expensive regex at every
    reference."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keep_nonempty(df, name: str, value: Column):
    """Add ``name`` = ``value`` and drop rows where it is null or empty,
    evaluating ``value`` once: a filter on a projected expression is pushed
    below the projection and would compute it twice."""
    return df.select("*", F.explode(F.filter(F.array(value), lambda t: F.length(t) > 0)).alias(name))


def quality_flags(c: Column | str) -> Column:
    """F5 (v2): comma-joined flags, '' when clean. Early exits for
    ``empty``, ``over_280`` and ``placeholder_handle``."""
    return bind(collapse_ws(c), _quality_flags)


def _quality_flags(t: Column) -> Column:
    low = F.lower(t)
    n = F.length(t)
    leak = reduce(lambda a, b: a | b, [low.contains(p) for p in K.V2_LEAK_PHRASES])
    cumulative = F.concat_ws(
        ",",
        F.when(n < K.V2_MIN_CHARS, F.lit("too_short")),
        F.when(leak, F.lit("instruction_leak")),
        F.when(count_char(t, "#") > K.V2_MAX_HASHTAGS, F.lit("too_many_hashtags")),
        F.when(count_char(t, "@") > K.V2_MAX_MENTIONS, F.lit("too_many_mentions")),
        F.when(t.rlike(K.PUNCT_SPAM), F.lit("punctuation_spam")),
        F.when(count_matches(low, K.V2_BOILERPLATE) >= 2, F.lit("boilerplate")),
    )
    return (
        F.when(n == 0, F.lit("empty"))
        .when(n > K.V2_MAX_CHARS, F.lit("over_280"))
        .when(low.contains(K.PLACEHOLDER_HANDLE), F.lit("placeholder_handle"))
        .otherwise(cumulative)
    )


def row_verdict(c: Column | str, min_chars: Column | str, max_chars: Column | str) -> Column:
    """F7-F10 (v3), row-local part: the first failing check, else 'ok'.
    ``near_duplicate`` and ``repeated_opening`` depend on earlier accepted
    rows and are decided by the greedy operator."""
    raw = _col(c)
    t = collapse_ws(raw)
    norm = normalize(t)
    n = F.length(t)
    return (
        F.when(raw.isNull(), F.lit("not_a_string"))
        .when(n == 0, F.lit("empty"))
        .when(~n.between(_col(min_chars), _col(max_chars)), F.lit("profile_length_mismatch"))
        .when(t.rlike(K.URL_PRESENT), F.lit("contains_url"))
        .when(t.rlike(K.java(K.HANDLE_PRESENT)), F.lit("contains_handle"))
        .when(any_match(norm, K.V3_METADATA), F.lit("metadata_leakage"))
        .when(any_match(norm, K.V3_BOILERPLATE), F.lit("boilerplate"))
        .otherwise(F.lit("ok"))
    )


def not_null_token(c: Column | str) -> Column:
    """Pandas reads these tokens as missing; Spark keeps them as text."""
    return _col(c).isNotNull() & ~_col(c).isin(K.NULL_TOKENS)


def usable(c: Column | str) -> Column:
    """not null and not blank after whitespace collapse."""
    return _col(c).isNotNull() & (F.length(collapse_ws(c)) > 0)


def english(text: Column | str, lang: Column | str) -> Column:
    """F2 given a language column: non-empty, at least 3 characters, 'en'.
    The cheap language test comes first (AND short-circuits), and the text
    expression is evaluated once."""
    return (_col(lang) == F.lit("en")) & bind(_col(text), lambda t: t.isNotNull() & (F.length(t) >= 3))


def tokens(c: Column | str) -> Column:
    """Word tokens for T25 / the classifier: lower-cased Unicode words."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[\\p{L}\\p{N}_']+"), 0)


def token_window(toks: Column | str, size: int = K.TOKEN_WINDOW, pad: str = K.PAD_TOKEN) -> Column:
    """Truncate to ``size`` tokens and right-pad with ``pad``."""
    t = F.slice(_col(toks), 1, size)
    return F.concat(t, F.array_repeat(F.lit(pad), F.lit(size) - F.size(t)))
