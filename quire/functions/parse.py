"""Batch-response parsing (T26-T29): strict JSON array, fenced, bracket span,
and the v3 ``{"posts": [...]}`` envelope with arity check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_ARR = "array<string>"
# Fixed patterns (v2 fence strip and bracket span)
FENCE_OPEN_RE = r"^```(?i:json)?\s*"
FENCE_CLOSE_RE = r"\s*```$"
BRACKET_RE = r"(?s)\[.*\]"


def strip_ws_edges(c: Column) -> Column:
    """Python ``str.strip()`` (Unicode whitespace at both ends)."""
    from quire.functions.text import strip_ws

    return strip_ws(c)


def _json_array(c: Column, least: int = 0) -> Column:
    """Parse a JSON array of values into strings; null when the text is not
    an array, or has fewer than ``least`` items. A non-array value (``{}``,
    ``"s"``, ``1``) also gives null."""
    t = strip_ws_edges(c)
    parsed = F.from_json(t, _ARR)
    return F.when(t.startswith("[") & (F.size(parsed) >= least), parsed)


def strip_fences(c: Column | str) -> Column:
    """T27 (v2): anchored, case-insensitive opening fence with optional
    ``json`` tag, and a closing fence; only when the text starts with one."""
    t = strip_ws_edges(_col(c))
    stripped = F.regexp_replace(F.regexp_replace(t, FENCE_OPEN_RE, ""), FENCE_CLOSE_RE, "")
    return F.when(t.startswith("```"), stripped).otherwise(t)


def bracket_span(c: Column | str) -> Column:
    """First ``[`` through last ``]``."""
    return F.regexp_extract(_col(c), BRACKET_RE, 0)


def parse_batch(raw: Column | str) -> Column:
    """T26-T28 (v2 order): raw parse, then fence strip, then bracket span.
    An empty list counts as a failure. Null when all three fail (a failed
    batch for the dead-letter sink)."""
    r = strip_ws_edges(F.coalesce(_col(raw), F.lit("")))
    fenced = strip_fences(r)
    span = bracket_span(fenced)
    return F.coalesce(
        _json_array(r, 1),
        _json_array(fenced, 1),
        F.when(F.length(span) > 0, _json_array(span, 1)),
    )


def strip_fences_v1(c: Column | str) -> Column:
    """T27 (v1): when the text starts with a fence, strip every backtick at
    both ends, then a leading ``json``, then surrounding whitespace."""
    t = strip_ws_edges(_col(c))
    unticked = F.regexp_replace(t, "^`+|`+$", "")
    dropped = F.when(unticked.startswith("json"), F.substring(unticked, 5, 1 << 30)).otherwise(unticked)
    return F.when(t.startswith("```"), strip_ws_edges(dropped)).otherwise(t)


def parse_batch_v1(raw: Column | str) -> Column:
    """T26-T28 (v1 order): fence strip first, then a strict parse, then the
    bracket span. An empty list is a success."""
    t = strip_fences_v1(F.coalesce(_col(raw), F.lit("")))
    span = bracket_span(t)
    return F.coalesce(_json_array(t), F.when(F.length(span) > 0, _json_array(span)))


def parse_envelope(raw: Column | str, expected: Column | str) -> Column:
    """T29 (v3): ``posts`` must be a list with exactly ``expected`` items.
    Returns struct(posts ARRAY<VARIANT>, error STRING); items keep their JSON
    type so non-strings can be rejected as ``not_a_string`` later (P4)."""
    v = F.try_parse_json(_col(raw))
    posts = F.try_variant_get(v, "$.posts", "array<variant>")
    n = F.size(posts)
    error = (
        F.when(v.isNull(), F.lit("invalid_json"))
        .when(posts.isNull(), F.lit("missing_posts"))
        .when(n != _col(expected), F.lit("wrong_arity"))
    )
    return F.struct(F.when(error.isNull(), posts).alias("posts"), error.alias("error"))


def variant_text(v: Column | str) -> Column:
    """A VARIANT item as text when it is a JSON string, else null."""
    x = _col(v)
    return F.when(F.schema_of_variant(x) == F.lit("STRING"), F.variant_get(x, "$", "string"))
