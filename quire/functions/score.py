"""Scoring Column functions: logits -> probabilities -> scores and buckets
(T15-T24, M1, M2). Pure higher-order array expressions, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_signed(c: Column | str, digits: int = 4) -> Column:
    """T22 ``round``: like Python's, a small negative value rounds to -0.0
    (printed ``-0.0000``); Spark's ``round`` would drop the sign."""
    x = _col(c)
    r = F.round(x, digits)
    return F.when((r == 0) & (x < 0), F.lit(-0.0)).otherwise(r)


def softmax(logits: Column | str) -> Column:
    """Numerically stable softmax over an array of doubles."""
    lg = _col(logits)
    m = F.array_max(lg)
    ex = F.transform(lg, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def argmax(arr: Column | str) -> Column:
    """Index of the first maximum (0-based), like ``np.argmax``."""
    a = _col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("bigint")


def class_map(names: list[str], probs: Column | str) -> Column:
    """Class name -> probability map (extra names are ignored,
    missing names are absent and defaulted at lookup)."""
    p = _col(probs)
    n = F.least(F.size(p), F.lit(len(names)))
    return F.map_from_arrays(F.slice(F.array(*[F.lit(x) for x in names]), 1, n), F.slice(p, 1, n))


def prob(m: Column | str, name: str, default: float) -> Column:
    """``by_label.get(name, default)``."""
    return F.coalesce(F.try_element_at(_col(m), F.lit(name)), F.lit(default).cast("double"))


def round_map(m: Column | str, digits: int = 4) -> Column:
    """Round every map value."""
    return F.transform_values(_col(m), lambda k, v: F.round(v, digits))


def sentiment_label(score: Column | str) -> Column:
    """Bucket of the unrounded scale score; NaN falls through to the
    top bucket (as in Python), null stays null."""
    s = _col(score)
    out = None
    for name, op, thr in K.SENTIMENT_BUCKETS:
        cond = (s <= thr) if op == "<=" else (s < thr)
        cond = cond & ~F.isnan(s)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return F.when(s.isNull(), F.lit(None).cast("string")).otherwise(out.otherwise(F.lit(K.SENTIMENT_TOP)))


def ai_label(score: Column | str) -> Column:
    """Bucket of the rounded AI likelihood; NaN -> likely human (JS
    comparison semantics), null stays null."""
    s = _col(score)
    out = None
    for name, thr in K.AI_BUCKETS:
        cond = (s >= thr) & ~F.isnan(s)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return F.when(s.isNull(), F.lit(None).cast("string")).otherwise(out.otherwise(F.lit(K.AI_BOTTOM)))


def to_percent_scale(score: Column | str) -> Column:
    """-1..1 -> 0..100."""
    return (_col(score) + 1) / 2 * 100


def fixed4(c: Column | str, signed: bool = False) -> Column:
    """``%.4f`` / ``%+.4f`` text."""
    return F.format_string("%+.4f" if signed else "%.4f", _col(c))


def sentiment_struct(text: Column | str, logits: Column | str) -> Column:
    """M1: {text, scale_score, scale_label, raw_scores} from 3 logits."""
    probs = softmax(logits)
    m = class_map(K.SENTIMENT_CLASSES, probs)
    raw = prob(m, "positive", 0.0) - prob(m, "negative", 0.0)
    return F.struct(
        _col(text).alias("text"),
        round_signed(raw, 4).alias("scale_score"),
        sentiment_label(raw).alias("scale_label"),
        round_map(m).alias("raw_scores"),
    )


def detection_struct(text: Column | str, logits: Column | str) -> Column:
    """M2: {text, ai_likelihood, raw_scores} from 2 logits."""
    probs = softmax(logits)
    m = class_map(K.ID_TO_LABEL, probs)
    return F.struct(
        _col(text).alias("text"),
        F.round(prob(m, "ai", float("nan")), 4).alias("ai_likelihood"),
        round_map(m).alias("raw_scores"),
    )
