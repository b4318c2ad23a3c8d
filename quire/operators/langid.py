"""Language identification (L1) as a distributed character-trigram model.

Training: trigram counts per language from labelled texts (one aggregate).
Scoring: every trigram of a document contributes the smoothed log-probability
``ln((c + 1) / (T_lang + V))`` for each language; unseen trigrams contribute
the language's floor ``ln(1 / (T_lang + V))``. Log-probabilities are stored as
integers (micro-nats) so the per-document sums are exact in any engine.

A document's score is ``n_trigrams * floor(lang) + sum over its trigrams of
(logp - floor)``. For scoring the model is packed: one row per trigram with a
column of gains per language (a bounded label set). It is sent to all tasks
while its counted rows are few, else joined by a shuffle; with it at hand, the
trigrams of a document are looked up and summed where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

SCALE = 1_000_000
#: Trigrams of a packed model that is sent to all tasks (a number and one per language each).
BROADCAST_TRIGRAMS = 500_000


TRIGRAM_RE = "(?s)(?=(.{3}))"


def trigrams(text: Column) -> Column:
    """All overlapping 3-code-point substrings of the whole text, in order.
    One linear regex pass (a zero-width lookahead capture at every position);
    per-position ``substring`` would rescan the UTF-8 text each time."""
    return F.when(F.length(text) >= 3, F.regexp_extract_all(text, F.lit(TRIGRAM_RE), 1))


def doc_trigram_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """(id[, lang], g, cnt) with map-side combining of repeated trigrams.
    ``g`` is a 64-bit hash of the trigram: aggregations and the model join
    then move longs, not strings (the trigram vocabulary is far too small
    for 64-bit collisions to matter)."""
    keys = [id_col] + ([lang_col] if lang_col else [])
    ex = docs.select(*keys, F.explode(trigrams(F.col(text_col))).alias("t"))
    return ex.groupBy(*keys, F.xxhash64("t").alias("g")).agg(F.count("*").alias("cnt"))


def train_from_counts(dg: DataFrame, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """Returns (model: lang, g, logp, langs: lang, floor) from per-document
    trigram counts. ``langs`` has one row per language — bounded by the
    label set — and is broadcast."""
    counts = dg.groupBy(lang_col, "g").agg(F.sum("cnt").alias("c")).persist()  # vocab, totals, model
    vocab = counts.select("g").distinct().agg(F.count("*").alias("_v"))
    totals = counts.groupBy(lang_col).agg(F.sum("c").alias("_t"))
    langs = totals.crossJoin(F.broadcast(vocab)).select(
        F.col(lang_col).alias("lang"), "_t", "_v",
        F.round(F.log(F.lit(1.0) / (F.col("_t") + F.col("_v"))) * SCALE).cast("bigint").alias("floor"))
    model = counts.join(F.broadcast(langs.select(F.col("lang").alias(lang_col), "_t", "_v")), lang_col).select(
        F.col(lang_col).alias("lang"), "g",
        F.round(F.log((F.col("c") + 1.0) / (F.col("_t") + F.col("_v"))) * SCALE).cast("bigint").alias("logp"))
    return model, langs.select("lang", "floor")


def train(labelled: DataFrame, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    ex = labelled.select(lang_col, F.explode(trigrams(F.col(text_col))).alias("t"))
    return train_from_counts(ex.groupBy(lang_col, F.xxhash64("t").alias("g")).agg(F.count("*").alias("cnt")),
                             lang_col)


def packed_model(model: DataFrame, langs: DataFrame) -> tuple[DataFrame, list[tuple[str, int]]]:
    """(g, gain_0, gain_1, ...) and the (language, floor) of each number, by name."""
    names = [(r.lang, r.floor) for r in langs.orderBy("lang").collect()]  # the label set
    gains = [F.sum(F.when(F.col("lang").eqNullSafe(F.lit(name)), F.col("logp") - floor).otherwise(0)).alias(f"gain_{i}") for i, (name, floor) in enumerate(names)]
    return cut_lineage(model.groupBy("g").agg(*gains)) if gains else model.select("g").limit(0), names


def predict_from_counts(dg: DataFrame, id_col: str, model: DataFrame, langs: DataFrame) -> DataFrame:
    """(id, predicted, n_trigrams, score) from (id, g, cnt). Ties go to the
    smaller language name; without languages there are no rows."""
    packed, names = packed_model(model, langs)
    near = F.broadcast(packed) if packed.count() <= BROADCAST_TRIGRAMS else packed
    sums = [F.coalesce(F.sum(F.col("cnt") * F.col(f"gain_{i}")), F.lit(0)).alias(f"gain_{i}") for i in range(len(names))]
    docs = dg.select(id_col, "g", "cnt").join(near, "g", "left").groupBy(id_col).agg(F.sum("cnt").cast("bigint").alias("n_trigrams"), *sums)
    scores = F.array(*[(F.col("n_trigrams") * floor + F.col(f"gain_{i}")).cast("bigint") for i, (_, floor) in enumerate(names)] or [F.lit(0).cast("bigint")])
    every = F.array(*[F.lit(name) for name, _ in names] or [F.lit("")])
    out = docs.select(id_col, "n_trigrams", scores.alias("_s"), every.alias("_l")).where(F.lit(bool(names)))
    best = F.array_max("_s")
    return out.select(id_col, F.element_at("_l", F.array_position("_s", best).cast("int")).alias("predicted"), "n_trigrams", best.alias("score"))


def predict(docs: DataFrame, id_col: str, text_col: str, model: DataFrame, langs: DataFrame) -> DataFrame:
    """Score unlabelled texts (texts shorter than 3 characters get none)."""
    found = docs.select(id_col, F.explode(trigrams(F.col(text_col))).alias("t")).select(id_col, F.xxhash64("t").alias("g"), F.lit(1).cast("bigint").alias("cnt"))
    return predict_from_counts(found, id_col, model, langs)


def language_filter(model: DataFrame, langs: DataFrame, keep: str = "en", id_col: str = "seq",
                    text_col: str = "text", min_chars: int = 3):
    """F2 with an inferred language: a callable DataFrame -> DataFrame that
    keeps rows of at least ``min_chars`` characters predicted as ``keep``
    (``id_col`` must be unique). Usable as ``prepare_dataset(english=...)``."""

    def apply(df: DataFrame) -> DataFrame:
        cand = df.filter(F.length(text_col) >= min_chars)
        hits = predict(cand.select(id_col, F.lower(F.col(text_col)).alias("_t")), id_col, "_t", model, langs).filter(F.col("predicted") == keep).select(id_col)
        return cand.join(hits, id_col, "left_semi")

    return apply
