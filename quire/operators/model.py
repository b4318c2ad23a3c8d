"""Text classifier training, selection and scoring.

The reference fine-tunes a transformer on one machine. Here the same job —
fit on train, pick the best candidate by F1 on validation, report accuracy /
precision / recall / F1 on test and on a held-out source — runs as an MLlib
pipeline (tokenize -> hashed term frequencies -> IDF -> logistic
regression), distributed over the executors.

``Scorer`` is the swap point: anything mapping a DataFrame with ``text`` to
the same DataFrame plus ``probs ARRAY<DOUBLE>`` (class 0 = human, 1 = ai).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool
from typing import Protocol

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import score as sc
from quire.functions import text as tx

NUM_FEATURES = 1 << 18
TOKEN_PATTERN = "[\\p{L}\\p{N}_']+"


class Scorer(Protocol):
    def __call__(self, df: DataFrame) -> DataFrame: ...


def featurizer() -> Pipeline:
    """Tokens of the whole text -> hashed TF -> IDF. Term counts need no
    token window; T25 is an operator of its own."""
    tok = RegexTokenizer(inputCol="text", outputCol="tokens", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True)
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=NUM_FEATURES)
    idf = IDF(inputCol="tf", outputCol="features")
    return Pipeline(stages=[tok, tf, idf])


def classifier(reg_param: float, max_iter: int = 30) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label_id", regParam=reg_param, maxIter=max_iter)


def save(model: PipelineModel, path: str) -> None:
    """M3: write the fitted pipeline, features and classifier together."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """M4: the pipeline as written."""
    return PipelineModel.load(path)


def mllib_scorer(model: PipelineModel) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        return out.withColumn("probs", vector_to_array("probability")).drop(
            "tokens", "tf", "features", "rawPrediction", "probability", "prediction")
    return score


def pandas_scorer(make_fn: Callable[[], Callable[[pd.Series], pd.DataFrame]]) -> Scorer:
    """A user model through ``mapInPandas``: ``make_fn`` runs once per
    partition iterator (load the model there), the returned function maps a
    batch of texts to a frame with columns p_human, p_ai."""

    def score(df: DataFrame) -> DataFrame:
        schema = T.StructType(df.schema.fields + [T.StructField("probs", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fn = make_fn()
            for b in batches:
                p = fn(b["text"])
                b = b.copy()
                b["probs"] = [[float(h), float(a)] for h, a in zip(p["p_human"], p["p_ai"])]
                yield b

        return df.mapInPandas(run, schema)
    return score


def predictions(scored: DataFrame) -> DataFrame:
    """Predicted class = first argmax of the probabilities."""
    p = F.col("probs")
    return scored.withColumn("pred", (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def binary_metrics(df: DataFrame, label: str = "label_id", pred: str = "pred",
                   group: list[str] | None = None) -> DataFrame:
    """Accuracy and precision / recall / F1 for class 1; a zero
    denominator gives 0 (sklearn's zero_division behaviour)."""
    t, p = F.col(label) == 1, F.col(pred) == 1
    g = df.groupBy(*(group or []))
    c = g.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
              F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))

    def safe(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))

    return c.select(*(group or []), "tp", "fp", "fn", "tn",
                    safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(tp, tp + fp).alias("precision"),
                    safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def best_by_f1(evals: DataFrame, id_col: str) -> DataFrame:
    """The candidate with the highest F1 (ties: smallest id)."""
    return evals.agg(F.max_by(F.col(id_col), F.struct(F.col("f1"), -F.col(id_col))).alias(id_col))


def fit_select(train: DataFrame, val: DataFrame, reg_params: list[float]) -> tuple[PipelineModel, DataFrame]:
    """M3: fit the featurizer once, one classifier per candidate on the
    cached features, evaluate each on validation, keep the best by F1.
    Returns (best model as one PipelineModel, validation metrics)."""
    feats = featurizer().fit(train)
    train_f = feats.transform(train).select("features", "label_id").cache()
    val_f = feats.transform(val).cache()
    # candidates are fitted from concurrent threads (as TrainValidationSplit
    # does with ``parallelism``): each fit is a chain of small jobs, so
    # running them side by side keeps the executors busy
    with ThreadPool(max(1, len(reg_params))) as pool:
        fitted = pool.map(lambda rp: classifier(rp).fit(train_f), reg_params)
    models, evals = {}, None
    for i, (rp, lr) in enumerate(zip(reg_params, fitted)):
        models[i] = lr
        scored = lr.transform(val_f).withColumn("probs", vector_to_array("probability"))
        e = binary_metrics(predictions(scored)).withColumn("candidate", F.lit(i)).withColumn("reg_param", F.lit(rp))
        evals = e if evals is None else evals.unionByName(e)
    evals = evals.cache()  # a few rows per candidate
    best = best_by_f1(evals, "candidate").first()[0]
    train_f.unpersist()
    val_f.unpersist()
    return PipelineModel(stages=[*feats.stages, models[best]]), evals


# ---------------------------------------------------------------------------
# Count-based classifier
# ---------------------------------------------------------------------------
ODDS_SCALE = 1_000_000


def token_log_odds(train: DataFrame, text: str = "text", label: str = "label_id") -> DataFrame:
    """(token, odds): add-one log odds of class 1 against class 0 for every
    token of the training texts, as integers (millionths), so sums are exact in
    any engine. One aggregate; the vocabulary stays a table."""
    counts = train.select(F.explode(tx.tokens(F.col(text))).alias("token"), label).groupBy("token").agg(
        F.count_if(F.col(label) == 1).alias("c1"), F.count_if(F.col(label) == 0).alias("c0"))
    totals = counts.agg(F.sum("c1").alias("t1"), F.sum("c0").alias("t0"), F.count("*").alias("v"))
    odds = F.log((F.col("c1") + 1.0) / (F.col("t1") + F.col("v"))) - F.log((F.col("c0") + 1.0) / (F.col("t0") + F.col("v")))
    return counts.crossJoin(F.broadcast(totals)).select("token", F.round(odds * ODDS_SCALE).cast("bigint").alias("odds"))


def score_log_odds(df: DataFrame, model: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """``df`` with ``score``: the sum of its tokens' odds, unknown tokens 0.
    Tokens meet the model where the texts are read; a model too large to be
    sent there is joined by token."""
    tokens = df.select(key, F.explode(tx.tokens(F.col(text))).alias("token"))
    sums = tokens.join(model, "token").groupBy(key).agg(F.sum("odds").alias("score"))
    return df.join(sums, key, "left").withColumn("score", F.coalesce("score", F.lit(0)))


def save_log_odds(model: DataFrame, path: str) -> None:
    """M3: write the count-based model."""
    model.write.mode("overwrite").parquet(path)


def load_log_odds(spark: SparkSession, path: str) -> DataFrame:
    """M4: the count-based model as written."""
    return spark.read.schema("token string, odds bigint").parquet(path)


BLANK = "No text provided"   # the error of a blank text
MOST_LOGIT = 30.0   # beyond, a likelihood is 0 or 1 to every printed digit


def detect_text(df: DataFrame, model: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """M2 + M4: ``df`` with ``score`` (0 for blank texts) and, for blank texts,
    ``error``, else ``ai_likelihood`` (softmax of 0 and the score as a logit,
    four digits) and ``ai_label``. Works on a table and on a micro-batch of a stream alike."""
    rows = df.withColumn(text, tx.strip_ws(F.coalesce(F.col(text), F.lit(""))))
    blank = F.col(text) == ""
    scored = score_log_odds(rows, model, key, text)
    logit = F.greatest(F.least(F.col("score") / ODDS_SCALE, F.lit(MOST_LOGIT)), F.lit(-MOST_LOGIT))
    probs = F.element_at(sc.softmax(F.array(F.lit(0.0), logit)), 2)
    scored = scored.withColumn("ai_likelihood", F.when(~blank, F.round(probs, 4)))
    return (scored.withColumn("ai_label", sc.ai_label("ai_likelihood"))
            .withColumn("error", F.when(blank, F.lit(BLANK))))
