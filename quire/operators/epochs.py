"""Classifier training by epochs (M3): warm-started distributed gradient steps.

A logistic model over hashed tokens. Each epoch takes STEPS mini-batches (rows
dealt by a hash of their key); the tasks sum the gradient of their rows, Spark
adds the sums up by feature, and an Adagrad step changes the weights. After each
epoch validation metrics are taken, and the weights of the epoch with the
highest F1 (ties: the earliest) are the result. Rows stay distributed; what
travels is at most one weight and one gradient a feature (NUM_FEATURES), at any
number of rows.

Defined results: a text without tokens has only the bias; null texts count as
empty; without training rows all weights are 0 and every row is class 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as tx
from quire.operators import model as ml

NUM_FEATURES = 1 << 18  # hashed tokens; the bias is one more
EPOCHS, STEPS, RATE = 5, 4, 0.1
SPARSE = "feature int, value double"


def hashed_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``features``: the distinct hashes of a text's tokens."""
    tokens = tx.tokens(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("features", F.array_distinct(F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(NUM_FEATURES)).cast("int"))))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each feature, features, value of each: rows have length 1)."""
    lengths = np.diff(column.offsets.to_numpy())
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return rows, column.flatten().to_numpy(), (1 / np.sqrt(np.maximum(lengths, 1)))[rows]


def _probability(weights: np.ndarray, column: pa.Array) -> np.ndarray:
    rows, features, values = _flat(column)
    margin = np.bincount(rows, weights[features] * values, len(column)) + weights[NUM_FEATURES]
    return 1 / (1 + np.exp(-np.clip(margin, -ml.MOST_LOGIT, ml.MOST_LOGIT)))


def _gradient(weights: np.ndarray):
    """(features, label_id) -> one row a feature that a task's rows touch, and
    their number as feature -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(NUM_FEATURES + 1), 0
        for b in batches:
            rows, features, values = _flat(b.column(0))
            error = _probability(weights, b.column(0)) - b.column(1).to_numpy()
            total += np.bincount(features, error[rows] * values, NUM_FEATURES + 1)
            total[NUM_FEATURES] += error.sum()
            n += b.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n))], ["feature", "value"])
    return run


def linear_scorer(weights: np.ndarray) -> ml.Scorer:
    """M4: ``probs`` of texts by a weight vector, loaded once per task."""
    def score(df: DataFrame) -> DataFrame:
        rows = df if "features" in df.columns else hashed_tokens(df)
        at = rows.columns.index("features")
        names = [*rows.columns, "probs"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = _probability(weights, b.column(at))
                probs = pa.ListArray.from_arrays(np.arange(0, 2 * len(p) + 1, 2, dtype=np.int32), np.column_stack([1 - p, p]).ravel())
                yield pa.RecordBatch.from_arrays([*b.columns, probs], names)

        schema = T.StructType([*rows.schema.fields, T.StructField("probs", T.ArrayType(T.DoubleType()))])
        return rows.mapInArrow(run, schema).drop("features")
    return score


def gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """Summed gradient of the log loss over rows (features, label_id), and their number."""
    sums = rows.select("features", F.col("label_id").cast("double")).mapInArrow(_gradient(weights), SPARSE)
    got = sums.groupBy("feature").agg(F.sum("value").alias("value")).toPandas()  # at most one row a feature
    at, value = got["feature"].to_numpy(), got["value"].to_numpy()
    out = np.zeros(NUM_FEATURES + 1)
    out[at[at >= 0]] = value[at >= 0]
    return out, int(value[at < 0].sum())


def fit_epochs(train: DataFrame, val: DataFrame, epochs: int = EPOCHS, steps: int = STEPS, rate: float = RATE,
               key: str = "key") -> tuple[np.ndarray, DataFrame]:
    """(weights of the best epoch, validation metrics with a row an epoch and
    ``restored`` on the best). Each epoch goes on from the weights of the one
    before. ``train`` and ``val`` hold key, text, label_id."""
    spark = train.sparkSession
    batch = F.pmod(F.xxhash64(F.col(key)), F.lit(steps)).alias("batch")
    rows = hashed_tokens(train).select("features", "label_id", batch).persist()
    checked = hashed_tokens(val).select("features", "label_id").persist()
    weights, squares = np.zeros(NUM_FEATURES + 1), np.zeros(NUM_FEATURES + 1)
    best, evals = (-1.0, 0, weights), []
    for epoch in range(1, epochs + 1):
        for step in range(steps):
            g, n = gradient(rows.filter(F.col("batch") == step), weights)
            if n:
                g /= n
                squares += g * g
                weights = weights - rate * g / np.sqrt(squares + 1e-12)
        row = ml.binary_metrics(ml.predictions(linear_scorer(weights)(checked))).first()
        evals.append((epoch, *row))
        if row.f1 > best[0]:
            best = (row.f1, epoch, weights)
    rows.unpersist()
    checked.unpersist()
    schema = "epoch int, tp long, fp long, fn long, tn long, accuracy double, precision double, recall double, f1 double"
    return best[2], spark.createDataFrame(evals, schema).withColumn("restored", F.col("epoch") == best[1])


def save_weights(spark: SparkSession, weights: np.ndarray, path: str) -> None:
    """M3: the weights other than 0, by feature."""
    at = np.flatnonzero(weights)
    table = pa.table({"feature": pa.array(at, pa.int32()), "value": pa.array(weights[at])})
    spark.createDataFrame(table).select(F.col("feature").cast("int"), "value").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> np.ndarray:
    """M4: the weights as written; at most one row a feature."""
    got = spark.read.schema(SPARSE).parquet(path).toPandas()
    out = np.zeros(NUM_FEATURES + 1)
    out[got["feature"].to_numpy()] = got["value"].to_numpy()
    return out
