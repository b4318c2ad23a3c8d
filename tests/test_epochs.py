"""Training by epochs against the same steps in plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quire.operators import epochs as ep
from quire.operators import model as ml
from quire.plans.catalog import QUERIES

SCHEMA = "key long, text string, label_id int"


def rows(n=120, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        label = rng.randint(0, 1)
        words = [rng.choice(["red", "blue", "green"] + (["robot"] if label else ["human"])) for _ in range(rng.choice([0, 1, 4, 9]))]
        out.append((i, " ".join(words) if i % 10 else None, label))
    return out


def plain(train, val, epochs, steps, rate):
    """[(tp, fp, fn, tn)] after each epoch, and all weights."""
    w, squares, evals, kept = np.zeros(ep.NUM_FEATURES + 1), np.zeros(ep.NUM_FEATURES + 1), [], []

    def margin(features):
        return w[features].sum() / max(len(features), 1) ** 0.5 + w[ep.NUM_FEATURES]

    for _ in range(epochs):
        for step in range(steps):
            mine = [r for r in train if r.batch == step]
            g = np.zeros(ep.NUM_FEATURES + 1)
            for r in mine:
                error = 1 / (1 + np.exp(-margin(r.features))) - r.label_id
                for f in r.features:
                    g[f] += error / len(r.features) ** 0.5
                g[ep.NUM_FEATURES] += error
            if mine:
                g /= len(mine)
                squares += g * g
                w = w - rate * g / np.sqrt(squares + 1e-12)
        pred = [(int(margin(r.features) > 0), r.label_id) for r in val]
        evals.append(tuple(pred.count(x) for x in ((1, 1), (1, 0), (0, 1), (0, 0))))
        kept.append(w)
    return evals, kept


def test_epochs_equal_plain_steps(spark, tmpdir_path):
    train, val = spark.createDataFrame(rows(), SCHEMA).repartition(3), spark.createDataFrame(rows(60, 4), SCHEMA)
    weights, evals = ep.fit_epochs(train, val, epochs=3, steps=2)
    batch = F.pmod(F.xxhash64("key"), F.lit(2)).alias("batch")
    want, kept = plain(ep.hashed_tokens(train).select("*", batch).collect(), ep.hashed_tokens(val).collect(), 3, 2, ep.RATE)
    got = evals.orderBy("epoch").collect()
    assert [(r.tp, r.fp, r.fn, r.tn) for r in got] == want
    best = [r for r in got if r.restored]
    assert len(best) == 1 and best[0].f1 == max(r.f1 for r in got) and best[0].epoch == min(r.epoch for r in got if r.f1 == best[0].f1)
    assert np.allclose(weights, kept[best[0].epoch - 1])
    ep.save_weights(spark, weights, f"{tmpdir_path}/w")
    again = ep.load_weights(spark, f"{tmpdir_path}/w")
    assert np.array_equal(again, weights)
    m = ml.binary_metrics(ml.predictions(ep.linear_scorer(again)(val))).first()
    assert m.f1 == best[0].f1


def test_gradient_is_that_of_the_loss(spark):
    df = ep.hashed_tokens(spark.createDataFrame(rows(30), SCHEMA))
    w = np.zeros(ep.NUM_FEATURES + 1)
    g, n = ep.gradient(df, w)
    assert n == 30

    def loss(x):
        p = np.array([r.probs[1] for r in ep.linear_scorer(x)(df).orderBy("key").collect()])
        y = np.array([r[2] for r in rows(30)])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    for f in [int(np.argmax(np.abs(g[:-1]))), ep.NUM_FEATURES]:
        step = np.zeros_like(w)
        step[f] = 1e-4
        assert (loss(step) - loss(-step)) / 2e-4 == pytest.approx(g[f], rel=1e-4)


def test_without_training_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    weights, evals = ep.fit_epochs(none, spark.createDataFrame(rows(20), SCHEMA), epochs=2, steps=2)
    assert not weights.any() and [r.tp for r in evals.collect()] == [0, 0]
    assert [r.restored for r in evals.orderBy("epoch").collect()] == [True, False]
    _, evals = ep.fit_epochs(none, none, epochs=1, steps=1)
    assert evals.count() == 1
    assert ep.linear_scorer(weights)(none).collect() == []


def test_query(spark):
    got = QUERIES["train_epochs"](spark, SF_SMALL).collect()
    assert sorted(r.epoch for r in got if r.split == "val") == list(range(1, ep.EPOCHS + 1))
    assert {r.split for r in got} >= {"val", "test"} and sum(r.restored for r in got if r.split == "val") == 1
