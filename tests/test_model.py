"""Scorer protocol (M4): a user model through mapInPandas, then metrics."""

import pandas as pd
from pyspark.sql import functions as F

from quire.operators import model as ml


def test_pandas_scorer_and_metrics(spark):
    def _make_scorer():  # nested, so it ships by value to the Python workers
        # "loaded once per partition": a trivial length-based model
        def fn(texts: pd.Series) -> pd.DataFrame:
            p_ai = (texts.str.len() > 20).astype(float) * 0.8 + 0.1
            return pd.DataFrame({"p_human": 1 - p_ai, "p_ai": p_ai})
        return fn

    df = spark.createDataFrame([("short", 0), ("a much longer generated text", 1), ("tiny", 0), ("also long enough text", 0)],
                               "text string, label_id int")
    scored = ml.predictions(ml.pandas_scorer(_make_scorer)(df))
    assert [r.pred for r in scored.orderBy("text").collect()] == [1, 1, 0, 0]
    m = ml.binary_metrics(scored).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (1, 1, 0, 2)
    assert m.precision == 0.5 and m.recall == 1.0 and m.accuracy == 0.75
    none = ml.binary_metrics(scored.withColumn("pred", F.lit(0))).first()
    assert none.precision == 0.0 and none.f1 == 0.0


def test_tokens_meet_a_small_model_without_a_shuffle(spark):
    model = spark.createDataFrame([("a", 3), ("b", -1)], "token string, odds long")
    df = spark.createDataFrame([(1, "a a b"), (2, "c"), (3, "")], "key long, text string")
    scored = ml.score_log_odds(df, F.broadcast(model))
    assert {r.key: r.score for r in scored.collect()} == {1: 5, 2: 0, 3: 0}
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "token" in line]
