"""Generated-text properties: the Spark rule columns equal the reference
rules restated in plain Python, and hash ranks equal a plain window."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

import sequential as S
from quire.functions import text as tx
from quire.operators.ranking import hash_rank

FRAGMENTS = ["it's worth noting", "its worth noting", "moving forward", "real solutions", "what matters",
             "urgent issue", "both sides need to", "this is not about x it's about", "as an AI", "Topic:",
             "@someuser", "@bob", "a@b", "é@x", "#tag", "!!!!!", "?!?!?", "120 chars", "1234 characters",
             "٣ chars", "tweet 3", "post 12", "word count", "language model", "what do you think", "www.x",
             "HTTPS://x", "x", "é", " ", " ", "\n", "\t", "’", "—", "_", "9"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(FRAGMENTS), max_size=12).map(" ".join), min_size=1, max_size=10),
       st.integers(0, 60), st.integers(0, 300))
def test_flags_and_verdict_match_reference(spark, texts, lo, span):
    hi = lo + span
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = df.select(tx.quality_flags("t").alias("f"), tx.row_verdict("t", F.lit(lo), F.lit(hi)).alias("v")).collect()
    for t, r in zip(texts, got):
        assert r.f == ",".join(S.quality_flags(t)), t
        assert r.v == S.row_verdict(t, lo, hi), t


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 10**6)), min_size=1, max_size=300, unique_by=lambda x: x[1]))
def test_hash_rank_equals_window(spark, rows):
    df = spark.createDataFrame(rows, "g int, k long")
    a = hash_rank(df, ["g"], "k", 42).select("g", "k", "rnk")
    w = Window.partitionBy("g").orderBy(F.md5(F.concat_ws(":", F.lit("42"), F.col("k").cast("string"))), "k")
    b = df.select("g", "k", F.row_number().over(w).cast("bigint").alias("rnk"))
    assert sorted(a.collect()) == sorted(b.collect())
