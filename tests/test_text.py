"""Column functions against the edge rows of FIXTURES.md and against the
reference's Python semantics on generated Unicode text."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import sequential as S
from quire.functions import score as sc
from quire.functions import text as tx

NBSP, EMSP = " ", " "


def one(spark, col, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_clean_edges(spark):
    rows = [f"hi @élodie_1 https://x.y/z?a{NBSP}b", f"{NBSP} x{EMSP}", "@a.b@c", "\x1cfoo\x1d", "@ a",
            "https://only.url/x"]
    assert one(spark, tx.clean("v"), rows) == ["hi b", "x", ".b", "foo", "@ a", ""]


def test_normalize_and_opening(spark):
    assert one(spark, tx.normalize("v"), ["’it’s “ok”—–x", "‘a"]) == ["'it's \"ok\"--x", "‘a"]
    assert one(spark, tx.opening_key("v"), ["It’s a b", "It's a b", "", "!!"]) == ["it s a", "it's a b", "", ""]


def test_quality_flags_edges(spark):
    rows = ["abc", "abcd", "a" * 280, "a" * 281, "#a #b #c #d", "#a #b #c #d #e", "@a @b @c", "@a @b @c @d",
            "wow !?!?", "wow !?!?!", "moving forward now", "moving forward, real solutions",
            "hi @SomeUser", "Topic: x", "   "]
    got = one(spark, tx.quality_flags("v"), rows)
    assert got == ["too_short", "", "", "over_280", "", "too_many_hashtags", "", "too_many_mentions", "",
                   "punctuation_spam", "", "boilerplate", "placeholder_handle", "instruction_leak", "empty"]


def test_row_verdict_edges(spark):
    rows = ["a" * 9, "a" * 10, "a" * 55, "a" * 56, "see www.x now", "mail a@b ok", "hey @b is ok",
            "about 120 chars ok", "this is tweet 3 ok", "As an AI I think", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(tx.row_verdict("v", F.lit(10), F.lit(55))).collect()]
    assert got == ["profile_length_mismatch", "ok", "ok", "profile_length_mismatch", "contains_url", "ok",
                   "contains_handle", "metadata_leakage", "metadata_leakage", "boilerplate", "not_a_string"]


def test_sentiment_buckets(spark):
    vals = [-1.0, -0.6, -0.59999, -0.2, -0.19999, 0.0, 0.19999, 0.2, 0.59999, 0.6, 1.0, float("nan"), None]
    got = one(spark, sc.sentiment_label("v"), vals, "double")
    assert got == ["strongly negative", "strongly negative", "negative", "negative", "neutral", "neutral",
                   "neutral", "positive", "positive", "strongly positive", "strongly positive",
                   "strongly positive", None]


def test_ai_buckets_on_rounded(spark):
    vals = [0.39994, 0.39996, 0.69996, float("nan"), None]
    got = one(spark, sc.ai_label(F.round("v", 4)), vals, "double")
    assert got == ["likely human", "uncertain", "likely AI", "likely human", None]


def test_softmax_argmax(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0],), ([1000.0, 0.0, -5.0],), ([0.5, 2.0, 2.0],)], "l array<double>")
    rows = df.select(sc.softmax("l").alias("p"), sc.argmax("l").alias("a")).collect()
    assert all(abs(x - 1 / 3) < 1e-12 for x in rows[0].p)
    assert rows[1].p[0] == pytest.approx(1.0) and not any(math.isnan(x) for x in rows[1].p)
    assert [r.a for r in rows] == [0, 0, 1]
    m = df.select(sc.prob(sc.class_map(["human", "ai", "extra"], "l"), "missing", float("nan")).alias("x")).first()
    assert math.isnan(m.x)


_ALPHABET = st.sampled_from(list("ab éÉ@_#!?’“”—–'\t\n\x0b\x1c\x85") + [NBSP, EMSP, " ", "1", "٣", "https://", "www."])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(_ALPHABET, max_size=25).map("".join), min_size=1, max_size=8))
def test_unicode_parity_with_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").orderBy("i")
    got = df.select(tx.clean("v").alias("c"), tx.normalize("v").alias("n"), tx.opening_key("v").alias("o"),
                    F.array_sort(tx.word_set("v")).alias("w")).collect()
    for t, r in zip(texts, got):
        assert r.c == S.clean(t)
        assert r.n == S.normalize(t)
        assert r.o == S.opening_key(t)
        assert r.w == sorted(S.word_set(t))


def test_bind_and_keep_nonempty(spark):
    df = spark.createDataFrame([(1, "  a  b "), (2, "   "), (3, None), (4, "@x https://y")], "k int, v string")
    got = df.select("k", tx.bind(tx.collapse_ws("v"), lambda t: F.concat(t, F.lit("|"), t)).alias("b")).orderBy("k")
    assert [r.b for r in got.collect()] == ["a b|a b", "|", None, "@x https://y|@x https://y"]
    kept = tx.keep_nonempty(df, "c", tx.clean("v")).orderBy("k")
    assert [(r.k, r.c) for r in kept.collect()] == [(1, "a b")]
    assert "Generate" in kept._jdf.queryExecution().executedPlan().toString()
