"""Sampling, balancing and splitting invariants."""

from pyspark.sql import functions as F

from conftest import SF_MID
from quire.operators import sampling as smp
from quire.operators.ranking import hash_rank
from quire.sources import io


def test_split_disjoint_complete_proportional(spark):
    ci = io.class_items(spark, SF_MID)
    sp = smp.stratified_split(ci, "key", "label").cache()
    assert sp.count() == ci.count()
    assert sp.select("key").distinct().count() == ci.count()
    n = ci.count()
    counts = {r.split: r.c for r in sp.groupBy("split").agg(F.count("*").alias("c")).collect()}
    assert counts["train"] == int(n * 0.8)
    assert counts["val"] == int((n - int(n * 0.8)) * 0.5)
    per = sp.groupBy("label", "split").count().collect()
    for r in per:
        if r.split == "train":
            total = ci.filter(F.col("label") == r.label).count()
            assert abs(r["count"] - total * 0.8) <= 1


def test_rank_independent_of_partitioning(spark):
    p = io.posts(spark, "/root/testdata/sf0.001").select("key", "source")
    a = hash_rank(p.repartition(1), ["source"], "key", 42).select("key", "rnk")
    b = hash_rank(p.repartition(8, "key"), ["source"], "key", 42).select("key", "rnk")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    w = p.groupBy("source").count()
    assert a.join(p, "key").groupBy("source").agg(F.max("rnk").alias("m")).join(w, "source") \
        .filter(F.col("m") != F.col("count")).count() == 0


def test_balance_and_small_class(spark):
    df = spark.createDataFrame([(i, "ai" if i < 9 else "human", "t") for i in range(10)], "key long, label string, text string")
    b = smp.balance_classes(df, "key", "label")
    assert sorted(r.label for r in b.collect()) == ["ai", "human"]


def test_even_source_sample_fill_path(spark):
    rows = [(i, "s1" if i < 3 else "s2", "t") for i in range(20)]  # s1 is short
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = smp.even_source_sample(df, "doc_id", "source", "doc_id", F.lit(11)).collect()
    assert len(out) == 11 and len({r.doc_id for r in out}) == 11
    assert sum(r.source == "s1" for r in out) == 3


def test_prefix_until_target(spark):
    df = spark.range(0, 100).withColumnRenamed("id", "seq")
    kept = smp.prefix_until_target(df, "seq", F.col("seq") % 2 == 0, 10, 12)
    # 5 usable per chunk of 10: chunks 0,1 give 10 (< 12), chunk 2 reaches 15 and is kept whole
    assert sorted(r.seq for r in kept.collect()) == list(range(0, 30, 2))


def test_null_groups_are_groups(spark):
    rows = [(i, None if i % 3 == 0 else "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, label string")
    ranked = hash_rank(df, ["label"], "key", 1).collect()
    assert len(ranked) == 60
    for g in (None, "a", "b"):
        ranks = sorted(r.rnk for r in ranked if r.label == g)
        assert ranks == list(range(1, len(ranks) + 1)) and ranks
    assert smp.stratified_split(df, "key", "label").count() == 60
