"""Streaming equals batch on the same rows; the two-pass prefix reader
equals reading chunk by chunk until the target is reached."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quire import constants as K
from quire.operators import sampling as smp
from quire.plans.catalog import QUERIES
from quire.sources.io import KEY_STRIDE


def test_stream_score_equals_batch(spark):
    a = sorted(map(tuple, QUERIES["stream_score"](spark, SF_SMALL).collect()))
    b = sorted(map(tuple, QUERIES["analyze_json"](spark, SF_SMALL).collect()))
    assert a == b and len(a) > 0


def _read_until(usable, chunk, target):
    kept, total = [], 0
    for start in range(0, len(usable), chunk):
        if total >= target:
            break
        rows = [i for i in range(start, min(start + chunk, len(usable))) if usable[i]]
        kept += rows
        total += len(rows)
    return kept


@settings(max_examples=25, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=120), st.integers(1, 20), st.integers(1, 60))
def test_prefix_until_target_equals_chunked_loop(spark, usable, chunk, target):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(usable)], "seq long, u boolean")
    got = sorted(r.seq for r in smp.prefix_until_target(df, "seq", F.col("u"), chunk, target).collect())
    assert got == _read_until(usable, chunk, target)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=120), st.integers(1, 9), st.integers(1, 60))
def test_progressive_prefix_equals_chunked_loop(spark, usable, chunk, target):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(usable)], "seq long, u boolean")
    got = sorted(r.seq for r in smp.progressive_prefix(df, "seq", lambda d: d.filter("u"), chunk, target).collect())
    assert got == _read_until(usable, chunk, target)


def test_progressive_read_leaves_files_alone(spark, tmpdir_path):
    df = spark.range(10_000).repartitionByRange(50, "id").withColumn("u", F.lit(True))
    df.write.parquet(f"{tmpdir_path}/t")
    raw = spark.read.parquet(f"{tmpdir_path}/t")
    bound = smp.progressive_bound(raw, "id", lambda d: d, 20, 300)
    assert 300 <= bound <= 600
    part = raw.filter(F.col("id") < bound)
    assert part.select(F.input_file_name()).distinct().count() <= 4
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), LessThan(id" in plan
    assert smp.progressive_prefix(raw.limit(0), "id", lambda d: d, 20, 300).count() == 0


def test_stress_sample_draws_from_all_posts(spark, tmpdir_path):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the post is number "), F.col("id")).alias("text"),
                                    F.lit("en").alias("lang"), F.lit("web").alias("source"))
    docs.write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.range(25).select(F.col("id").alias("vec_id"), F.array(*[F.lit(0.5).cast("float")] * 3).alias("embedding")).write.parquet(f"{tmpdir_path}/embeddings.parquet")
    got = {r.key for r in QUERIES["stress_sample"](spark, tmpdir_path).collect()}
    order = sorted((hashlib.md5(f"{K.SEED}:{i * KEY_STRIDE}".encode()).hexdigest(), i * KEY_STRIDE) for i in range(2000))
    assert got == {key for _, key in order[:25]} and max(got) > 1000 * KEY_STRIDE
