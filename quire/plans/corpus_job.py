"""The corpus validation job over a table of model responses.

Inputs are DataFrames, so responses can come from files, a table or a
stream sink: ``responses(batch_id, raw, phase)`` with ``phase`` 'main' or
'recovery', and ``profiles(batch_id, pos, topic, length_name, min_chars,
max_chars, form, casual_style)``. Batch ids order the attempts, positions
order the posts inside a batch.

Steps: envelope parse + arity check (failed batches -> dead letters), zip
posts with profiles by position, row-local verdict, then the greedy ordered
acceptance with the near-duplicate, opening, length, topic, question and
total-target rules, then the reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import constants as K
from quire.functions import parse as ps
from quire.functions import text as tx
from quire.operators import greedy as gr
from quire.operators import quota as qt
from quire.operators import reports as rp
from quire.operators import similarity as sim
from quire.session import cut_lineage
from quire.sources import io


def validate_corpus(responses: DataFrame, profiles: DataFrame, topics: DataFrame, total: int,
                    question_marker: str = "?", bucket_batches: int = 64,
                    fail_on_shortfall: bool = False) -> dict[str, DataFrame]:
    """``topics`` has one column ``topic`` (the topic list); ``total`` is
    the number of posts wanted. With ``fail_on_shortfall`` an unmet target
    raises ``QuotaNotMet`` (A11), as the reference does."""
    spark = responses.sparkSession
    n_prof = profiles.groupBy("batch_id").agg(F.count("*").alias("expected"))
    env = responses.join(n_prof, "batch_id").withColumn("e", ps.parse_envelope("raw", "expected"))
    # Failed batches with their reason, the first 500 characters of the
    # response and the batch's profiles (a batch holds a bounded number)
    prof_json = profiles.groupBy("batch_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(
        "pos", "topic", "length_name", "min_chars", "max_chars", "form", "casual_style")))).alias("profiles"))
    dead = env.filter(F.col("e.error").isNotNull()).join(prof_json, "batch_id").select(
        "batch_id", "phase", F.col("e.error").alias("reason"), F.substring("raw", 1, 500).alias("raw"), "profiles")
    items = env.filter(F.col("e.error").isNull()).select(
        "batch_id", "phase", F.posexplode("e.posts").alias("pos", "item"))
    items = items.select("batch_id", "phase", F.col("pos").cast("bigint").alias("pos"),
                         ps.variant_text("item").alias("raw_text"))
    posts = items.join(profiles, ["batch_id", "pos"])  # J2: positional zip
    posts = posts.withColumn("key", io.stride_key("batch_id", "pos"))
    posts = posts.withColumn("verdict", tx.row_verdict("raw_text", "min_chars", "max_chars"))
    posts = posts.withColumn("text", tx.collapse_ws(F.coalesce("raw_text", F.lit(""))))

    one = spark.range(1).select(F.lit(total).cast("bigint").alias("_total"))
    len_t = qt.proportional_targets(qt.bands_table(spark), one).select(
        F.col("value").alias("length_name"), F.col("target").alias("cap_length"))
    top_t = qt.even_targets(topics, "topic", one, "topic").select(
        F.col("value").alias("topic"), F.col("target").alias("cap_topic"))
    q_cap = qt.question_cap(one).select(F.col("target").alias("cap_question"))

    c = posts.withColumn("opening", tx.opening_key("text")).withColumn("has_opening", F.col("opening") != "")
    c = c.withColumn("is_question", F.coalesce(F.col("raw_text").contains(question_marker), F.lit(False)))
    c = c.withColumn("bucket", F.floor(F.col("batch_id") / bucket_batches))
    c = sim.with_keys(c, "text")
    c = (c.join(F.broadcast(len_t), "length_name").join(top_t, "topic", "left")
         .withColumn("cap_topic", F.coalesce("cap_topic", F.lit(0)))
         .crossJoin(F.broadcast(q_cap)).withColumn("cap_total", F.lit(total).cast("bigint"))
         .withColumn("cap_opening", F.lit(K.OPENING_CAP)))
    c = cut_lineage(c)
    valid = c.filter(F.col("verdict") == "ok")
    je, ce = sim.jaccard_edges(valid), sim.char_edges(valid)
    final = gr.accept(c, "key", "bucket", je, ce)
    dec = gr.explain_rejections(final, "key", "bucket", je, ce).join(
        final.select("key", "phase", "text", "topic", "length_name", "form", "casual_style"), "key")
    dec = cut_lineage(gr.with_phase_prefix(dec))
    accepted = dec.filter(F.col("decision") == "accepted")
    wanted = spark.range(1).select(F.lit("total").alias("quota"), F.lit(total).cast("bigint").alias("requested"))
    got = accepted.agg(F.count("*").alias("available")).withColumn("quota", F.lit("total"))
    short = rp.shortfall(wanted, got, ["quota"])
    if fail_on_shortfall:
        rp.require_no_shortfall(short, "accepted posts")
    return {
        "shortfall": short,
        "accepted": accepted.select("key", "text", F.lit("ai").alias("label")),
        "decisions": dec.select("key", "phase", "decision", "reason"),
        "dead_letters": dead,
        "rejection_counts": gr.rejection_counts(dec),
        "milestones": gr.milestones(dec, "key"),
        "lengths": rp.length_min_median_max(accepted, "text"),
        "surface": rp.surface_counts(accepted, "text", question_marker),
        "coverage": rp.distribution(accepted, {
            "target_length": "length_name", "actual_length": tx.length_group("text"), "topic": "topic",
            "casual_style": "casual_style", "form": "form"}),
        "repeated_openings": rp.repeated_openings(accepted, "text"),
    }
