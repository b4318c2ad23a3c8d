"""Acceptance in batches against a stored index equals one run over all candidates."""

import random

import pytest
from pyspark.sql import functions as F

import sequential as S
from conftest import SF_SMALL
from quire.functions import text as tx
from quire.operators import incremental as inc
from quire.operators import similarity as sim
from quire.plans import catalog as C

CAPS = {"short": 25, "medium": 30, "long": 12}
TOPICS = {"a": 30, "b": 25}


def _rows():
    rng = random.Random(4)
    words = [w + x for w in ("tax", "vote", "plan", "city", "road", "school", "bank", "farm") for x in ("", "es", "ing", "ed")]
    rows, texts = [], []
    for key in range(120):
        if texts and rng.random() < 0.45:  # a near copy of any earlier text, of this batch or another
            w = rng.choice(texts).split()
            change = rng.randrange(4)
            if change == 0:
                w[rng.randrange(len(w))] = "zq"
            elif change == 1:
                w = [*w[1:], w[0]]  # the same word set
            elif change == 2:
                w[-1] += "s"
        else:
            w = [rng.choice(words) for _ in range(rng.randrange(2, 40))]
        text = " ".join(w) + rng.choice(["", "?", "!"])
        texts.append(" ".join(w))
        rows.append((key, text, rng.choice(list(CAPS)), rng.choice(list(TOPICS)), "ok" if rng.random() < 0.95 else "bad"))
    return rows


def _candidates(spark, rows, total=70, questions=18):
    df = spark.createDataFrame(rows, "key long, text string, length_name string, topic string, verdict string")
    t = tx.collapse_ws("text")
    df = (df.withColumn("opening", tx.opening_key(t)).withColumn("has_opening", F.col("opening") != "")
          .withColumn("is_question", F.col("text").contains("?")).withColumn("bucket", F.expr("key div 5")))
    lens = spark.createDataFrame(list(CAPS.items()), "length_name string, cap_length long")
    tops = spark.createDataFrame(list(TOPICS.items()), "topic string, cap_topic long")
    df = df.join(lens, "length_name").join(tops, "topic").withColumn("cap_opening", F.lit(6))
    return sim.with_keys(df.withColumn("cap_question", F.lit(questions)).withColumn("cap_total", F.lit(total)), "text")


@pytest.fixture(scope="module")
def expected():
    rows = _rows()
    return rows, S.greedy([dict(key=k, text=" ".join(t.split()), verdict=v, length_name=ln, topic=tp, is_question="?" in t) for k, t, ln, tp, v in rows], 70, 18, CAPS, TOPICS)


def test_batches_equal_one_run_and_replays_change_nothing(spark, tmpdir_path, expected):
    rows, want = expected
    assert {"accepted", "near_duplicate", "length_quota_full"} <= set(want.values())
    path, got, before = f"{tmpdir_path}/index", {}, {}
    for name, part in (("0", rows[:45]), ("1", rows[45:85]), ("2", rows[85:])):
        decided = inc.accept_batch(_candidates(spark, part), path, name).collect()
        if name == "1":  # the batch is run again, as after a failure
            assert sorted(decided) == sorted(inc.accept_batch(_candidates(spark, part), path, name).collect())
        got |= {r.key: r.decision for r in decided}
        before |= {r.key: r.accepted_before for r in decided}
    assert got == want
    taken = 0
    for key in sorted(want):
        assert before[key] == taken
        taken += want[key] == "accepted"
    assert inc.batches(spark, path) == ["0", "1", "2"]
    assert {r.n for r in inc.used(spark, path).filter("rule = '_all'").collect()} == {taken}
    assert spark.read.parquet(*[f"{path}/{b}/accepted" for b in "012"]).count() == taken


def test_an_unfinished_batch_does_not_count(spark, tmpdir_path, expected):
    import shutil

    rows, _ = expected
    path = f"{tmpdir_path}/index"
    one = sorted(inc.accept_batch(_candidates(spark, rows[:30]), path, "0").collect())
    shutil.rmtree(f"{path}/0/counts")
    assert inc.batches(spark, path) == []
    assert sorted(inc.accept_batch(_candidates(spark, rows[:30]), path, "0").collect()) == one


def test_query_equals_one_run(spark):
    got = {r.key: (r.decision, r.accepted_before) for r in C.greedy_in_batches(spark, SF_SMALL).collect()}
    want = {r.key: (r.decision, r.accepted_before) for r in C.greedy_accept(spark, SF_SMALL).collect()}
    assert got == want and sum(d == "accepted" for d, _ in got.values()) > 100
