"""Scoring with a saved model: routes of a batch, replays, and stream equal to table."""

import math

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quire.operators import model as ml
from quire.plans.catalog import QUERIES
from quire.streaming import stream as st


def _model(spark, path):
    ml.save_log_odds(spark.createDataFrame([("good", 2_000_000), ("bad", -1_500_000)], "token string, odds bigint"), path)
    return ml.load_log_odds(spark, path)


ROWS = [(1, '{"text": "Good good day"}'), (2, '{"text": "  "}'), (3, '{"text": "bad'), (4, '{"other": 1}'), (5, None), (6, '{"text": "unknown words"}'), (7, '{"text": "' + "bad " * 100 + '"}')]


def test_routes(spark, tmpdir_path):
    requests = spark.createDataFrame(ROWS, "id long, value string")
    r = st.routed(requests, _model(spark, f"{tmpdir_path}/m"), "id")
    scored = {x.id: (x.score, x.ai_likelihood) for x in r["scored"].collect()}
    assert scored == {1: (4_000_000, round(1 / (1 + math.exp(-4)), 4)), 6: (0, 0.5), 7: (-150_000_000, 0.0)}
    assert sorted((x.id, x.error) for x in r["error"].collect()) == [(2, "No text provided"), (4, "No text provided")]
    assert sorted((x.id, x.reason, x.raw) for x in r["dead_letter"].collect()) == [(3, "invalid_json", '{"text": "bad'), (5, "no_body", None)]


def test_a_replayed_batch_adds_nothing(spark, tmpdir_path):
    model, out = _model(spark, f"{tmpdir_path}/m"), f"{tmpdir_path}/out"
    for batch_id, part in ((0, ROWS[:3]), (1, ROWS[3:]), (0, ROWS[:3])):
        st.write_routes(st.routed(spark.createDataFrame(part, "id long, value string"), model, "id"), out, batch_id)
    got = st.read_routes(spark, out, "id").collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4, 5, 6, 7]


def test_stream_equals_table(spark):
    table = {r.doc_id: (r.ai_likelihood, r.ai_label) for r in QUERIES["score_documents"](spark, SF_SMALL).collect()}
    stream = QUERIES["stream_score_text"](spark, SF_SMALL)
    got = {r.doc_id: (r.ai_likelihood, r.ai_label) for r in stream.filter(F.col("route") == "scored").collect()}
    assert got and got == {k: v for k, v in table.items() if k in got}
    assert {r.route: r["count"] for r in stream.groupBy("route").count().collect()} == {
        "scored": len(got), "error": sum(k % 10 == 7 for k in table), "dead_letter": sum(k % 10 == 3 for k in table)}
