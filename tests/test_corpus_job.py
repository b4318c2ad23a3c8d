"""Corpus validation job on a small response table."""

import json

import sequential as S
from quire.plans.corpus_job import validate_corpus
from quire.sources import io


def test_validate_corpus(spark):
    bands = {"very_short": (10, 55), "short": (56, 100), "medium": (101, 180), "long": (181, 270)}
    posts = [
        ["Rent went up again and nobody at city hall seems to care about it", "Rent went up again and nobody at city hall seems to care about it!",
         "short one", "Transit fares rising while service gets worse every single month, great job everyone", 7],
        ["Why does every ballot measure read like a legal riddle?", "check tweet 3 for details on the budget vote here",
         "@someone the school board meeting ran four hours and decided nothing at all", "plain post about taxes and budgets today"],
        ["broken json"],
    ]
    resp, prof = [], []
    for b, items in enumerate(posts):
        raw = json.dumps({"posts": items}) if b < 2 else '{"posts": ["x"'
        resp.append((b, raw, "main"))
        for i, _ in enumerate(items):
            name = ["short", "short", "very_short", "short", "short"][i % 5] if b == 0 else ["very_short", "very_short", "short", "very_short"][i]
            lo, hi = bands[name]
            prof.append((b, i, "housing" if i % 2 else "transit", name, lo, hi, "brief opinion", "standard"))
    responses = spark.createDataFrame(resp, "batch_id long, raw string, phase string")
    profiles = spark.createDataFrame(prof, "batch_id long, pos long, topic string, length_name string, "
                                           "min_chars int, max_chars int, form string, casual_style string")
    topics = spark.createDataFrame([("housing",), ("transit",)], "topic string")
    out = validate_corpus(responses, profiles, topics, total=10)
    dec = {r.key: r.decision for r in out["decisions"].collect()}
    assert dec[0] == "accepted" and dec[1] == "near_duplicate"
    assert dec[2] == "profile_length_mismatch" and dec[4] == "not_a_string"
    assert dec[io.KEY_STRIDE + 1] == "metadata_leakage" and dec[io.KEY_STRIDE + 2] == "contains_handle"
    dl = out["dead_letters"].collect()
    assert len(dl) == 1 and dl[0].reason == "invalid_json" and '"pos":0' in dl[0].profiles
    assert out["rejection_counts"].count() >= 3 and out["coverage"].count() > 0
    assert S.normalize("A  B") == "a b"


def test_shortfall_is_a_hard_failure(spark):
    import pytest

    from quire.operators.reports import QuotaNotMet

    responses = spark.createDataFrame([(0, '{"posts": ["a perfectly fine post about local taxes"]}', "main")],
                                      "batch_id long, raw string, phase string")
    profiles = spark.createDataFrame([(0, 0, "housing", "very_short", 10, 55, "brief opinion", "standard")],
                                     "batch_id long, pos long, topic string, length_name string, min_chars int, "
                                     "max_chars int, form string, casual_style string")
    topics = spark.createDataFrame([("housing",)], "topic string")
    out = validate_corpus(responses, profiles, topics, total=10)
    assert [(r.requested, r.available, r.short) for r in out["shortfall"].collect()] == [(10, 1, 9)]
    with pytest.raises(QuotaNotMet):
        validate_corpus(responses, profiles, topics, total=10, fail_on_shortfall=True)
