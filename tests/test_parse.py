"""Batch-response parsing edge rows (FIXTURES.md: batch text)."""

from quire.functions import parse as ps

CASES = [
    ('["a", "b"]', ["a", "b"]),
    ('```json\n["a"]\n```', ["a"]),
    ('```JSON\n["a"]\n```', ["a"]),
    ('```\n["a"]\n```', ["a"]),
    ('Sure: ["a", "b"] thanks', ["a", "b"]),
    ("[]", []),
    ("{}", None),
    ('"s"', None),
    ('["a", "b"', None),
]


def test_parse_orders(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _e) in enumerate(CASES)], "i int, raw string").orderBy("i")
    rows = df.select(ps.parse_batch("raw").alias("v2"), ps.parse_batch_v1("raw").alias("v1")).collect()
    for (raw, exp), r in zip(CASES, rows):
        assert r.v2 == (exp or None), raw  # v2 takes an empty list for a failed batch
        assert r.v1 == exp, raw


def test_envelope(spark):
    rows = [('{"posts": ["a", "b"]}', 2), ('{"posts": ["a", 1]}', 2), ('{"posts": ["a"]}', 2), ("{}", 1), ("nope", 1)]
    df = spark.createDataFrame([(i, r, n) for i, (r, n) in enumerate(rows)], "i int, raw string, n int").orderBy("i")
    out = df.select(ps.parse_envelope("raw", "n").alias("e")).collect()
    assert [o.e.error for o in out] == [None, None, "wrong_arity", "missing_posts", "invalid_json"]
    items = df.limit(2).select(ps.parse_envelope("raw", "n").alias("e")).selectExpr("inline(transform(e.posts, x -> struct(x)))")
    texts = [r[0] for r in items.select(ps.variant_text(items.columns[0])).collect()]
    assert texts == ["a", "b", "a", None]
