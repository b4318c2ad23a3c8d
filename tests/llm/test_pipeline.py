"""Each stage against a plain reading of what it is to do, on its own input."""

import corpus_pipeline as cp
import pytest
from quire.llm import secret_cnn as sc
from quire.llm.common import stored

from .test_signature_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """What each stage gets, then the result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(tables):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    assert all(t.dtypes == tables[0].dtypes for t in tables[1:5])


def test_quality_keeps_clean_documents(spark, tables):
    kept = set(texts(tables[1]))
    good = [(r.doc_id in kept) for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()]
    assert sum(good) >= 0.95 * len(good)


def test_one_of_each_group_stays(tables):
    before = texts(tables[1])
    roots = brute(sorted(before.items()))
    assert set(texts(tables[2])) == {root if n else i for i, n, root in roots}


def test_no_item_stays(spark, tables):
    before, after = texts(tables[2]), texts(tables[3])
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, t in before.items() if any(i in t for i in items)}
    assert leaked and not leaked & set(after) and len(before) - len(after) <= len(leaked) + 2


def test_no_base_secret_stays(tables):
    before, after = texts(tables[3]), texts(tables[4])
    assert set(before) == set(after)
    assert any(sc.base_spans(t) for t in before.values())
    assert not any(sc.base_spans(t) for t in after.values())
    assert all(len(r.text) == r.n_chars for r in tables[4].collect())


def test_packing_holds_all(tables):
    total = {}
    for r in tables[5].collect():
        total.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert set(total) == set(texts(tables[4])) and all(a == b for a, b in total.values())


def test_rows_without_ids(spark, tables):
    rows = [(None, None, "en", None, 1), (None, "a text of its own, five words more", "en", "s", 34), (7, "same text of six words here", None, "s", 27), (7, "same text of six words here", None, "s", 27), (8, "", "en", "s", 0)]
    docs = stored(spark.createDataFrame(rows, tables[0].schema), "test-odd")
    kept = cp.near_duplicates(spark, docs, SF)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 7), (False, 8), (True, 0), (True, 0)]
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_near_duplicates_at_five_words_and_four_fifths(spark, tables):
    """Copies between 4 words at 0.85 and 5 words at 0.8 are one group; those below are not."""
    words = [f"w{k}" for k in range(100)]
    changed = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(words))
    every = [(1, changed()), (2, changed(30, 70)), (3, " ".join(f"v{k}" for k in range(100))), (4, " ".join("y" if k in (20, 50, 80) else f"v{k}" for k in range(100)))]
    docs = stored(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in every], tables[0].schema), "test-between")
    assert {i for i, _, root in brute(every) if i != root} == set() and {i for i, _, root in brute(every, 5, 80) if i != root} == {2}
    assert set(texts(cp.near_duplicates(spark, docs, SF))) == {1, 3, 4}


def test_groups_of_five_words_and_four_fifths(tables):
    before = texts(tables[1])
    assert set(texts(tables[2])) == {root if n else i for i, n, root in brute(sorted(before.items()), 5, 80)}
