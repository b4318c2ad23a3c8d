"""Importance resampling: held-out accuracy, the top k, and n-gram counts."""

import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import importance as im

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    """Labelled documents outside the sample: good ones are kept, bad ones go."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = labels.where("doc_id % 2 = 0")
    kept = {r.doc_id for r in im.resampled(docs, known).collect()}
    other = [(r.doc_id in kept, r.quality) for r in labels.where("doc_id % 2 = 1").collect()]
    assert sum(k for k, q in other if q) >= 0.97 * sum(q for _, q in other)
    assert sum(not k for k, q in other if not q) >= 0.8 * sum(not q for _, q in other)


@pytest.mark.parametrize("k", [0, 1, 7, 250, 299, 300, 1000])
def test_top_k(spark, monkeypatch, k):
    monkeypatch.setattr(im, "BINS", 4)
    rng = random.Random(k)
    rows = [(i, rng.choice([rng.gauss(0, 100), float(rng.randint(0, 3)), 1e6])) for i in range(300)]
    got = im.top_k(spark.createDataFrame(rows, "doc_id long, key double"), "key", k)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k])


def test_features_count_each_text_alone():
    texts = ["", "one", "One two,two two", "ÄÖ ß!! ß!!", " \n", "a_b c"]
    bucket, owner = im.features(texts)
    for i, text in enumerate(texts):
        alone = im.features([text])[0] if text else np.empty(0)
        assert Counter(bucket[owner == i].tolist()) == Counter(alone.tolist())
    n = Counter(owner.tolist())
    assert n[1] == 1 and n[2] == 5 + 4 + 3 and n[0] == n[4] == 0


def test_edge_rows(spark):
    good = [(i, "plain words of a text that reads well enough " * 3) for i in range(40)]
    bad = [(100 + i, "!!$$ %% || ** " * 20) for i in range(40)]
    rows = [*good, *bad, (300, None), (301, ""), (None, good[0][1]), (5, good[0][1])]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, key double")
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0) for i, _ in rows[:80]] + [(None, 1), (3, None)], "doc_id long, quality int")
    kept = [r.doc_id for r in im.resampled(docs, labels).collect()]
    assert set(range(40)) <= set(kept) and not set(kept) & {*range(100, 140), 300, 301} and None in kept and kept.count(5) == 2
    assert im.resampled(docs.limit(0), labels).collect() == []
    assert im.resampled(docs, labels.limit(0)).count() == len(rows)
    assert im.resampled(docs, labels, k=10).count() == 10


@pytest.mark.parametrize("shift", [-0.05, 0.05])
def test_length_does_not_decide(spark, monkeypatch, shift):
    """Clean texts of 5,000 and of 30 words are kept, foul ones of either length and empty ones go, with the cut on either side of 0."""
    rng = random.Random(5)
    clean = lambda n: " ".join(rng.choice(["plain", "words", "of", "a", "text", "that", "reads", "well"]) for _ in range(n))
    foul = lambda n: " ".join(rng.choice(["!!", "$$", "%%", "plain", "||", "words", "**"]) for _ in range(n))
    lengths = [30, 5000, 300, 30, 300]
    rows = [(i, clean(lengths[i % 5])) for i in range(60)] + [(100 + i, foul(lengths[i % 5])) for i in range(60)] + [(200 + i, ["", None, " \n"][i % 3]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0) for i, _ in rows[:120] if i % 2], "doc_id long, quality int")
    # all n-grams moved by one amount: the order by rate is the same, the totals' is not
    ratio, cut, cuts = im.log_ratio, im.best_cut, []
    monkeypatch.setattr(im, "log_ratio", lambda raw, target: ratio(raw, target) + moved)
    monkeypatch.setattr(im, "best_cut", lambda good, bad: cuts.append(cut(good, bad)) or cuts[-1])
    moved = 0.0
    im.resampled(docs, labels)
    moved = shift - cuts[0]
    assert {r.doc_id for r in im.resampled(docs, labels).collect()} == set(range(60))
    assert cuts[1] == pytest.approx(shift)


def test_toxic_rows_are_no_target(spark):
    """Labelled toxic rows are neither target nor good for the cut, and held-out texts like them go where n-grams tell."""
    rows = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0), (5, 1, None), (6, None, 1), (None, 1, 1)]
    roles = {r.doc_id: r.role for r in im.labelled(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()}
    assert {i for i, role in roles.items() if role == "cut_bad"} == {3, 4} and set(roles) == {1, 3, 4, 5}
    rng = random.Random(9)
    say = lambda *words: " ".join(rng.choice(words) for _ in range(80))
    texts = [(i, say("plain", "words", "of", "a", "text")) for i in range(60)] + [(100 + i, say("plain", "words", "vile", "scorn", "insult")) for i in range(60)]
    texts += [(200 + i, say("%%", "!!", "words")) for i in range(20)]
    labels = [(i, int(i < 200), int(100 <= i < 200)) for i, _ in texts if i % 2]
    scores = {r.doc_id: r.log_weight / r.n_grams for r in im.scored(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))[0].collect()}
    assert min(scores[i] for i in range(60)) > max(scores[i] for i in range(100, 160))
