"""The Jaccard join against brute force, with blocks of one and of many chunks."""

import random

import pytest

from quire.llm import signature_join as sj


def brute(docs, size=4, percent=85):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    docs, texts = [], []
    for _ in range(n):
        if texts and rng.random() < 0.75:
            words = list(rng.choice(texts))
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                if rng.random() < 0.5 or len(words) < 3:
                    words.insert(rng.randrange(len(words) + 1), rng.choice(vocabulary))
                else:
                    del words[rng.randrange(len(words))]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 90, 200]))]
        texts.append(words)
        docs.append((len(docs), " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return docs


@pytest.mark.parametrize("seed,chunk", [(1, 512), (2, 7)])
def test_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(sj, "CHUNK", chunk)
    docs = corpus(seed)
    got = sj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), chunk=chunk)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == brute(docs)


def test_texts_that_share_a_passage_leave_first(spark, monkeypatch):
    """Sets with too many shingles of their own go, linked ones stay, however shared shingles are told."""
    monkeypatch.setattr(sj, "BATCH_TEXTS", 9)
    monkeypatch.setattr(sj, "SHARED_SETS", 2)
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(40)]
    docs = corpus(5, 60)
    docs += [(100 + i, " ".join([f"o{i}-{k}" for k in range(30)] + passage)) for i in range(40)]  # linked with nothing
    docs += [(200 + i, " ".join(passage + [rng.choice("xyz") for _ in range(3)])) for i in range(40)]  # near copies
    docs += [(300, docs[70][1]), (301, docs[3][1])]  # copies in other batches
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sj.jaccard_components(frame, size=5, percent=80)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == brute(docs, 5, 80)
    batch = frame.coalesce(1).selectExpr("doc_id", "text")
    packed = batch.mapInArrow(sj._counted(5, 80, 3), "bucket long, keys binary, sets binary, times binary")
    assert packed.where("keys is null").count() > 0 and packed.where("keys is not null").count() > 0


def test_single_ties_keep_what_hangs_together(spark):
    ties = spark.createDataFrame([(1, 9), (2, 9), (1, 5), (2, 7), (3, 8), (1, 9)], "a long, b long")
    got = sorted(tuple(r) for r in sj.single_ties(ties).collect())
    assert got == [(1, 2), (1, 5), (1, 9), (2, 7), (3, 8)]


def test_near_copies_of_a_batch_send_each_key_once(spark):
    """A large group is tied in its batches: tasks get one set of it from each, and every set still hangs together."""
    import numpy as np

    rng = random.Random(11)
    base = [f"b{k}" for k in range(120)]
    group = [" ".join(base[:j] + [f"x{i}"] + base[j + 1 :]) for i in range(400) for j in [rng.randrange(120)]]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(group)], "doc_id long, text string, block long").repartition(4)
    packed = docs.mapInArrow(sj._keys(5, 80, 32), "bucket long, keys binary, places binary, sets binary")
    rows = packed.where("keys is not null").collect()
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
    assert np.unique(keys, return_counts=True)[1].max() <= 4  # once from each batch
    assert len({x for r in rows for x in np.frombuffer(r["sets"], np.int64)}) < 40
    ties = packed.repartition(32, "bucket").sortWithinPartitions("bucket").mapInArrow(sj._ties, "a long, b long").collect()
    assert len(ties) < 2 * len(group)
    root = {}
    for a, b in ties:
        while a in root:
            a = root[a]
        while b in root:
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
    assert len(root) == len(group) - 1


def test_keys_lose_no_link():
    """Any two linked sets share a key, at the smallest overlap that links and at every size."""
    import numpy as np

    rng = np.random.default_rng(5)
    classes = sj.size_classes(85, 4000)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(30):
            shared = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            spare = int(n * 100 / 85) - n
            one = int(rng.integers(0, spare + 1))
            x = np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, one, dtype=np.uint64)]))
            y = np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, spare - one, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            assert 100 * both >= 85 * (len(x) + len(y) - both)
            assert len(np.intersect1d(sj.set_keys(x, classes, 85), sj.set_keys(y, classes, 85)))


def test_edge_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a b c d e", 5), (4, "A b", 5), (5, "a B", 5), (7, "a b c d e", 5), (7, "a b c d e", 5), (8, "x " * 5000, 5), (9, "x x x x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in sj.jaccard_components(docs).collect()), key=repr)
    want = [(1, 0, 1), (2, 0, 2), (None, 2, None), (4, 1, 4), (5, 1, 4), (7, 2, 7), (7, 2, 7), (8, 1, 8), (9, 1, 8)]
    assert got == sorted(want, key=repr)
    assert sj.jaccard_components(docs.limit(0)).collect() == []
