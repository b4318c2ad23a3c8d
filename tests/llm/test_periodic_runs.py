"""Periodic runs: every run of small texts against a plain search over all periods, and the query's digests."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quire.llm import periodic_runs as pr
from quire.llm import queries

SMALL = "/root/testdata/sf0.001"


def plain_runs(w, least=12):
    """All (start, length, period), by trying every period and every stretch of matches."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            x = i
            while i < n and w[i] == w[i - q]:
                i += 1
            if i - x + q >= max(least, 2 * q):
                found.setdefault((x - q, i - x + q), q)
    return sorted((s, m, q) for (s, m), q in found.items())


def plain_collapsed(w, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def of_texts(texts, least=12):
    split = [t.split() for t in texts]
    known = {}
    words = np.array([known.setdefault(w, len(known)) for s in split for w in s], np.int64)
    document = np.repeat(np.arange(len(split)), [len(s) for s in split])
    start, end, period = pr.runs(words, document, least)
    out = [[] for _ in texts]
    first = np.cumsum([0, *map(len, split)])
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist(), strict=True):
        d = document[s]
        out[d].append((s - int(first[d]), e - s, q))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_texts(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(120):
        kind = rng.randrange(4)
        n, letters = rng.randrange(0, 120), "ab" if kind < 2 else "abcdefgh"
        w = [rng.choice(letters) for _ in range(n)]
        for _ in range(rng.randrange(4) if n else 0):  # stretches that repeat, also inside one another
            a, p = rng.randrange(n), rng.randrange(1, 30)
            for i in range(a + p, min(n, a + p * rng.randrange(2, 6) + rng.randrange(p))):
                w[i] = w[i - p]
        texts.append(" ".join(w))
    for least in (12, 2, 7):
        assert of_texts(texts, least) == [plain_runs(t.split(), least) for t in texts]


def test_special_words():
    fib, morse = ["a", "ab"], "a"
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    while len(morse) < 512:
        morse += morse.translate(str.maketrans("ab", "ba"))
    texts = [" ".join(t) for t in (fib[-1], morse, "a" * 300, "a" * 100 + "b" + "a" * 100 + "b" + "a" * 150, "ab" * 60 + "c" + "ab" * 60, "")]
    assert of_texts(texts) == [plain_runs(t.split()) for t in texts]


def test_one_word_a_hundred_thousand_times():
    n = 100_000
    found = of_texts([" ".join(["a"] * n), "a b " * (n // 2), " ".join("ab"[i % 777 == 0] for i in range(n))])
    assert found[:2] == [[(0, n, 1)], [(0, n, 2)]]
    assert (0, n, 777) in found[2] and len(found[2]) == 1 + n // 777 + (n % 777 >= 13)


def test_operator_and_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (None, "a " * 20, "x"), (4, "a " * 20, "y"), (4, "a " * 20, "y"), (5, "A a A a " * 3 + " b", "z"), (6, "a b " * 12, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in pr.periodic_runs(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    one = [(0, 20, 1)]
    assert got == [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 20, one, "a"), (4, 20, one, "a"), (5, 13, [(0, 12, 2)], "A a  b"), (6, 12, [(0, 12, 1)], "a b"), (None, 20, one, "a")]
    assert pr.periodic_runs(df.limit(0)).count() == 0
    assert {r.text for r in pr.with_planted(df).where("doc_id is null or text is null or trim(text) = ''").collect()} >= {None, "", "a " * 20}


def test_batches_change_nothing(spark, monkeypatch):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    one = {r.doc_id: r.runs for r in pr.periodic_runs(df).collect()}
    monkeypatch.setattr(pr, "BATCH_WORDS", 50)
    batch = pr._batch(*zip(*[(r.doc_id, (r.text or "").encode().split()) for r in df.collect()], strict=True), 12)
    assert {i: [(x["start"], x["length"], x["period"]) for x in runs] for i, runs in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)} == {i: [tuple(x) for x in v] for i, v in one.items()}


def test_query_against_plain_search(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SMALL).collect()}
    assert set(got) == set(docs)
    planted = 0
    for doc, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, h = len(w), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            planted += 1
        if n > 3000:
            continue  # the plain search takes n * n steps
        found, r = plain_runs(w), got[doc]
        best = min(((-m, s, q) for s, m, q in found), default=None)
        want = (len(found), *((best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4))
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(w, found).encode()).hexdigest()
    assert planted > 5
