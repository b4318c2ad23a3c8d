"""Packing: an exact round trip, gapless sequences, and no padding."""

import os
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
tokenizers = pytest.importorskip("tokenizers")

from quire.llm import packing as pk  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, docs, window):
    sequences, found = defaultdict(list), defaultdict(list)
    for doc, start, length, ids, total, sequence, offset in pieces:
        ids = np.frombuffer(ids, "<u4").tolist()
        assert len(ids) == length
        sequences[sequence].append((offset, length))
        found[doc].append((start, ids, total))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0
    assert set(found) == set(docs)
    for doc, parts in found.items():
        ids = [i for _, part, _ in sorted(parts) for i in part]
        assert ids == docs[doc] and {t for *_, t in parts} == {len(ids)}


@pytest.mark.parametrize("window,open_windows", [(16, 4096), (16, 3), (64, 4096)])
def test_round_trip(window, open_windows):
    rng = np.random.default_rng(window + open_windows)
    packer, docs = pk.Packer(window, open_windows), {}
    for d in range(400):
        ids = rng.integers(0, 50257, int(rng.choice([1, 2, 5, 11, window - 1, window, window + 3, 3 * window + 1])), dtype=np.uint32)
        docs[d] = ids.tolist()
        packer.add(d, ids)
        assert packer.n_open <= open_windows
    packer.close()
    check(packer.out, docs, window)


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    packer = pk.Packer(8)
    for _ in range(500):
        packer.counts[1:8] = rng.integers(0, 4, 7)
        size = int(rng.integers(1, 8))

        def after(level):
            counts = packer.counts[:9].copy()
            if level:
                counts[level] -= 1
            if level + size < 8:
                counts[level + size] += 1
            return int((counts[1:8] ** 2).sum())

        allowed = [0] + [h for h in range(1, 9 - size) if packer.counts[h] > 0]
        assert after(packer.level(size)) == min(map(after, allowed))


def test_rows(spark):
    library = tokenizers.Tokenizer.from_file(PATH)
    rows = [(1, None, 0), (2, "", 0), (3, "a <|endoftext|> b", 0), (4, "Wörter und " * 4000, 0), (5, "same text", 0), (6, "same text", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(2)
    got = [tuple(r) for r in pk.packed(docs, PATH).collect()]
    check([(d, s, n, bytes(i), t, q, o) for d, s, n, i, t, q, o in got], {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in rows}, 1024)
    assert pk.packed(docs.limit(0), PATH).collect() == []
    assert pk.packed(spark.createDataFrame([(None, "x")], "doc_id long, text string"), PATH).first().doc_id is None
    with pytest.raises(ValueError):
        pk.packed(docs, PATH, window=1000)
