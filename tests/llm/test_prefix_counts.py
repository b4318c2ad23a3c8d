"""Counts at every prefix against the library."""

import os
import random

import public_tokenizers
import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
tokenizers = pytest.importorskip("tokenizers")

from quire.llm import pieces  # noqa: E402
from quire.llm import prefix_counts as pc  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "a  b", "  a", "a \n\n b", "don't 'll x'sa 're''s 's 'r", "a\n's b", "\n\n\nfoo  \t bar", "x <|endoftext|> y!!<|endof", "<|endoftext|>", "é ñ  ü 漢字 １２ ½",
    "　x  y", "\x00a\x1c b", "'llama 'lx 'v 've", "👍🏽 ok  ", "\r\n\r\n a", "a" * 50, "-" * 70, " " * 90 + "x", "'", "'s", "́a", "x  y",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def mixed_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab 'stlrve\n\t!<|>1é字 　  ") for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_every_prefix(library):
    counter = pc.PrefixCounter(PATH)
    for text in ODD + mixed_texts(1, 150):
        counts = pc.counts_of(counter([text])[0].tobytes())
        assert counts.tolist() == [count(library, text[:k]) for k in range(len(text) + 1)], text


def test_steps_cut_long_texts(library):
    text = " ".join(mixed_texts(2, 60)) * 3
    whole = pc.PrefixCounter(PATH).plain([text])[0]
    parts = list(pieces.steps([text], 64))
    assert sum(n for spans, *_ in parts for _, n in spans) == len(text) and len(parts) > 5
    starts, at = [], 0
    for spans, _, kind, start in parts:
        starts += [at + s for s in start[kind[start] != pieces.END].tolist()]
        at += spans[0][1]
    full = pieces._step([(0, text)])
    assert starts == full[3][full[2][full[3]] != pieces.END].tolist()
    assert int(whole.sum()) == count(library, text)


def test_rows_and_budget(spark, library):
    rows = [(1, None, 9), (2, "", 9), (None, "null id text", 9), (4, "some words and more words", 9), (4, "some words and more words", 9), (5, "Ñandú " * 3000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = pc.prefix_counts(docs, PATH).collect()
    want = sorted(((i, len((t or "").encode()), count(library, t or "")) for i, t, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == want
    assert pc.prefix_counts(docs.limit(0), PATH).collect() == []
    long = next(r for r in got if r.doc_id == 5)
    k = pc.longest_within(long.prefix_tokens, 100)
    assert count(library, rows[5][1][:k]) <= 100 < count(library, rows[5][1][: k + 1]) and pc.tokens_at(long.prefix_tokens, k) <= 100
    cut = pc.truncated(pc.prefix_counts(docs.where("doc_id = 5"), PATH), docs, 100).first()
    assert cut.text == rows[5][1][:k]


def test_small_table_of_pieces(library, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_PIECES", 5)
    counter = pc.PrefixCounter(PATH)
    for text in mixed_texts(3, 60):
        assert int(counter([text])[0].sum()) == count(library, text)
