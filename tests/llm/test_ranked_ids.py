"""Ranked ids on disk: the coding against a plain one, exact round trips, and the query against the library."""

import glob
import os
import zlib

import numpy as np
import public_tokenizers
import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
tokenizers = pytest.importorskip("tokenizers")

from quire.llm import queries  # noqa: E402
from quire.llm import ranked_ids as ri  # noqa: E402

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_decoded(control, data, n):
    out, at = [], 0
    for i in range(n):
        size = (control[i // 4] >> 2 * (i % 4) & 3) + 1
        out.append(int.from_bytes(data[at : at + size], "little"))
        at += size
    assert at == len(data)
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000, 4097])
def test_coding(n):
    rng = np.random.default_rng(n)
    numbers = (rng.integers(0, 1 << 32, n, np.uint64) >> rng.integers(0, 32, n, np.uint64)).astype(np.uint32)
    numbers[: min(n, 8)] = [0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1][: min(n, 8)]
    control, data = ri.encoded(numbers)
    assert len(control) == (n + 3) // 4
    assert plain_decoded(control, data, n) == numbers.tolist()
    assert ri.decoded(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n).tolist() == numbers.tolist()


def expected(rows):
    """[(doc_id, start, ids)] by the library, in the order of the files."""
    library = tokenizers.Tokenizer.from_file(PATH)
    docs = []
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        width = "<u2" if max(ids) < 1 << 16 else "<u4"
        docs.append((doc is not None, doc or 0, len(ids), zlib.crc32(np.array(ids, width).tobytes()), ids))
    out, at = [], 0
    for known, doc, n, _, ids in sorted(docs):
        out.append((doc if known else None, at, ids))
        at += n
    return out


ROWS = [(3, "The end."), (1, None), (1, ""), (7, "a <|endoftext|> b"), (None, "no id"), (3, "The end."), (3, "The"), (-5, "héllo wörld 漢字 🙂"), (2, "word " * 5000), (None, None)]


@pytest.mark.parametrize("block_tokens,file_blocks,least", [(1 << 16, 256, 1 << 20), (4, 2, 1)])
def test_round_trip(spark, tmpdir_path, monkeypatch, block_tokens, file_blocks, least):
    monkeypatch.setattr(ri, "BLOCK_TOKENS", block_tokens)
    monkeypatch.setattr(ri, "FILE_BLOCKS", file_blocks)
    monkeypatch.setattr(ri, "LEAST_TOKENS", least)
    docs = spark.createDataFrame([(i, t, i) for i, t in ROWS], "doc_id long, text string, ids long").repartition(3)
    ri.write_ids(docs, PATH, f"{tmpdir_path}/out")
    got = sorted(((r.start, r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in ri.read_ids(spark, f"{tmpdir_path}/out").collect()), key=lambda r: r[0])
    assert [(d, s, ids) for s, d, n, ids in got] == expected(ROWS)
    assert all(n == len(ids) for _, _, n, ids in got)
    files = glob.glob(f"{tmpdir_path}/out/blocks/part-*")
    assert len(files) > (1 if least == 1 else 0) and all(sum(1 for _ in ri.headers(open(f, "rb").read())) <= file_blocks for f in files)


def test_frequent_ids_are_small(spark, tmpdir_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ri.write_ids(docs, PATH, f"{tmpdir_path}/out")
    ranks = spark.read.parquet(f"{tmpdir_path}/out/ranks").orderBy("rank").collect()
    assert [(-r.n, r.id) for r in ranks] == sorted((-r.n, r.id) for r in ranks)
    size = sum(os.path.getsize(f) for f in glob.glob(f"{tmpdir_path}/out/blocks/part-*"))
    assert size < 2 * sum(r.n for r in ranks)


def test_empty_and_damaged(spark, tmpdir_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    ri.write_ids(docs, PATH, f"{tmpdir_path}/none")
    assert ri.read_ids(spark, f"{tmpdir_path}/none").count() == 0
    good = ri.block([(1, 3)], np.array([1, 2, 300], np.uint32), 0, 0) + b"\n"
    (header,) = ri.headers(good)
    assert ri.read_block(good, *header[:5])[2].tolist() == [1, 2, 300]
    bad = good[:-2] + b"\x07\n"
    with pytest.raises(ValueError, match="damaged"):
        ri.read_block(bad, *header[:5])
    with pytest.raises(ValueError, match="not a file"):
        list(ri.headers(b"x" * 100))


def test_query_against_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in queries.op12_ranked_ids(spark, SMALL).collect())
    assert got == [(s, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, s, ids in expected(rows)]
