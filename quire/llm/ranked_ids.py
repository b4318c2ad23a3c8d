"""Token ids on disk: frequency-ranked ids in byte-aligned variable-length
coding, with the control bytes apart from the data bytes.

The ids of all documents are counted and numbered by falling count, so the
frequent ones are small numbers. A folder holds

* `ranks`, a table (rank, id, n), of at most as many rows as the vocabulary;
* `blocks`, files of blocks, documents in ascending order of their ids. Each
  block is a header (mark, bytes, checksum of what follows, documents, tokens,
  partition, tokens of the partition before this block), the documents' ids,
  whether each is null, their numbers of tokens, the control bytes, the data
  bytes, and a line feed. A number takes one to four data bytes, low byte
  first; a control byte holds the lengths less one of four numbers, two bits
  each, the first lowest.

A control byte is decoded by table look-up: where in the data its numbers'
sixteen bytes lie, which of them are there, and how many data bytes it takes.

Tokens are worked out once and kept in the shared folder until the files are
written. Spark sorts documents into ranges of ids (rows of one id are parted
further, by size, checksum and row, so an id with a third of all rows fills
many tasks) and its text writer commits the files, so a task that is lost or
run twice leaves one copy. A file holds at most FILE_BLOCKS blocks. Reading
back, only each partition's total meets all others, to say where it starts.

Defined results: a null or empty text is the end token alone; null ids come
first; rows of one id follow one another, shorter ones first, then by checksum
of their ids; an empty table gives a folder without blocks and no rows; other
columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import doc_text, map_arrow, removed, shared_path, stored
from quire.llm.packing import END_TOKEN, encoder

#: Tokens of a block (a longer document has a block of its own), blocks of a file, and tokens of a partition.
BLOCK_TOKENS, FILE_BLOCKS, PARTITION_TOKENS = 1 << 16, 256, 1 << 24
#: Least tokens of a partition, where there are more tasks than partitions.
LEAST_TOKENS = 1 << 20
#: Partitions whose starts (two numbers each) are sent to all tasks at most.
BROADCAST_PARTITIONS = 1_000_000
#: Texts encoded in one step.
STEP_TEXTS = 1000

MARK = b"rid1"
HEADER = struct.Struct("<4sQIIQQQ")

_CODES = np.arange(256)
#: Of each control byte: the lengths of its four numbers, and of all together.
LENGTHS = np.stack([(_CODES >> 2 * k & 3) + 1 for k in range(4)], 1)
TAKEN = LENGTHS.sum(1)
#: Of each control byte: which of the sixteen bytes of four 32-bit numbers are in the data, and where.
PRESENT = (np.arange(4) < LENGTHS[:, :, None]).reshape(256, 16).astype(np.uint8)
PLACE = np.maximum(np.cumsum(PRESENT, 1, dtype=np.int64) - 1, 0)


def encoded(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit numbers."""
    numbers = numbers.astype("<u4")
    code = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    four = np.zeros((len(numbers) + 3) // 4 * 4, np.uint8)
    four[: len(numbers)] = code
    four = four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    data = numbers.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return np.bitwise_or.reduce(four, axis=1).tobytes(), data.tobytes()


def decoded(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n numbers of some control bytes and data bytes, by table look-up."""
    taken = TAKEN[control]
    first = np.cumsum(taken) - taken
    wide = np.append(data, np.zeros(16, np.uint8))
    return (wide[first[:, None] + PLACE[control]] * PRESENT[control]).view("<u4").reshape(-1)[:n]


def block(documents: list[tuple], numbers: np.ndarray, partition: int, before: int) -> bytes:
    """A block of documents (id, number of tokens) with the numbers of their tokens one after the other."""
    control, data = encoded(numbers)
    ids = np.array([0 if i is None else i for i, _ in documents], "<i8").tobytes()
    null = np.array([i is None for i, _ in documents], np.uint8).tobytes()
    sizes = np.array([n for _, n in documents], "<u8").tobytes()
    body = b"".join((ids, null, sizes, control, data))
    return HEADER.pack(MARK, len(body), zlib.crc32(body), len(documents), len(numbers), partition, before) + body


def headers(content: bytes) -> Iterator[tuple]:
    """(place of the body, bytes, checksum, documents, tokens, partition, before) of each block of a file."""
    at = 0
    while at < len(content):
        mark, size, *rest = HEADER.unpack_from(content, at)
        at += HEADER.size
        if mark != MARK or content[at + size : at + size + 1] != b"\n":
            raise ValueError("not a file of token id blocks")
        yield at, size, *rest
        at += size + 1


def read_block(content: bytes, at: int, size: int, checksum: int, n_docs: int, n_tokens: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids of the documents (null: None), their numbers of tokens, and the numbers of all tokens."""
    body = memoryview(content)[at : at + size]
    if zlib.crc32(body) != checksum:
        raise ValueError("a block of token ids is damaged")
    ids = np.frombuffer(body, "<i8", n_docs).tolist()
    null = np.frombuffer(body, np.uint8, n_docs, 8 * n_docs)
    sizes = np.frombuffer(body, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    n_control = (n_tokens + 3) // 4
    control = np.frombuffer(body, np.uint8, n_control, 17 * n_docs)
    data = np.frombuffer(body, np.uint8, -1, 17 * n_docs + n_control) if size > 17 * n_docs + n_control else np.empty(0, np.uint8)
    return [None if gone else i for i, gone in zip(ids, null.tolist(), strict=True)], sizes, decoded(control, data, n_tokens)


def _tokens(vocabulary: str):
    """(doc_id, n_tokens, checksum, ids): two bytes an id where all fit, else four."""

    def run(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), STEP_TEXTS):
                made = [np.append(t, np.uint32(END_TOKEN)) for t in encode(texts.slice(at, STEP_TEXTS).to_pylist())]
                packed = [t.astype("<u2" if t.max() < 1 << 16 else "<u4").tobytes() for t in made]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, STEP_TEXTS), pa.array(list(map(len, made)), pa.int64()), pa.array(list(map(zlib.crc32, packed)), pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "checksum", "ids"]
                )

    return run


def _unpacked(n: int, packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if len(packed) == 2 * n else "<u4")


def _counts(batches):
    """(id, n) for the ids of one task."""
    total = np.zeros(1, np.int64)
    for batch in batches:
        for n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            more = np.bincount(_unpacked(n, packed))
            if len(more) > len(total):
                total, more = more, total
            total[: len(more)] += more
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])


def _blocks(rank_of: np.ndarray):
    """The blocks of one partition, in order."""

    def run(batches):
        partition, before = TaskContext.get().partitionId(), 0
        held, documents, size = [], [], 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array([block(documents, rank_of[np.concatenate(held)], partition, before)], pa.binary())], ["value"])

        for batch in batches:
            for doc, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size and size + n > BLOCK_TOKENS:
                    yield full()
                    before += size
                    held, documents, size = [], [], 0
                held.append(_unpacked(n, packed))
                documents.append((doc, n))
                size += n
        if documents:
            yield full()

    return run


def write_ids(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The token ids of all documents, with an end token each, as a folder of this format."""
    spark = docs.sparkSession
    kept = shared_path(spark, "ranked-tokens")
    map_arrow(doc_text(docs, id_col, text_col), _tokens(vocabulary), "doc_id long, n_tokens long, checksum long, ids binary").write.option("compression", "zstd").parquet(kept)
    tokens = spark.read.parquet(kept)
    counts = map_arrow(tokens.select("n_tokens", "ids"), _counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = sorted(counts.collect(), key=lambda r: (-r.n, r.id))  # at most as many as the vocabulary has
    spark.createDataFrame([(rank, r.id, r.n) for rank, r in enumerate(found)], "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max((r.id for r in found), default=0) + 1, np.uint32)
    rank_of[[r.id for r in found]] = np.arange(len(found))
    total = sum(r.n for r in found)
    partitions = max(1, -(-total // PARTITION_TOKENS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // LEAST_TOKENS))
    order = ["doc_id", "n_tokens", "checksum", "_row"]
    ranges = tokens.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    made = map_arrow(ranges.select("doc_id", "n_tokens", "ids"), _blocks(rank_of), "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/blocks")
    removed(spark, kept)


def _partition_totals(batches):
    for batch in batches:
        for content in batch.column(0):
            for _, _, _, _, tokens, partition, _ in headers(content.as_py()):
                yield pa.RecordBatch.from_arrays([pa.array([partition], pa.int64()), pa.array([tokens], pa.int64())], ["partition", "n"])


def _documents(id_of: np.ndarray):
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                content = content.as_py()
                for at, size, checksum, n_docs, tokens, partition, before in headers(content):
                    ids, sizes, numbers = read_block(content, at, size, checksum, n_docs, tokens)
                    found = id_of[numbers].tobytes()
                    upto = np.concatenate([[0], np.cumsum(sizes)])
                    cut = (4 * upto).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([partition] * n_docs, pa.int64()), pa.array(before + upto[:-1]), pa.array(ids, pa.int64()), pa.array(sizes), pa.array([found[a:b] for a, b in zip(cut, cut[1:])], pa.binary())],
                        ["partition", "before", "doc_id", "n_tokens", "ids"],
                    )

    return run


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens and ids
    (little-endian 32-bit numbers) of each document of a folder."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()
    id_of = np.zeros(len(ranks), "<u4")
    id_of[[r["rank"] for r in ranks]] = [r.id for r in ranks]
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/blocks").select("content")
    totals = stored(map_arrow(files, _partition_totals, "partition long, n long").groupBy("partition").agg(F.sum("n").alias("n")), "ranked-totals")
    earlier = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = totals.select("partition", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    found = map_arrow(files, _documents(id_of), "partition long, before long, doc_id long, n_tokens long, ids binary")
    # at a row for every 2^24 tokens or more, few enough to be sent to the documents, which else go through a shuffle
    near = F.broadcast(base) if totals.count() <= BROADCAST_PARTITIONS else base
    return found.join(near, "partition").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")
