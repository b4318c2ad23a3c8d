"""Packing: sum-of-squares online packing into windows of a fixed size.

Documents arrive one by one. Whole windows of a document are cut off; its
remainder goes to the fill level (an open window of that level, or a new one)
that minimises the sum over levels of squared counts of partially filled
windows. The counts are one array by level. When a task ends, or its open
windows exceed a bound on memory, what they hold is cut anew into full windows
and a last stretch into windows of powers of two, which need no padding; so
every token lies in exactly one piece and nothing is padded.

Each task packs its own partition, so nothing passes through one task or the
driver; a task that runs again reads the same rows and gives the same windows.

Defined results: a null or empty text is a document of the end token alone; a
null id stays null; repeated rows are documents of their own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quire.llm.common import doc_text, map_arrow
from quire.llm.pieces import END, PieceTable, Vocabulary, span_hashes, steps

WINDOW = 1024
END_TOKEN = 0
#: Open windows held by a task: beyond, they are cut anew.
OPEN_WINDOWS = 4096
#: Sequence ids of one partition.
PARTITION_IDS = 1 << 40

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of whole texts, by a table of pieces."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.table = PieceTable(self.vocabulary.ids, np.uint32)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for spans, points, kind, start in steps(texts):
            ends = np.flatnonzero(kind == END)
            start = start[kind[start] != END]
            if not len(start):
                continue
            stop = np.minimum(np.append(start[1:], len(points)), ends[np.searchsorted(ends, start)])
            text = points.tobytes()
            row = self.table.rows(span_hashes(points, start, stop), lambda i: text[4 * start[i] : 4 * stop[i]].decode("utf-32-le"))  # noqa: B023
            ids, count = self.table.gather(row)
            pieces = np.searchsorted(start, ends)  # pieces up to the end of each text
            upto = np.concatenate([[0], np.cumsum(count)])[pieces]
            at = 0
            for (i, _), to in zip(spans, upto.tolist(), strict=True):
                parts[i].append(ids[at:to])
                at = to
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.empty(0, np.uint32) for p in parts]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        special = self.vocabulary.special
        rare = {i for i, t in enumerate(texts) if any(s in t for s in special)}
        out = self.plain(["" if i in rare else t for i, t in enumerate(texts)])
        for i in rare:
            made: list[np.ndarray] = []
            for text, token in self.vocabulary.segments(texts[i]):
                made += self.plain([text])
                if token is not None:
                    made.append(np.array([token], np.uint32))
            out[i] = np.concatenate(made)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


class Packer:
    """The online packing of one task. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, first_id: int = 0) -> None:
        self.window, self.open_windows, self.next = window, open_windows, first_id
        self.counts = np.zeros(window + 1, np.int64)  # open windows by level
        self.held: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.out: list[tuple] = []

    def sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), ids.tobytes(), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def level(self, size: int) -> int:
        """The level where a piece of this size adds least to the sum of squares; the fuller one of equals."""
        top = self.window - size
        cost = np.where(self.counts[: top + 1] > 0, 1 - 2 * self.counts[: top + 1], 1 << 60)
        cost[0] = 0  # a new window
        cost[:top] += 2 * self.counts[size : self.window] + 1  # a window filled to the brim is no longer counted
        return int(top - np.argmin(cost[::-1]))

    def add(self, doc, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) - len(ids) % self.window
        for at in range(0, whole, self.window):
            self.sequence([(doc, at, ids[at : at + self.window], total)])
        size = total - whole
        if not size:
            return
        piece = (doc, whole, ids[whole:].copy(), total)
        level = self.level(size)
        pieces = []
        if level:
            pieces = self.held[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if level + size == self.window:
            self.sequence(pieces)
            return
        self.held[level + size].append(pieces)
        self.counts[level + size] += 1
        self.n_open += 1
        if self.n_open > self.open_windows:
            self.close()

    def close(self) -> None:
        """What open windows hold goes to full windows, and the last stretch to windows of powers of two."""
        rest = [p for level in self.held for pieces in level for p in pieces]
        left = sum(len(p[2]) for p in rest)
        sizes = [self.window] * (left // self.window) + [1 << b for b in range(self.window.bit_length() - 1, -1, -1) if (left % self.window) >> b & 1]
        rest.reverse()
        for size in sizes:
            pieces = []
            while size:
                doc, start, ids, total = rest.pop()
                if len(ids) > size:
                    rest.append((doc, start + size, ids[size:], total))
                    ids = ids[:size]
                pieces.append((doc, start, ids, total))
                size -= len(ids)
            self.sequence(pieces)
        self.counts[:] = 0
        self.held = [[] for _ in range(self.window + 1)]
        self.n_open = 0

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.out, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            self.out = []


def packed(docs: DataFrame, vocabulary: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece, with its token ids as little-endian 32-bit numbers.
    The window must be a power of two."""
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")

    def run(batches):
        encode = encoder(vocabulary)
        packer = Packer(window, open_windows, TaskContext.get().partitionId() * PARTITION_IDS)
        end = np.array([END_TOKEN], np.uint32)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 1000):
                for doc, tokens in zip(ids[at : at + 1000], encode(texts[at : at + 1000]), strict=True):
                    packer.add(doc, np.concatenate([tokens, end]))
                yield from packer.taken()
        packer.close()
        yield from packer.taken()

    return map_arrow(doc_text(docs, id_col, text_col), run, SCHEMA)
