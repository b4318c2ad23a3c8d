"""Token counts: the exact token count of every prefix of a text.

For one piece of the vocabulary's split, a dynamic programme over its bytes
keeps the count and the last token at each prefix: a token may follow the last
token of a shorter prefix if encoding the two together gives just these two,
and exactly one token that ends at a prefix does. The count at a prefix is one
more than at the place where that token starts. Counts of a whole text are
those of its pieces, run together; a prefix that ends in white space is
settled by the white space before it. Truncation and budget questions are
then look-ups in the counts (`tokens_at`, `longest_within`).

Defined results: a null or empty text has no tokens and an empty prefix
array; a null id stays null; repeated rows each give a row; an empty table
gives no rows; other columns are not read. A special string counts as its one
token from its last character on, and as plain text before. Texts of any
length are taken in steps cut where a piece starts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import doc_text, map_arrow
from quire.llm.pieces import END, SPACE, PieceTable, Vocabulary, span_hashes, steps

SCHEMA = "doc_id long, n_bytes long, n_tokens long, prefix_tokens binary"


class PrefixCounter:
    """Counts at every prefix, by character, as changes from prefix to prefix."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.longest = max(map(len, self.vocabulary.ranks))
        self.pairs: dict[int, bool] = {}
        self.names = {i: b for b, i in self.vocabulary.ranks.items()}
        self.table = PieceTable(self.changes, np.int16)

    def follows(self, last: int, token: int) -> bool:
        """Whether encoding the two tokens together gives just these two."""
        known = self.pairs[last << 20 | token] = self.vocabulary.bytes_ids(self.names[last] + self.names[token]) == [last, token]
        return known

    def programme(self, data: bytes) -> list[int]:
        """The token count of every prefix of a piece's bytes, the empty one first."""
        token_of, known = self.vocabulary.ranks.get, self.pairs.get
        if len(self.pairs) > 4_000_000:
            self.pairs.clear()
        counts, last, begun = [0], [-1], 0
        for i in range(1, len(data) + 1):
            # one place is right, so the likely ones are tried first: the last token grows, or one more byte
            for j in (begun, i - 1, *range(max(0, i - self.longest), i - 1)):
                token = token_of(data[j:i])
                if token is None:
                    continue
                if j and (fits := known(last[j] << 20 | token)) is not True and (fits is False or not self.follows(last[j], token)):
                    continue
                counts.append(counts[j] + 1)
                last.append(token)
                begun = j
                break
            else:
                raise ValueError("a byte is not in the vocabulary")
        return counts

    def at_characters(self, piece: str) -> list[int]:
        counts = self.programme(piece.encode())
        if len(counts) == len(piece) + 1:
            return counts[1:]
        ends = np.cumsum([len(c.encode()) for c in piece])
        return [counts[e] for e in ends]

    def changes(self, piece: str) -> list[int]:
        counts = self.at_characters(piece)
        if piece[0] == "'" and len(piece) > 2 and piece[1:].isalpha():
            counts[1] = self.at_characters("'")[-1] + self.at_characters(piece[1])[-1]  # two pieces until the contraction is whole
        return [b - a for a, b in zip([0, *counts], counts)]

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Changes of the count at each character of each text, without special strings."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for spans, points, kind, start in steps(texts):
            start = start[kind[start] != END]
            ends = np.flatnonzero(kind == END)
            stop = np.minimum(np.append(start[1:], len(points)), ends[np.searchsorted(ends, start)]) if len(start) else start
            changes = np.zeros(len(points), np.int16)
            if len(start):
                text = points.tobytes()
                word = lambda i: text[4 * start[i] : 4 * stop[i]].decode("utf-32-le")  # noqa: B023, E731
                row = self.table.rows(span_hashes(points, start, stop), word)
                changes[kind != END] = self.table.gather(row)[0]
                first = kind[start] == SPACE
                follow = np.flatnonzero(first[1:] & first[:-1] & (kind[stop[:-1] - 1] == SPACE) & (start[1:] == stop[:-1])) + 1
                for i in follow:  # white space so far is one piece until something else follows
                    before = word(i - 1)
                    grown = self.at_characters(before + word(i)[0])[-1] - self.at_characters(before)[-1]
                    changes[start[i]], old = grown, int(changes[start[i]])
                    if stop[i] - start[i] > 1:
                        changes[start[i] + 1] += old - grown
                    elif i + 1 < len(start) and start[i + 1] == stop[i]:
                        changes[start[i + 1]] += old - grown
            at = 0
            for i, n in spans:
                parts[i].append(changes[at : at + n])
                at += n + 1
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.empty(0, np.int16) for p in parts]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        special = self.vocabulary.special
        rare = [i for i, t in enumerate(texts) if any(s in t for s in special)]
        if not rare:
            return self.plain(texts)
        skip = set(rare)
        out = self.plain(["" if i in skip else t for i, t in enumerate(texts)])
        name = {i: s for s, i in special.items()}
        for i in rare:
            made: list[np.ndarray] = []
            for text, token in self.vocabulary.segments(texts[i]):
                tail = name[token] if token is not None else ""
                changes = self.plain([text + tail[:-1]])[0].astype(np.int64)
                if tail:
                    whole = int(changes[: len(text)].sum()) + 1
                    changes = np.append(changes, whole - int(changes.sum()))
                made.append(changes)
            out[i] = np.concatenate(made).astype(np.int16)
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One counter for each worker process and vocabulary."""
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and prefix_tokens: for each character of the
    text, the change of the count there as a little-endian 16-bit number."""

    def run(batches):
        count = counter(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            changes = count(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([int(c.sum(dtype=np.int64)) for c in changes], pa.int64()),
                    pa.array([c.tobytes() for c in changes], pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "prefix_tokens"],
            )

    return map_arrow(doc_text(docs, id_col, text_col), run, SCHEMA)


def counts_of(prefix_tokens: bytes) -> np.ndarray:
    """The token count at every prefix, the empty one first."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(prefix_tokens, "<i2"), dtype=np.int64)])


def tokens_at(prefix_tokens: bytes, characters: int) -> int:
    """Tokens of the text cut after so many characters."""
    return int(np.frombuffer(prefix_tokens, "<i2")[:characters].sum(dtype=np.int64))


def longest_within(prefix_tokens: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most `budget` tokens."""
    return int(np.flatnonzero(counts_of(prefix_tokens) <= budget)[-1])


def truncated(counted: DataFrame, docs: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts cut to their longest prefix within the budget, from stored counts;
    ids must be unique in both tables."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([longest_within(p, budget) for p in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "kept_chars"])

    kept = map_arrow(counted.select("doc_id", "prefix_tokens"), run, "doc_id long, kept_chars long")
    return doc_text(docs, id_col, text_col).join(kept, "doc_id").select("doc_id", F.expr("substring(text, 1, cast(kept_chars as int))").alias("text"), "kept_chars")
