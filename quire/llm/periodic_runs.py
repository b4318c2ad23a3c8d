"""Periodic run detection by an online sparse diagonal programme.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and length >= max(least, 2 * q) that no neighbouring word
extends. On the diagonal of lag q, on which word i meets word i - q, a run is a
stretch of at least max(q, least - q) matches.

Words are read in order. The earlier occurrences of what is read name the lags
that match there: a lag active at the step before grows in length, another one
starts, and one that is not met again ends; a diagonal that ends with enough
matches is emitted, with the smallest period of equal stretches. Steps are
words for short lags. For lags from 2 * g on they are blocks of g words, g a
power of two: a run of such a lag matches over at least 2 * g words, hence over
a whole aligned block, so nothing is lost, and as only occurrences up to 4 * g
words earlier count, a level meets at most three for each word of the text,
however often its words repeat. Ends inside a block are found by the halves of
blocks, down to words. Levels end when no block of the text repeats.

Blocks are compared by 64-bit hashes of their two halves, worked out anew for
each document, so equal hashes of different blocks are to be expected once in
about 10^7 documents of a million words.

Each document is worked on by itself, documents of a task in batches of about
BATCH_WORDS words; nothing is shuffled. Memory is linear in a batch or in one
longer text, times the levels it needs (two or three, but for texts that repeat
long blocks).

Defined results: a null or empty text, or one of white space, has no words and
no runs, and an empty collapsed text; a null id stays null; repeated rows are
documents of their own; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WORD, doc_text, map_arrow
from quire.llm.pieces import mixed

#: Least length of a run, in words.
LEAST = 12
#: Words of documents that are worked on together.
BATCH_WORDS = 1 << 19

_HALF = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Levels:
    """Hashes of the blocks of 1, 2, 4, ... words that start at each word of some documents."""

    def __init__(self, words: np.ndarray, document: np.ndarray) -> None:
        own = mixed(document.astype(np.uint64) * _HALF + np.uint64(1))
        self.hashes = [mixed(words.astype(np.uint64) ^ own)]
        self.n = len(words)

    def of(self, level: int) -> np.ndarray:
        """The hash of each block of 2^level words; blocks beyond the end are left out."""
        while len(self.hashes) <= level:
            last, half = self.hashes[-1], 1 << (len(self.hashes) - 1)
            self.hashes.append(mixed(last[:-half] * _HALF + np.uint64(len(self.hashes)) ^ (last[half:] >> np.uint64(1))) if len(last) > half else last[:0])
        return self.hashes[level]

    def before(self, at: np.ndarray, lag: np.ndarray, level: int) -> np.ndarray:
        """How many words before `at` match those `lag` earlier; fewer than 2^level do."""
        back = np.zeros(len(at), np.int64)
        for k in range(level - 1, -1, -1):
            here = at - back - (1 << k)
            inside = here >= lag
            here = np.where(inside, here, lag)
            hashes = self.hashes[k]
            back += np.where(inside & (hashes[here] == hashes[here - lag]), 1 << k, 0)
        return back

    def after(self, at: np.ndarray, lag: np.ndarray, level: int) -> np.ndarray:
        """How many words from `at` on match those `lag` earlier; fewer than 2^level do."""
        on = np.zeros(len(at), np.int64)
        for k in range(level - 1, -1, -1):
            hashes = self.hashes[k]
            here = at + on
            inside = here < len(hashes)
            here = np.where(inside, here, lag)
            on += np.where(inside & (hashes[here] == hashes[here - lag]), 1 << k, 0)
        return on


def occurrences(hashes: np.ndarray, kept: np.ndarray, step: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, lag) for every block at a multiple of `step` and each of its earlier
    occurrences `low` to `high` - 1 words before, and the places whose block repeats."""
    some = hashes[kept]
    order = np.argsort(some, kind="stable")
    place, some = kept[order], some[order]
    fresh = np.append(True, some[1:] != some[:-1])
    group = np.cumsum(fresh) - 1
    repeats = ~fresh
    repeats[:-1] |= ~fresh[1:]
    place, group = place[repeats], group[repeats]
    if not len(place):
        return place, place, place
    wide = int(place.max()) + 1 + high
    sorted_keys = group * wide + place
    read = place % step == 0
    at, base = place[read], group[read] * wide
    first = np.searchsorted(sorted_keys, base + np.maximum(at - high + 1, 0))
    last = np.searchsorted(sorted_keys, base + at - low, side="right")
    last = np.where(at >= low, last, first)
    count = np.maximum(last - first, 0)
    index = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    whole = np.repeat(at, count)
    return whole, whole - place[index], np.sort(place)


def diagonals(at: np.ndarray, lag: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, lag) of the blocks that follow one another on a diagonal."""
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    first = np.append(True, (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + step))
    last = np.append(first[1:], True)
    return at[first], at[last] + step, lag[first]


def runs(words: np.ndarray, document: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period. `words` numbers the
    words of documents one after the other, `document` says whose each word is."""
    levels = Levels(words, document)
    longest = int(np.bincount(document).max(initial=0)) if len(document) else 0
    found: list[tuple[np.ndarray, ...]] = []
    kept, level = np.arange(levels.n), 0
    while len(kept) > 1 and longest >= least:
        step = 1 << level
        low, high = (1, 4) if level == 0 else (2 * step, 4 * step)
        if 2 * low > longest:
            break
        hashes = levels.of(level)
        at, lag, kept = occurrences(hashes, kept[kept < len(hashes)], step, low, high)
        if len(at):
            start, end, lag = diagonals(at, lag, step)
            if level:
                start = start - levels.before(start, lag, level)
                end = end + levels.after(end, lag, level)
            enough = end - start >= np.maximum(lag, least - lag)
            found.append((start[enough] - lag[enough], end[enough], lag[enough]))
        if len(kept):  # a block repeats only if both halves do
            held = np.zeros(levels.n + step, bool)
            held[kept] = True
            kept = kept[held[kept + step]]
        level += 1
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, end, period = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _batch(ids: list, split: list[list[bytes]], least: int) -> pa.RecordBatch:
    """The rows of SCHEMA for documents that are given as words."""
    counts = np.fromiter(map(len, split), np.int64, len(split))
    known: dict[bytes, int] = {}
    number = known.setdefault
    words = np.fromiter((number(w, len(known)) for words in split for w in words), np.int64, int(counts.sum()))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    start, end, period = runs(words, np.repeat(np.arange(len(split)), counts), least)
    edges = np.searchsorted(start, bounds)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, start + period, 1)
    np.add.at(covered, end, -1)
    dropped = np.cumsum(covered) > 0
    texts = []
    for i, own in enumerate(split):
        if edges[i] < edges[i + 1]:
            own = [w for w, d in zip(own, dropped[bounds[i] : bounds[i + 1]].tolist(), strict=True) if not d]
        texts.append(b" ".join(own).decode())
    rows = pa.StructArray.from_arrays([pa.array(start - np.repeat(bounds[:-1], np.diff(edges))), pa.array(end - start), pa.array(period)], fields=list(_RUNS.value_type))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(counts), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows).cast(_RUNS), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
    )


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and
    collapsed (the words that no run holds after its first period, joined by
    one space), one row for each document."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, split, words = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                split.append(text.as_py().encode().split())  # bytes: only \x20 and \x09-\x0D part words
                words += len(split[-1])
                if words >= BATCH_WORDS:
                    yield _batch(ids, split, least)
                    ids, split, words = [], [], 0
            if ids:
                yield _batch(ids, split, least)

    return map_arrow(doc_text(docs, id_col, text_col), run, SCHEMA)


def with_planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` as the contract of the query changes them: with h = crc32 of the
    decimal id, n words and g = h div 10, a text whose h ends in 0 repeats
    itself from word a = g mod n on with period 1 + (n - a) div (3 + g mod 8).
    Other texts, and those without id or words, stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1))

    def planted(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = F.lit(1) + F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3))
        times = F.floor((n - a + p - 1) / p)
        again = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), times.cast("int")))
        every = F.slice(F.concat(F.slice(w, F.lit(1), a.cast("int")), again), F.lit(1), n.cast("int"))
        return F.when(n > 0, F.concat_ws(" ", every)).otherwise(F.col(text_col))

    once = F.element_at(F.transform(F.array(words), planted), 1)  # the words are cut once
    return docs.withColumn(text_col, F.when(F.pmod(h, F.lit(10)) == 0, once).otherwise(F.col(text_col)))
