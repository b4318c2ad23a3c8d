"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are taken as lower-case letters and digits with one
space for anything between. Items are cut into windows of WINDOW characters, a
STEP apart (shorter items are one window), so any quote of WINDOW + STEP - 1
characters of an item holds a whole window. A window of m characters occurs in a
text if some stretch of the text is within e = rate * m edits of it. Such an
occurrence shares at least m - q + 1 - q * e q-grams with the window, all within
e + 1 diagonals. Diagonals are covered by bands wider than e that overlap by e;
per (text, window, band) the shared q-grams, by their place in the window, are
counted, regions that reach the bound are retained, and each is verified by an
alignment that fills the cells of the band only. Items under q characters are
found whole, as words of the text.

The benchmark is a stated query set: it is compared with all texts in blocks
of bounded size, each sent to the tasks with its q-gram index; texts are
neither shuffled nor paired. Shared q-grams are taken in steps of the text, so
memory does not grow with how often a q-gram repeats.

Defined results: a null or empty text or item matches nothing, nor does an item
without letters and digits; a null doc or item id stays null; repeated rows
give the same matches each; empty tables give no rows; other columns are not
read. Texts of any length are searched whole.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import doc_text, map_arrow
from quire.llm.pieces import LETTER, NUMBER, kinds, powers

Q = 10
EDIT_RATE = 0.08
#: Characters of a window, and from one window to the next.
WINDOW, STEP = 120, 60
#: Characters of the benchmark in one block, as expected.
BLOCK_CHARS = 2_000_000
#: Characters searched in one array step, and bits of the first look-up.
STEP_CHARS = 1 << 20
FILTER_BITS = 22
#: Shared q-grams held at once, if one stretch of the text of a band's reach does not hold more.
STEP_HITS = 1 << 21
#: More edits than any window allows.
FAR = 1 << 30

SCHEMA = "doc_id long, item_id long, distance long, start long, end long, windows long, of_windows long"

_folds: np.ndarray | None = None


def folds() -> np.ndarray:
    """For every code point its lower case if it is one letter or digit, else 0."""
    global _folds
    if _folds is None:
        out = np.where((kinds() == LETTER) | (kinds() == NUMBER), np.arange(0x110000, dtype=np.uint32), np.uint32(0)).astype(np.uint32)
        for p in np.flatnonzero(out).tolist():
            low = chr(p).lower()
            if len(low) == 1:
                out[p] = ord(low)
        _folds = out
    return _folds


def normalised(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters with 32 for each gap, and the place of each in `points`."""
    low = folds()[points]
    keep = low != 0
    keep[1:] |= low[:-1] != 0
    where = np.flatnonzero(keep)
    out = low[where]
    out[out == 0] = 32
    return out, where


def of_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    return normalised(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))


def qgrams(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit number for each q-gram."""
    if len(chars) < q:
        return np.empty(0, np.uint64)
    up, down = powers(len(chars) + 1)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(977)) * up[: len(chars)], out=sums[1:])
    return (sums[q:] - sums[:-q]) * down[: len(chars) - q + 1]


def window_starts(length: int, window: int, step: int) -> list[int]:
    """Where windows start: a step apart, the last at the end."""
    return [0] if length <= window else [*range(0, length - window, step), length - window]


class Index:
    """The q-gram index of one block of items (item_id, text), cut into windows."""

    def __init__(self, items: list[tuple[int | None, str]], q: int = Q, rate: float = EDIT_RATE, window: int = WINDOW, step: int = STEP) -> None:
        self.q = q
        self.ids: list[int | None] = []
        #: Windows of each item; each window's characters and its item.
        self.windows, self.texts, self.owner, budget = [], [], [], []
        #: Items under q characters by length: the numbers of their characters between two spaces, in order, and whose they are.
        short: dict[int, dict[bytes, list[int]]] = {}
        for item, text in items:
            chars = of_text(text)[0]
            chars = chars[:-1] if len(chars) and chars[-1] == 32 else chars
            chars = chars[1:] if len(chars) and chars[0] == 32 else chars
            if not len(chars):
                continue
            if len(chars) < q:
                short.setdefault(len(chars), {}).setdefault(np.pad(chars, 1, constant_values=32).astype("<u4").tobytes(), []).append(len(self.ids))
                self.windows.append(1)
            else:
                starts = window_starts(len(chars), max(window, q), step)
                for at in starts:
                    self.texts.append(chars[at : at + max(window, q)])
                    self.owner.append(len(self.ids))
                    budget.append(min(math.floor(rate * len(self.texts[-1])), (len(self.texts[-1]) - q) // q))
                self.windows.append(len(starts))
            self.ids.append(item)
        self.short = [(n, wanted, np.unique(np.concatenate([qgrams(np.frombuffer(w, "<u4"), n + 2) for w in wanted]))) for n, wanted in short.items()]
        self.budget = np.array(budget, np.int64)
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.bound = lengths - q + 1 - q * self.budget
        self.shift = np.array([int(e).bit_length() for e in budget], np.int64)  # bands of 2^shift > e diagonals
        #: Characters of a text that the shared q-grams of one band span at most.
        self.reach = int((lengths + (1 << self.shift)).max(initial=0))
        grams = [qgrams(t, q) for t in self.texts]
        keys = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.empty(0, np.int64)
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, chars: np.ndarray):
        """(place in chars, window, place in window) of every shared q-gram, in
        steps. A step begins a band's reach before the last one's end, so all
        of a band's q-grams are in one step."""
        grams = qgrams(chars, self.q)
        at = np.flatnonzero(self.filter[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        row = np.minimum(np.searchsorted(self.keys, grams[at]), max(len(self.keys) - 1, 0))
        same = self.keys[row] == grams[at] if len(at) else np.empty(0, bool)
        at, row = at[same], row[same]
        sums = np.append(0, np.cumsum(self.count[row]))
        first = 0
        while first < len(at):
            last = max(int(np.searchsorted(sums, sums[first] + STEP_HITS, side="right")) - 1, int(np.searchsorted(at, at[first] + 2 * self.reach)))
            some, which = at[first:last], row[first:last]
            count = self.count[which]
            each = np.repeat(self.first[which] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            yield np.repeat(some, count), self.item[each], self.place[each]
            if last >= len(at):
                return
            first = int(np.searchsorted(at, at[last] - self.reach))

    def short_hits(self, chars: np.ndarray):
        """(place in chars, length, item) of the items under q characters; texts are parted by 0."""
        if self.short:
            spaced = np.append(np.append(32, np.where(chars == 0, 32, chars)), 32).astype(np.uint32)
        for n, wanted, keys in self.short:
            for at in np.flatnonzero(np.isin(qgrams(spaced, n + 2), keys)).tolist():
                for item in wanted.get(spaced[at : at + n + 2].astype("<u4").tobytes(), ()):
                    if not (chars[at : at + n] == 0).any():
                        yield at, n, item

    def regions(self, at: np.ndarray, item: np.ndarray, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Rows (doc, item, band) whose shared q-grams reach the item's bound."""
        diagonal = at - place
        band = diagonal >> self.shift[item]
        low = np.flatnonzero(diagonal - (band << self.shift[item]) < self.budget[item])
        rows = np.stack([np.append(doc, doc[low]), np.append(item, item[low]), np.append(band, band[low] - 1), np.append(place, place[low])], 1)
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        fresh = np.append(True, (rows[1:] != rows[:-1]).any(1))
        rows = rows[fresh]
        edge = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1)))
        enough = np.diff(np.append(edge, len(rows))) >= self.bound[rows[edge, 1]]
        return rows[edge[enough], :3]

    def verified(self, chars: np.ndarray, item: int, band: int, base: int) -> tuple[int, int, int] | None:
        """(distance, start, end) in `chars` of the window's best occurrence in the band, if within the budget."""
        text, budget, width = self.texts[item], int(self.budget[item]), 1 << int(self.shift[item])
        low = (band << int(self.shift[item])) - base - budget
        costs = aligned(text, chars, low, width + 2 * budget, free=True)
        k = int(np.argmin(costs))
        distance = int(costs[k])
        if distance > budget:
            return None
        end = min(max(len(text) + low + k, 0), len(chars))
        back = aligned(text[::-1], chars[max(0, end - len(text) - budget) : end][::-1], -budget, 2 * budget + 1)
        length = min(max(len(text) - budget + int(np.argmin(back)), 0), end)
        return distance, end - length, end


def aligned(text: np.ndarray, chars: np.ndarray, low: int, width: int, free: bool = False) -> np.ndarray:
    """Edits of the whole `text` against stretches of `chars` by the diagonal
    (low, low + 1, ... of `width`) on which they end; only cells of these
    diagonals are filled. Stretches start at place 0, or anywhere if free.
    Places outside `chars` hold nothing that could match."""
    steps = np.arange(width)
    first = max(low, 0)
    inside = chars[first : max(first, low + width + len(text))]
    padded = np.full(width + len(text), FAR, np.int64)
    padded[first - low : first - low + len(inside)] = inside
    row = np.zeros(width, np.int64) if free else np.where(low + steps < 0, FAR, low + steps)
    for i, c in enumerate(text.tolist()):
        grown = row + (padded[i : i + width] != c)
        grown[:-1] = np.minimum(grown[:-1], row[1:] + 1)
        if not free and low + i + 1 <= 0 < low + i + 1 + width:
            grown[-(low + i + 1)] = min(grown[-(low + i + 1)], i + 1)  # place 0: every character so far is missing
        row = np.minimum.accumulate(grown - steps) + steps
    return row


def stretches(texts: list[str]):
    """(first, last) of texts searched in one array step."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < STEP_CHARS):
            size += len(texts[upto])
            upto += 1
        yield at, upto
        at = upto


def _search(index: Index):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(ids[a + d], index.ids[i], *found, n, index.windows[i]) for a, b in stretches(texts) for d, i, found, n in searched(index, texts[a:b])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "distance", "start", "end", "windows", "of_windows"])

    return run


def searched(index: Index, texts: list[str]) -> list[tuple[int, int, tuple[int, int, int], int]]:
    """(text, item, (distance, start, end), windows): the best occurrence of
    a window of each item in each text, in code points of the text, and how many of the item's windows occur."""
    if not index.ids:
        return []
    made = [of_text(t) for t in texts]
    ends = np.cumsum([len(c) + 1 for c, _ in made])
    joined = np.concatenate([np.append(c, np.uint32(0)) for c, _ in made])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    seen: dict[tuple[int, int], set[int]] = {}

    def add(d: int, item: int, window: int, span: tuple[int, int, int]) -> None:
        seen.setdefault((d, item), set()).add(window)
        if (d, item) not in best or span < best[d, item]:
            best[d, item] = span

    for at, n, item in index.short_hits(joined):
        d = int(np.searchsorted(ends, at, side="right"))
        if (d, item) not in best:  # by place, so the first
            start = at - (int(ends[d]) - len(made[d][0]) - 1)
            add(d, item, 0, (0, int(made[d][1][start]), int(made[d][1][start + n - 1]) + 1))
    exact: set[tuple[int, int]] = set()
    for at, window, place in index.hits(joined):
        doc = np.searchsorted(ends, at, side="right")
        if exact:
            left = ~np.isin(doc * len(index.texts) + window, [d * len(index.texts) + w for d, w in exact])
            at, window, place, doc = at[left], window[left], place[left], doc[left]
            if not len(at):
                continue
        for d, w, band in index.regions(at, window, place, doc).tolist():
            if (d, w) in exact:  # bands come in order, so a later one has no better place
                continue
            chars, where = made[d]
            if found := index.verified(chars, w, band, int(ends[d]) - len(chars) - 1):
                distance, start, end = found
                add(d, index.owner[w], w, (distance, int(where[start]), int(where[end - 1]) + 1) if end > start else (distance, 0, 0))
                if distance == 0:
                    exact.add((d, w))
    return [(d, i, span, len(seen[d, i])) for (d, i), span in sorted(best.items())]


def _blocks(benchmark: DataFrame, q: int, rate: float, block_chars: int):
    """The indexes of the benchmark's blocks, one after another."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield Index([tuple(r) for r in block.collect()], q, rate)


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start, end (code points) of the best occurrence of a window of each item in each text, windows that occur, windows of the item."""
    rows = doc_text(docs, id_col, text_col)
    found = [map_arrow(rows, _search(index), SCHEMA) for index in _blocks(benchmark, q, rate, block_chars)]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], SCHEMA)


def without_matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no window of an item; each block of the benchmark filters what is left."""
    at = docs.columns.index(text_col)

    def run(index):
        def kept(batches):
            for batch in batches:
                texts = [t or "" for t in batch.column(at).to_pylist()]
                held: set[int] = set()
                for a, b in stretches(texts):
                    held |= {a + d for d, *_ in searched(index, texts[a:b])}
                yield batch.filter(pa.array([i not in held for i in range(len(texts))], pa.bool_()))

        return kept

    for index in _blocks(benchmark, q, rate, block_chars):
        docs = docs.mapInArrow(run(index), docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each text with a match: doc_id, the items' ids, the number of matches, the least distance."""
    return matches(docs, benchmark, **options).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count(F.lit(1)).alias("n_matches"), F.min("distance").alias("least_distance")
    )
