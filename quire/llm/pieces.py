"""Pieces of the byte-level vocabulary's own split, found with array
operations, and a bounded table of what was worked out for each piece.

The split is the published one: a contraction ('s 't 're 've 'm 'll 'd), or a
run of letters, of numbers, or of other characters, each with one leading
space if there is one, or white space; the last white space before a run
stands alone unless it is the space that the run takes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np

SPACE, LETTER, NUMBER, OTHER, END = 0, 1, 2, 3, 4
#: Characters of one array step, and pieces kept in a table before it starts anew.
STEP_CHARS = 1 << 20
TABLE_PIECES = 3_000_000
FRONT_BITS = 20
_MULTIPLIER = 0x9E3779B97F4A7C15

_kinds: np.ndarray | None = None
_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def kinds() -> np.ndarray:
    """The kind of every code point."""
    global _kinds
    if _kinds is None:
        import regex

        points = [*range(0xD800), *range(0xE000, 0x110000)]
        every = "".join(map(chr, points))
        at = np.array(points)
        out = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"[\t-\r \x85\p{Z}]+")):
            for m in regex.finditer(pattern, every):
                out[at[m.start() : m.end()]] = kind
        _kinds = out
    return _kinds


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]))
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        made = []
        for factor in (_MULTIPLIER, inverse):
            x = np.full(m, factor, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _powers = (made[0], made[1])
    return _powers


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end]."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(0x51ED27)) * up[: len(values)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def piece_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pieces start; END marks stand alone."""
    n = len(points)
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
    after = np.append(kind[1:], np.uint8(END))
    last = (kind == SPACE) & (after != SPACE) & (after != END)
    start |= last
    glued = last & (points == 32)
    start[1:][glued[:-1]] = False
    quote = np.flatnonzero((points == 39) & start & (after == LETTER))
    if len(quote):
        wide = np.append(points, [0, 0, 0])
        one, two = wide[quote + 1], wide[quote + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.isin(one.astype(np.int64) << 24 | two, [ord(a) << 24 | ord(b) for a, b in ("re", "ve", "ll")])
        taken, length = quote[single | double], np.where(single, 2, 3)[single | double]
        start[taken + 1] = False
        stop = taken + length
        start[stop[stop < n]] = True
        start[(taken + 2)[length == 3]] = False
    return np.flatnonzero(start)


class PieceTable:
    """Values worked out once for each distinct piece, kept in flat arrays.

    work(piece) gives a list of numbers. The table starts anew beyond
    TABLE_PIECES, so its memory is bounded; only time is lost by that."""

    def __init__(self, work: Callable[[str], list[int]], dtype) -> None:
        self.work, self.dtype = work, dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.order = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.start, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.values = np.empty(0, self.dtype)
        self.used = 0
        self.front_key = np.zeros(1 << FRONT_BITS, np.uint64)
        self.front = np.full(1 << FRONT_BITS, -1, np.int64)

    def rows(self, hashes: np.ndarray, piece: Callable[[int], str]) -> np.ndarray:
        """Row of each piece; piece(i) gives the text of the i-th."""
        if len(self.keys) > TABLE_PIECES:
            self.clear()
        slot = (hashes >> np.uint64(64 - FRONT_BITS)).astype(np.int64)
        row = self.front[slot]
        away = np.flatnonzero((row < 0) | (self.front_key[slot] != hashes))
        if len(away):
            some, first, back = np.unique(hashes[away], return_index=True, return_inverse=True)
            place = np.searchsorted(self.keys, some)
            known = place < len(self.keys)
            known[known] = self.keys[place[known]] == some[known]
            found = np.empty(len(some), np.int64)
            found[known] = self.order[place[known]]
            if not known.all():
                fresh = np.flatnonzero(~known)
                made = [self.work(piece(int(away[first[j]]))) for j in fresh]
                counts = np.fromiter(map(len, made), np.int64, len(made))
                flat = np.fromiter((x for m in made for x in m), self.dtype, int(counts.sum()))
                found[fresh] = len(self.start) + np.arange(len(fresh))
                self.start = np.append(self.start, self.used + np.cumsum(counts) - counts)
                self.count = np.append(self.count, counts)
                if self.used + len(flat) > len(self.values):
                    self.values = np.append(self.values[: self.used], np.empty(max(len(flat), self.used, 1 << 16), self.dtype))
                self.values[self.used : self.used + len(flat)] = flat
                self.used += len(flat)
                self.keys = np.insert(self.keys, place[fresh], some[fresh])
                self.order = np.insert(self.order, place[fresh], found[fresh])
            row[away] = found[back]
            self.front_key[slot[away]], self.front[slot[away]] = hashes[away], row[away]
        return row

    def gather(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these rows in turn, and how many each row has."""
        count = self.count[row]
        before = np.cumsum(count) - count
        return self.values[np.repeat(self.start[row] - before, count) + np.arange(int(count.sum()))], count


def byte_letters() -> dict[str, int]:
    """The vocabulary's letters for bytes: printable bytes stand for
    themselves, the others for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ranks and special strings of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {bytes(letter[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = special
        import regex
        import tiktoken

        self.special_split = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        # each call gets one piece, so the split pattern takes all of it
        self.encoding = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})

    def ids(self, piece: str) -> list[int]:
        return self.encoding.encode_ordinary(piece)

    def bytes_ids(self, piece: bytes) -> list[int]:
        return self.encoding._encode_single_piece(piece)

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """(plain text, special id or None): the special string that ends each
        stretch of plain text."""
        at = 0
        if self.special_split is not None and any(s in text for s in self.special):
            for m in self.special_split.finditer(text):
                yield text[at : m.start()], self.special[m[0]]
                at = m.end()
        yield text[at:], None


def steps(parts: list[str], limit: int = STEP_CHARS) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]]:
    """Array steps over many texts: ([(text, its characters here)], code
    points, kinds, piece starts). Texts follow one another with an END mark
    after each; a text longer than a step is cut where a piece starts."""
    group: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(parts):
        at = 0
        while len(text) - at > limit:
            if group:
                yield _step(group)
                group, size = [], 0
            width = limit
            while True:
                some = text[at : at + width]
                if at + width >= len(text):
                    cut = len(some)
                    break
                _, points, kind, start = _step([(i, some)])
                safe = start[1:-4][kind[np.maximum(start[1:-4] - 1, 0)] != SPACE]
                if len(safe):
                    cut = int(safe[-1])
                    break
                width *= 2
            yield _step([(i, some[:cut])])
            at += cut
        rest = text[at:] if at else text
        if size + len(rest) > limit and group:
            yield _step(group)
            group, size = [], 0
        group.append((i, rest))
        size += len(rest) + 1
    if group:
        yield _step(group)


def _step(group: list[tuple[int, str]]):
    points = np.frombuffer(("\0".join(t for _, t in group) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = [len(t) for _, t in group]
    kind = kinds()[points]
    kind[np.cumsum(np.array(lengths) + 1) - 1] = END
    return [(i, n) for (i, _), n in zip(group, lengths, strict=True)], points, kind, piece_starts(points, kind)
