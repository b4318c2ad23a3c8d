"""N-gram Jaccard join by signature trees.

A text's set holds its distinct shingles (`size` words each). Two texts link
when 100 * intersection >= percent * union. The result is a class for each
document, not pairs.

1. Equal sets are one class (a hash of the set; copies are counted together
   before the shuffle), with the smallest id as its representative.
2. Of two sets that link, at most s - ceil(percent * s / 100) shingles of the
   one with s are not in the other. So shingles of a fixed share of the hash
   space are counted over all distinct sets, and a set with more than that many
   shingles of its own is out: texts that merely share passages go here. A
   shingle in many sets of a batch is known to be shared and is not sent for all.
3. Candidates among the rest, without loss: if two sets link, at most d = s * (100 - percent) /
   percent shingles differ, s being the smaller size. Cut the hash space into
   d + 1 ranges: some range holds the same shingles in both sets. Sizes fall
   into classes so that a link joins a class and itself or the next, and each
   set gives one key per range for both. Sets of a batch that hang together by keys
   are tied there, one tie a set, and send each key once, as their smallest
   set's. Keys travel in packed arrays, one per
   bucket and batch; sets that share a key are candidates, and a task ties each
   to the smallest it hangs together with, so no key gives pairs; what several
   tasks say of one set is brought to one tie.
4. Candidates that hang together form a block. As long as it helps, large
   blocks are parted by other cuts of the hash space, which tie all that links
   but not what merely shares a passage. A block is dealt into chunks of bounded
   size. In a chunk, sets (as bitmaps of one bit per shingle hash,
   about a bit or two per shingle) are leaves of a tree whose inner nodes hold
   the OR of their bitmaps and the range of their sizes; two nodes are
   traversed together and dropped when the largest possible overlap of any two
   sets below cannot reach a link, or when all below are linked already. Pairs
   of leaves that remain are checked on the shingles.
5. A block of several chunks: rounds of pivots. The sets outside the block's
   largest component become pivots, up to a chunk at a time, and are compared
   with every chunk by the same traversal, until no set outside the largest
   component is left that has not been compared with all. So near copies of
   one text are tied in one round, and no pair is given up.

Defined results: null or empty texts have empty sets and link with nothing; a
text with fewer words has one shingle, all its words; a null id stays null and
links with nothing; a repeated id is one document per row, with the same
class; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Scratch, doc_text, map_arrow
from quire.llm.pieces import mixed

SHINGLE = 4
PERCENT = 85
#: Sets in one chunk of a block, and sets below one node of a tree.
CHUNK, FANOUT = 4096, 16
#: Shingles in one chunk, as expected.
CHUNK_SHINGLES = 4_000_000
#: Candidates sent to all tasks at most (five numbers each, under 100 MB in memory).
BROADCAST_ROWS = 500_000
#: Texts of one packed array of keys, and sets among them that make a shingle known as shared.
BATCH_TEXTS, SHARED_SETS = 2000, 64


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only \\x20 and \\x09-\\x0D part words
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(h) < size:
        size = len(h)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = (out ^ h[i : len(h) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(mixed(out + np.uint64(size)))


def set_hashes(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, as signed numbers."""
    one = int(np.add.reduce(found, dtype=np.uint64))
    two = int(np.bitwise_xor.reduce(mixed(found ^ np.uint64(0xA0761D6478BD642F)))) if len(found) else 0
    return tuple(x - (1 << 64) if x >> 63 else x for x in (one, two))


def size_classes(percent: int, upto: int) -> list[int]:
    """Least sizes of the size classes: a link joins sizes in one class or in neighbours."""
    out = [1]
    while out[-1] <= upto:
        out.append(out[-1] * 100 // percent + 1)
    return out


def set_keys(found: np.ndarray, classes: list[int], percent: int, seed: int = 0) -> np.ndarray:
    """Keys of a set, for its own size class and the one below as the class of
    the smaller set, of which at most `differ` shingles differ. More than
    `differ` ranges that hold shingles leave one of them alike, so ranges of
    three shingles or more give keys if there are that many, then those of two
    and of one too, then those of a finer cut: of two sets that link, both go on
    until one has enough."""
    own = int(np.searchsorted(classes, len(found), side="right")) - 1
    if seed:
        found = np.sort(mixed(found ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
    high, keys = found >> np.uint64(32), []
    for c in (own, own - 1):
        if c < 0:
            continue
        differ = (classes[c + 1] - 1) * (100 - percent) // percent
        ranges = (differ + 1) * 3 // 2
        while True:
            part = (high * np.uint64(ranges)) >> np.uint64(32)
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            sizes = np.diff(np.append(first, len(part)))
            every = mixed(np.add.reduceat(found, first) ^ mixed(part[first] + np.uint64((c << 40) + ranges * 3)))
            enough = 0
            for least in (3, 2, 1):
                use = every[sizes >= 3 if least == 3 else sizes == least]
                keys.append(use)
                enough += len(use)
                if enough > differ:
                    break
            if enough > differ or ranges >= 1 << 31:
                break
            ranges *= 2
    return np.concatenate(keys)


SETS = "doc_id long, n long, one long, two long, counted long"


def counted(found: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of the share of the hash space that is counted: enough to see that most are a set's own."""
    share = min(100, (100 - percent) * 8 // 5)
    return found[: np.searchsorted(found, np.uint64(((1 << 64) - 1) // 100 * share))]


def _sets(size: int, percent: int):
    def run(batches):
        for batch in batches:
            made = [shingles(t, size) for t in batch.column(1).to_pylist()]
            hashes = [set_hashes(m) for m in made]
            columns = [[len(m) for m in made], [h[0] for h in hashes], [h[1] for h in hashes], [len(counted(m, percent)) for m in made]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n", "one", "two", "counted"])

    return run


def _counted(size: int, percent: int, buckets: int):
    """Packed rows of counted shingles: 32 bits of each beside its set; without
    `keys`, sets and how many of their shingles are shared for certain."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), BATCH_TEXTS):
                made: dict[int, np.ndarray] = {}
                for doc, text in zip(ids[at : at + BATCH_TEXTS], texts[at : at + BATCH_TEXTS], strict=True):
                    if doc is not None and len(found := shingles(text, size)):
                        made[set_hashes(found)[0]] = counted(found, percent)
                if not made:
                    continue
                keys = np.concatenate(list(made.values()))
                ones = np.fromiter(made, np.int64, len(made))
                owner = np.repeat(ones, [len(k) for k in made.values()])
                order = np.argsort(keys, kind="stable")
                keys, owner = keys[order], owner[order]
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
                n = np.diff(np.append(first, len(keys)))
                place = np.arange(len(keys)) - np.repeat(first, n)
                sure = np.repeat(n, n) > SHARED_SETS  # two of them tell the other batches
                if sure.any():
                    some, times = np.unique(owner[sure], return_counts=True)
                    yield _packed_row(int(some[0]) % buckets, None, some, times.astype(np.int32))
                sent = ~sure | (place < 2)
                keys, owner, flag = mixed(keys[sent]), owner[sent], sure[sent]
                bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                keys, owner, bucket, flag = keys[order].astype(np.uint32), owner[order], bucket[order], flag[order]
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]).tolist() + [len(bucket)]
                for a, b in zip(cuts, cuts[1:]):
                    yield _packed_row(int(bucket[a]), keys[a:b], owner[a:b], flag[a:b].astype(np.int32))

    return run


def _packed_row(bucket: int, keys: np.ndarray | None, sets: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    held = (None if keys is None else keys.tobytes(), sets.tobytes(), times.astype(np.uint8).tobytes() if keys is not None else times.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *(pa.array([x], pa.binary()) for x in held)], ["bucket", "keys", "sets", "times"])


def _shared(batches):
    """(one, shared): how many counted shingles of a set are in other sets too, by task."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held, current = [], None

    def repeats():
        keys = np.concatenate([np.frombuffer(k, np.uint32) for k, _, _ in held])
        sets = np.concatenate([np.frombuffer(s, np.int64) for _, s, _ in held])
        told = np.concatenate([np.frombuffer(t, np.uint8) for _, _, t in held]) > 0  # counted by the batch itself
        order = np.lexsort((~told, sets, keys))
        keys, sets, told = keys[order], sets[order], told[order]
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1]))  # copies in other batches are one set
        keys, sets, told = keys[fresh], sets[fresh], told[fresh]
        alike = np.append(False, keys[1:] == keys[:-1])
        alike[:-1] |= alike[1:].copy()
        return np.unique(sets[alike & ~told], return_counts=True)

    for batch in batches:
        for bucket, keys, sets, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if keys is None:
                found.append((np.frombuffer(sets, np.int64), np.frombuffer(times, np.int32).astype(np.int64)))
                continue
            if held and bucket != current:
                found.append(repeats())
                held.clear()
            current = bucket
            held.append((keys, sets, times))
    if held:
        found.append(repeats())
    if found:
        sets, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        total = np.bincount(back, np.concatenate([f[1] for f in found]), len(sets)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sets), pa.array(total)], ["one", "shared"])


def _hang_together(root: dict[int, int], keys: np.ndarray, sets: np.ndarray) -> None:
    """Adds what keys tie to `root`: each set beside the smallest it hangs together with."""
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    same = np.append(False, keys[1:] == keys[:-1])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(keys))))
    pairs = np.stack([sets[start], sets], 1)[same & (sets[start] != sets)]
    for a, b in np.unique(pairs, axis=0).tolist() if len(pairs) else ():
        while a in root:
            a = root[a]
        while b in root:
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
    for a in root:
        while root[a] in root:
            root[a] = root[root[a]]


def _keys(size: int, percent: int, buckets: int, seed: int = 0):
    """One packed row for each batch and bucket: distinct keys, the place of each key's
    set in a list, and the list; without `keys`, ties of the batch: larger sets, and
    the smallest that each hangs together with as `places`. Sets of a batch that hang together send
    their keys as the smallest one's. Input: id, text, and the block that keys hold for."""

    def run(batches):
        classes = size_classes(percent, 1 << 16)
        for batch in batches:
            texts = [(t, b) for i, t, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) if i is not None]
            for at in range(0, len(texts), BATCH_TEXTS):
                made: dict[int, np.ndarray] = {}
                for text, block in texts[at : at + BATCH_TEXTS]:
                    found = shingles(text, size)
                    if len(found):
                        one = set_hashes(found)[0]
                        if one not in made:
                            if len(found) >= classes[-1]:
                                classes = size_classes(percent, 2 * len(found))
                            made[one] = mixed(set_keys(found, classes, percent, seed) + np.uint64(block & (1 << 64) - 1))
                if not made:
                    continue
                keys = np.concatenate(list(made.values()))
                sets = np.repeat(np.fromiter(made, np.int64, len(made)), [len(k) for k in made.values()])
                root: dict[int, int] = {}
                _hang_together(root, keys, sets)
                if root:
                    smaller, larger = _told(root)
                    row = (int(larger[0]) % buckets, None, smaller.tobytes(), larger.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "keys", "places", "sets"])
                keys, one = np.unique(keys, return_index=True)
                ones, owner = np.unique(np.array([root.get(x, x) for x in sets[one].tolist()]), return_inverse=True)
                bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                keys, owner, bucket = keys[order], owner[order], bucket[order]
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(keys)]
                rows = []
                for a, b in zip(cuts, cuts[1:]):
                    some, place = np.unique(owner[a:b], return_inverse=True)
                    rows.append((int(bucket[a]), keys[a:b].tobytes(), place.astype(np.uint16).tobytes(), ones[some].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "keys", "places", "sets"])

    return run


def _told(root: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(root.values(), np.int64, len(root)), np.fromiter(root, np.int64, len(root))


def _tied(smaller: np.ndarray, larger: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(smaller), pa.array(larger)], ["a", "b"])


def _ties(batches):
    """(smaller, larger) for the sets of a task that share a key or hang together by its keys, and the ties of batches."""
    held, current = [], None
    root: dict[int, int] = {}

    def tie():
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k, _, _ in held])
        sets = np.concatenate([np.frombuffer(s, np.int64)[np.frombuffer(p, np.uint16)] for _, p, s in held])
        _hang_together(root, keys, sets)

    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] is None:
                yield _tied(np.frombuffer(row[1], np.int64), np.frombuffer(row[2], np.int64))
                continue
            if held and bucket != current:
                tie()
                held.clear()
            current = bucket
            held.append(row)
    if held:
        tie()
    if root:
        yield _tied(*_told(root))


def single_ties(ties: DataFrame) -> DataFrame:
    """One tie (a, b) for each larger set b, and those of the smaller ones that several tasks name, which are few."""
    named = ties.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("a"))  # at most one a task
    first = F.element_at("a", 1)
    return named.select(F.explode(F.transform(F.col("a"), lambda x, i: F.struct(first.alias("a"), F.when(i == 0, F.col("b")).otherwise(x).alias("b")))).alias("t")).select("t.a", "t.b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of the edges (a, b), root the smallest node reached, by
    large and small stars; each step is written to the shared folder, and the
    one before deleted."""
    edges = scratch.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = scratch.stored(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        new = scratch.stored(small.where("a <> b").distinct(), "edges")
        scratch.drop(edges, large)
        edges = new
        before, state = state, tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


class Forest:
    """Signature trees over sets and the classes found so far.

    Leaves are ordered by size; the node over leaves [a, b) holds the OR of
    their bitmaps, the range of sizes, and the most shingles a leaf has beyond
    its bits."""

    def __init__(self, sets: list[np.ndarray], labels: list[int], percent: int) -> None:
        self.percent = percent
        self.sets = sets
        self.labels = np.array(labels)
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        bits = max(64, 1 << int(2 * self.sizes.max(initial=1) - 1).bit_length())
        self.maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, found in zip(self.maps, sets, strict=True):
            place = found & np.uint64(bits - 1)
            np.bitwise_or.at(row, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        self.extra = self.sizes - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        self.nodes: dict[tuple[int, int], tuple] = {}

    def node(self, a: int, b: int) -> tuple:
        if (found := self.nodes.get((a, b))) is None:
            found = self.nodes[a, b] = (np.bitwise_or.reduce(self.maps[a:b]), self.sizes[a:b].min(), self.sizes[a:b].max(), self.extra[a:b].max())
        return found

    def linked(self, i: int, j: int) -> bool:
        one, two = self.sets[i], self.sets[j]
        if len(one) > len(two):
            one, two = two, one
        place = np.searchsorted(two, one)
        both = int((two[np.minimum(place, len(two) - 1)] == one).sum())
        return 100 * both >= self.percent * (len(one) + len(two) - both)

    def merge(self, i: int, j: int) -> None:
        low, high = sorted((self.labels[i], self.labels[j]))
        self.labels[self.labels == high] = low

    def leaves(self, a: int, b: int, c: int, d: int) -> None:
        both = np.bitwise_count(self.maps[a:b, None] & self.maps[None, c:d]).sum(2, dtype=np.int64)
        most = np.minimum(both + np.minimum(self.extra[a:b, None], self.extra[None, c:d]), np.minimum(self.sizes[a:b, None], self.sizes[None, c:d]))
        fits = (100 + self.percent) * most >= self.percent * (self.sizes[a:b, None] + self.sizes[None, c:d])
        for i, j in np.argwhere(fits) + [a, c]:
            if i < j and self.labels[i] != self.labels[j] and self.linked(i, j):
                self.merge(i, j)

    def apart(self, a: int, b: int, c: int, d: int) -> bool:
        one, two = self.node(a, b), self.node(c, d)
        if 100 * one[2] < self.percent * two[1] or 100 * two[2] < self.percent * one[1]:
            return True
        most = min(int(np.bitwise_count(one[0] & two[0]).sum(dtype=np.int64)) + min(one[3], two[3]), one[2], two[2])
        return (100 + self.percent) * most < self.percent * (one[1] + two[1])

    def cross(self, a: int, b: int, c: int, d: int) -> None:
        """The dual traversal of the nodes over [a, b) and [c, d), which do not meet."""
        label = self.labels[a]
        if (self.labels[a:b] == label).all() and (self.labels[c:d] == label).all():
            return
        if self.apart(a, b, c, d):
            return
        if b - a <= FANOUT and d - c <= FANOUT:
            self.leaves(a, b, c, d)
            return
        for x, y in self.children(a, b):
            for z, w in self.children(c, d):
                self.cross(x, y, z, w)

    @staticmethod
    def children(a: int, b: int) -> list[tuple[int, int]]:
        if b - a <= FANOUT:
            return [(a, b)]
        step = FANOUT
        while step * FANOUT < b - a:
            step *= FANOUT
        return [(x, min(x + step, b)) for x in range(a, b, step)]

    def join(self, a: int, b: int) -> None:
        """All links below one node: its children first, then children with one another."""
        if b - a <= FANOUT:
            self.leaves(a, b, a, b)
            return
        parts = self.children(a, b)
        for x, y in parts:
            self.join(x, y)
        for i, one in enumerate(parts):
            for two in parts[i + 1 :]:
                self.cross(*one, *two)


def _grouped(batches, width: int):
    """Rows of a sorted partition, by their first `width` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:width] != key:
                yield key, rows
                rows = []
            key = row[:width]
            rows.append(row[width:])
    if rows:
        yield key, rows


def _chunks(size: int, percent: int):
    """(block, chunk, doc_id, label) of each chunk: links within it."""

    def run(batches):
        for (block, chunk), rows in _grouped(batches, 2):
            seen: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
            for doc, one, two, text in rows:
                found = shingles(text, size)
                if set_hashes(found) == (one, two):  # a repeated id may have other texts
                    seen[one, two] = (doc, found)
            members = sorted(seen.values(), key=lambda m: (len(m[1]), m[0]))
            if not members:
                continue
            forest = Forest([m[1] for m in members], [m[0] for m in members], percent)
            forest.join(0, len(members))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([block] * len(members), [chunk] * len(members), [m[0] for m in members], forest.labels.tolist())], ["block", "chunk", "doc_id", "label"])

    return run


def _against_pivots(size: int, percent: int):
    """(a, b): labels that a link between a pivot and a set of the chunk joins."""

    def run(batches):
        for _, rows in _grouped(batches, 2):
            sets = {(doc, pivot): (label, shingles(text, size)) for doc, label, pivot, text in rows}
            order = sorted(sets, key=lambda k: (k[1], len(sets[k][1]), k[0]))
            n = sum(not pivot for _, pivot in order)
            if not 0 < n < len(order):
                continue
            before = [sets[k][0] for k in order]
            forest = Forest([sets[k][1] for k in order], before, percent)
            forest.cross(0, n, n, len(order))
            pairs = sorted({(a, int(b)) for a, b in zip(before, forest.labels, strict=True) if a != b})
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], ["a", "b"])

    return run


def _rounds(texts: DataFrame, labels: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Labels of blocks of several chunks, after rounds of pivots."""
    done = None
    while True:
        sizes = labels.groupBy("block", "label").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("block").agg(F.max(F.struct("n", "label")).alias("m")).select("block", F.col("m.label").alias("largest"))
        left = labels.join(largest, "block").where("label <> largest")
        if done is not None:
            left = left.join(done, "doc_id", "left_anti")
        first = Window.partitionBy("block").orderBy("doc_id")
        pivots = scratch.stored(left.withColumn("k", F.row_number().over(first)).where(F.col("k") <= CHUNK).select("block", "doc_id", "label"), "join-pivots")
        if pivots.isEmpty():
            return labels
        chunks = labels.join(pivots.select("block").distinct(), "block", "left_semi")
        members = chunks.join(texts.select("doc_id", "text"), "doc_id").select("block", "chunk", "doc_id", "label", F.lit(False).alias("pivot"), "text")
        spread = pivots.join(texts.select("doc_id", "text"), "doc_id").join(chunks.select("block", "chunk").distinct(), "block").select("block", "chunk", "doc_id", "label", F.lit(True).alias("pivot"), "text")
        rows = members.union(spread).repartition("block", "chunk").sortWithinPartitions("block", "chunk")
        joined = scratch.stored(map_arrow(rows, _against_pivots(size, percent), "a long, b long"), "join-links")
        roots = components(joined, scratch)
        done = pivots.select("doc_id") if done is None else scratch.stored(done.union(pivots.select("doc_id")), "done")
        moved = labels.join(roots.withColumnRenamed("node", "label"), "label", "left")
        labels = scratch.stored(moved.select("block", "chunk", "doc_id", F.coalesce("root", "label").alias("label")), "join-labels")


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reached by links) and
    class_id (the smallest id with an equal set), one row for each document."""
    spark = docs.sparkSession
    rows = doc_text(docs, id_col, text_col)
    scratch = Scratch(spark, "jaccard-join")
    sets = scratch.stored(map_arrow(rows, _sets(size, percent), SETS), "sets")
    classes = sets.where("n > 0 and doc_id is not null").groupBy("n", "one", "two", "counted").agg(F.min("doc_id").alias("class_id"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # sets with too many shingles of their own link with nothing
    packed = map_arrow(rows, _counted(size, percent, 4 * partitions), "bucket long, keys binary, sets binary, times binary")
    shared = map_arrow(packed.repartition(partitions, "bucket").sortWithinPartitions("bucket"), _shared, "one long, shared long").groupBy("one").agg(F.sum("shared").alias("shared"))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100)
    left = scratch.stored(classes.join(shared, "one", "left").where(F.col("counted") - F.coalesce("shared", F.lit(0)) <= most).select(F.col("class_id").alias("doc_id"), "one", "two", "n"), "left")

    # few candidates are sent to all texts; many meet them by a shuffle
    near = F.broadcast if left.count() <= BROADCAST_ROWS else lambda df: df
    texts = scratch.stored(rows.join(near(left.select("doc_id", "one", "two")), "doc_id").select("doc_id", "one", "two", "text"), "texts")

    def blocks_of(some: DataFrame, seed: int) -> DataFrame:
        """(one, block): sets whose keys hang together, within the blocks given."""
        packed = map_arrow(some, _keys(size, percent, 4 * partitions, seed), "bucket long, keys binary, places binary, sets binary")
        ties = map_arrow(packed.repartition(partitions, "bucket").sortWithinPartitions("bucket"), _ties, "a long, b long")
        return components(single_ties(ties), scratch).withColumnRenamed("node", "one").withColumnRenamed("root", "block")

    whole = blocks_of(texts.select("doc_id", "text", F.lit(0).cast("long").alias("block")), 0)
    members = scratch.stored(left.join(whole, "one").select("block", "doc_id", "one", "two", "n"), "members")
    # a passage that many texts share can tie blocks that hold no links: other cuts of the hash space part them again
    held = None
    for seed in range(1, 1 << 20):
        counts = members.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
        sized = members.join(counts.select("block", F.ceil(F.greatest(F.col("m") / chunk, F.col("s") / CHUNK_SHINGLES)).alias("chunks")), "block")
        large = sized.where("chunks > 1")
        before, held = held, large.count()
        if not held or (before is not None and 10 * held > 9 * before):
            break
        parted = blocks_of(texts.join(large.select("doc_id", "one", "two", "block"), ["doc_id", "one", "two"]).select("doc_id", "text", "block"), seed)
        again = large.drop("block", "chunks").join(parted, "one").select("block", "doc_id", "one", "two", "n")
        new = scratch.stored(sized.where("chunks = 1").select("block", "doc_id", "one", "two", "n").unionByName(again), "members")
        scratch.drop(members)
        members = new
    dealt = scratch.stored(sized.select("block", F.pmod(F.xxhash64("doc_id"), "chunks").alias("chunk"), "doc_id", "one", "two", "chunks"), "dealt")
    again = texts.join(near(dealt.drop("chunks")), ["doc_id", "one", "two"]).select("block", "chunk", "doc_id", "one", "two", "text").repartition(partitions, "block", "chunk").sortWithinPartitions("block", "chunk")
    labels = scratch.stored(map_arrow(again, _chunks(size, percent), "block long, chunk long, doc_id long, label long"), "labels")
    large = dealt.where("chunks > 1").select("block").distinct()
    if not large.isEmpty():
        of_large = scratch.stored(labels.join(large, "block", "left_semi"), "labels")
        own = texts.join(of_large.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        labels = scratch.stored(labels.join(large, "block", "left_anti").unionByName(_rounds(own, of_large, size, percent, scratch)), "labels")
    scratch.drop(left, texts, members, dealt)
    found = classes.join(labels.select(F.col("doc_id").alias("class_id"), "label"), "class_id", "left").select("n", "one", "two", "class_id", F.coalesce("label", "class_id").alias("component_id"))
    lone = F.col("doc_id").isNull()
    return sets.join(found, ["n", "one", "two"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(~lone, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(~lone, F.coalesce("class_id", "doc_id")).alias("class_id")
    )


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w0
  FROM documents),
words AS (
  SELECT doc_id, list_transform(w0, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM d),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, (SELECT min(y) FROM reach WHERE x = doc_id)) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id)
"""
