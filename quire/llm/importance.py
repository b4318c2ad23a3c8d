"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of the target text (labelled
good and not toxic) and one of the raw text (all documents), give each document
the log of its importance: the sum over its n-grams of log p_target - log p_raw.
That sum grows with the length, so texts are compared by the log importance of an equal stretch
of STRETCH n-grams at their own rate. Documents are sampled without replacement
in proportion to it by Gumbel top-k: the k largest of it plus Gumbel noise, the
noise drawn from a hash of the id, so a task that runs again draws the same.

n-grams are words and marks (a run of letters and digits, or of other
characters), pairs of them, and triples of their shapes (kind, case, and
whether a word repeats the one before), hashed into a fixed number of buckets;
so both models have a fixed size however large the corpus. Raw counts cover all
documents. The target model is fitted on a bounded, documented sample of the
labelled rows, another part of which sets the cut on importance per n-gram that
best parts good from bad; k is the number of documents above it. Cut and draw
follow one quantity, the rate, so only documents near the cut change places.

Defined results: a null or empty text has no n-grams, importance 0 and is not
kept if good and bad rows are labelled; a null id stays null and gets the noise of a
null; repeated rows share id and noise and are each judged; with no labelled
good row, nothing is known and all are kept; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import doc_text, map_arrow, stored
from quire.llm.decontaminate import stretches
from quire.llm.pieces import END, LETTER, NUMBER, SPACE, kinds, mixed, span_hashes

WORD_BITS, SHAPE_BITS = 16, 12
BUCKETS = (1 << WORD_BITS) + (1 << SHAPE_BITS)
SMOOTHING = 1.0
#: n-grams of the stretch by whose importance texts of all lengths are drawn: at 0.05 a gram from the cut the noise (1.3 as a deviation) is far below the 50 between.
STRETCH = 1000
#: Labelled rows used: good ones for the target model, good and bad ones for the cut.
TARGET_ROWS, CUT_ROWS = 20_000, 4_000
#: Log importance per n-gram.
RATE = "log_weight / greatest(n_grams, 1)"
#: Bins of one round in the search for the k-th largest.
BINS = 4096

_classes: np.ndarray | None = None
_lower: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: 0 space, 1 lower-case or caseless letter or digit, 2 capital, 3 other; and its lower case."""
    global _classes, _lower
    if _classes is None:
        kind = kinds()
        classes = np.select([kind == SPACE, (kind == LETTER) | (kind == NUMBER)], [0, 1], 3).astype(np.uint8)
        classes[ord("_")] = 1
        lower = np.arange(0x110000, dtype=np.uint32)
        for p in np.flatnonzero(kind == LETTER).tolist():
            c = chr(p)
            if (low := c.lower()) != c:
                classes[p] = 2
                if len(low) == 1:
                    lower[p] = ord(low)
        _classes, _lower = classes, lower
    return _classes, _lower


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text of each) of all n-grams of the texts."""
    classes, lower = _tables()
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    shape = classes[points]
    shape[ends] = END
    kind = np.where(shape == 2, np.uint8(1), shape)
    start = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    stop = np.append(start[1:], len(points))
    real = (kind[start] == 1) | (kind[start] == 3)
    start, stop = start[real], stop[real]
    owner = np.searchsorted(ends, start)
    if not len(start):
        return np.empty(0, np.int64), owner
    h = span_hashes(lower[points], start, stop)
    capitals = np.concatenate([[0], np.cumsum(shape == 2)])
    n_capitals = capitals[stop] - capitals[start]
    first = shape[start] == 2
    form = np.where(kind[start] == 3, 0, np.where(n_capitals == 0, 1, np.where((n_capitals == 1) & first, 2, np.where(n_capitals == stop - start, 3, 4)))).astype(np.uint64)
    same = owner[1:] == owner[:-1]
    again = np.append(False, same & (h[1:] == h[:-1]))
    form = form * np.uint64(8) + again.astype(np.uint64) * np.uint64(4) + np.minimum(stop - start, 4).astype(np.uint64) - np.uint64(1)
    words = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    pair = mixed(h[1:] ^ (h[:-1] * np.uint64(0x9E3779B97F4A7C15)))[same]
    pairs = (pair >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    three = np.flatnonzero(same[1:] & same[:-1]) if len(same) > 1 else np.empty(0, np.int64)
    triple = mixed(form[three] * np.uint64(1 << 20) + form[three + 1] * np.uint64(1 << 10) + form[three + 2])
    triples = (triple >> np.uint64(64 - SHAPE_BITS)).astype(np.int64) + (1 << WORD_BITS)
    return np.concatenate([words, pairs, triples]), np.concatenate([owner, owner[1:][same], owner[three]])


def _counts(batches):
    """Bucket counts of one task: raw of all rows, target of rows marked so."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts, marked = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
        for a, b in stretches(texts):
            bucket, owner = features(texts[a:b])
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[marked[a:b][owner]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def _scores(ratio: np.ndarray):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            weight, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for a, b in stretches(texts):
                bucket, owner = features(texts[a:b])
                weight[a:b] = np.bincount(owner, ratio[bucket], b - a)
                n[a:b] = np.bincount(owner, minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight)], ["doc_id", "n_grams", "log_weight"])

    return run


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket, smoothed towards the raw model."""
    p_raw = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw))
    share = SMOOTHING * len(raw)
    p_target = (target + share * p_raw) / (target.sum() + share)
    # buckets that the target never shows still keep the share of smoothing
    return np.log(p_target) - np.log(p_raw)


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the largest share of good above less share of bad above; midway between the two scores it lies between."""
    every = np.unique(np.concatenate([good, bad]))
    middle = np.concatenate([[every[0] - 1.0], (every[1:] + every[:-1]) / 2])
    above = lambda x: 1 - np.searchsorted(np.sort(x), middle) / max(len(x), 1)
    gain = above(good) - above(bad)
    return float(middle[np.flatnonzero(gain == gain.max())[0]])


def labelled(labels: DataFrame, target_rows: int = TARGET_ROWS, cut_rows: int = CUT_ROWS) -> DataFrame:
    """(doc_id, role): bounded samples by the order of a hash of the id. good:
    for the target model; cut_good (kept out of it), cut_bad: for the cut. A
    row labelled toxic is never good. Of quality 1 it is not bad for the cut
    either: n-gram rates do not part it from clean text, and the cut would rise
    into that. Without a column toxic, or where it is null, nothing is said of it."""
    toxic = F.coalesce(F.col("toxic") >= 1, F.lit(False)) if "toxic" in labels.columns else F.lit(False)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", toxic.alias("toxic"), F.xxhash64(F.lit(3), "doc_id").alias("h")).where("doc_id is not null and quality is not null").distinct()
    held = F.pmod("h", F.lit(5)) == 0
    pick = lambda df, n, role: df.orderBy("h", "doc_id").limit(n).select("doc_id", F.lit(role).alias("role"))
    good, bad = rows.where("quality >= 1 and not toxic"), rows.where("quality < 1")
    return pick(good.where(~held), target_rows, "good").union(pick(good.where(held), cut_rows, "cut_good")).union(pick(bad, cut_rows, "cut_bad"))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sample) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_grams, log_weight, key) of every document, stored, and the labelled sample."""
    rows = doc_text(docs, id_col, text_col)
    sample = stored(labelled(labels, **sample), "quality-sample")
    good = sample.where("role = 'good'").select("doc_id").distinct()
    marked = rows.join(F.broadcast(good.withColumn("marked", F.lit(True))), "doc_id", "left").select("text", F.coalesce("marked", F.lit(False)).alias("marked"))
    counts = map_arrow(marked, _counts, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, n, t in counts:  # one row for each of the fixed buckets at most
        raw[bucket], target[bucket] = n, t
    ratio = log_ratio(raw, target)
    uniform = (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scores = map_arrow(rows, _scores(ratio), "doc_id long, n_grams long, log_weight double")
    return stored(scores.withColumn("key", STRETCH * F.expr(RATE) - F.log(-F.log(uniform))), "quality-scores"), sample


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows with the largest keys; of equal keys at the edge those with
    the smallest ids. The edge is found by rounds of counting in bins."""
    n, low, high = rows.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    if k >= n:
        return rows
    if k <= 0:
        return rows.limit(0)
    left, above = k, None  # rows over `above` are in; `left` more are to come from [low, above]
    above = high
    taken = rows.where(F.lit(False))
    inside = rows
    while high > low:
        width = (high - low) / BINS
        place = F.least(F.floor((F.col(key) - low) / width), F.lit(BINS - 1))
        counts = dict(inside.groupBy(place.alias("b")).agg(F.count(F.lit(1))).collect())
        b, over = BINS - 1, 0
        while over + counts.get(b, 0) < left:
            over += counts.get(b, 0)
            b -= 1
        edge = inside.withColumn("_b", place)
        taken = taken.unionByName(edge.where(F.col("_b") > b).drop("_b"))
        left -= over
        inside = edge.where(F.col("_b") == b).drop("_b")
        size, low, high = inside.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
        if size <= max(left, BINS):
            break
    # what is left lies in one bin: a few rows, or rows with one and the same key
    last = inside.withColumn("_n", F.row_number().over(Window.orderBy(F.desc(key), "doc_id"))).where(F.col("_n") <= left).drop("_n")
    return taken.unionByName(last)


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, **options) -> DataFrame:
    """The sampled documents: doc_id, n_grams, log_weight, key. Without `k`, as
    many as lie above the cut that the labelled sample gives."""
    scores, sample = scored(docs, labels, **options)
    if k is None:
        points = scores.join(F.broadcast(sample.where("role <> 'good'")), "doc_id").select("role", F.expr(RATE).alias("x")).collect()
        good = np.array([x for role, x in points if role == "cut_good"])
        bad = np.array([x for role, x in points if role == "cut_bad"])
        if not len(good) or not len(bad):
            return scores
        scores = scores.where("n_grams > 0")  # nothing speaks for a text without n-grams
        k = scores.where(F.expr(RATE) > best_cut(good, bad)).count()
    return top_k(scores, "key", k)
