"""Occurrences within the edit budget against a plain search of every stretch."""

import random

import numpy as np

from quire.llm import decontaminate as dc


def distance_to_best(item, text):
    """The least edits of `item` against any stretch of `text`."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        grown = [i]
        for j, d in enumerate(text, 1):
            grown.append(min(row[j] + 1, grown[-1] + 1, row[j - 1] + (c != d)))
        row = grown
    return min(row)


def cases(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "é", "ß", "ing"]) for _ in range(rng.randint(1, 3)))
    items = [(k, " ".join(word() for _ in range(n)).capitalize() + ".") for k, n in enumerate([4, 12, 25, 40, 90])]
    docs = []
    for d in range(70):
        words = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.8:
            passage = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 3, 6, 12, 20])):
                k = rng.randrange(len(passage))
                if (change := rng.random()) < 0.3:
                    passage[k] = rng.choice("xyz")
                elif change < 0.6:
                    passage.insert(k, rng.choice("xyz ,"))
                elif len(passage) > 5:
                    del passage[k]
            if rng.random() < 0.4:  # a quote of part of it
                passage = passage[rng.randrange(len(passage) // 2 + 1) :]
            words.insert(rng.randint(0, len(words)), "".join(passage))
        docs.append((d, rng.choice([" ", "  ", ",\n"]).join(words)))
    return items, docs


def test_plain_search(spark):
    items, docs = cases(3)
    fold = lambda t: "".join(map(chr, dc.of_text(t)[0])).strip()
    want = {}
    for i, item in items:
        item = fold(item)
        windows = [item[a : a + dc.WINDOW] for a in dc.window_starts(len(item), dc.WINDOW, dc.STEP)]
        for d, text in docs:
            found = []
            for w in windows:
                if (best := distance_to_best(w, fold(text))) <= min(int(dc.EDIT_RATE * len(w)), (len(w) - dc.Q) // dc.Q):
                    found.append(best)
            if found:
                want[d, i] = min(found), len(found), len(windows)
    assert len({best for best, *_ in want.values()}) > 2 and len({n for _, n, of in want.values() if of > 2}) > 2
    frames = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"block_chars": 120}):
        got = {(r.doc_id, r.item_id): r for r in dc.matches(*frames, **options).collect()}
        assert {k: (r.distance, r.windows, r.of_windows) for k, r in got.items()} == want
    for (d, i), r in got.items():
        found = "".join(map(chr, dc.of_text("x" + docs[d][1][r.start : r.end])[0][1:]))  # with the space that a window may start with
        item = fold(dict(items)[i])
        assert min(distance_to_best(item[a : a + dc.WINDOW], found) for a in dc.window_starts(len(item), dc.WINDOW, dc.STEP)) == r.distance
    left = dc.without_matches(*frames, block_chars=120)
    assert left.columns == ["doc_id", "text", "item_id"] and sorted(r.doc_id for r in left.collect()) == sorted({d for d, _ in docs} - {d for d, _ in want})


def test_long_text_and_edges(spark):
    item = "A passage of the benchmark, long enough to be found whole."
    rows = [(1, None), (2, ""), (None, item), (4, "word " * 400_000 + item.upper().replace(" ", "\n\n")), (5, item), (5, item), (6, item[: len(item) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "short"), (None, item), (4, None), (5, "")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in dc.matches(docs, bench).collect()), key=repr)
    assert got == sorted([(d, i) for d in (None, 4, 5, 5) for i in (1, None)], key=repr)
    assert dc.matches(docs.limit(0), bench).collect() == [] and dc.matches(docs, bench.limit(0)).collect() == []
    assert dc.without_matches(docs, bench).count() == 3 and dc.without_matches(docs, bench.limit(0)).count() == 7


def test_no_q_gram_is_lost():
    rng = np.random.default_rng(1)
    chars = rng.integers(97, 110, 500).astype(np.uint32)
    index = dc.Index([(0, "".join(map(chr, chars[100:160])))])
    ((at, item, place),) = index.hits(chars)
    assert set(zip(at.tolist(), place.tolist())) >= {(100 + k, k) for k in range(60 - dc.Q + 1)} and set(item.tolist()) == {0}


def test_quotes_of_a_long_item():
    rng = np.random.default_rng(5)
    item = "".join(map(chr, rng.integers(97, 123, 473)))
    index = dc.Index([(7, item)])
    other = "".join(map(chr, rng.integers(97, 123, 3000)))
    quotes = [other[:900] + item[a : a + n] + other[900:] for n in (378, 236, dc.WINDOW + dc.STEP - 1) for a in (0, 31, 473 - n)]
    assert {d for d, *_ in dc.searched(index, [*quotes, other, item[:60] + other])} == set(range(len(quotes)))


def test_band_against_the_whole_table():
    """Cells outside the band change nothing while the path stays inside."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        text = rng.integers(97, 100, rng.integers(10, 40)).astype(np.uint32)
        chars = rng.integers(97, 100, rng.integers(0, 60)).astype(np.uint32)
        wide = dc.aligned(text, chars, -len(text) - 1, len(text) + len(chars) + 2, free=True)
        assert wide.min() == distance_to_best(text.tolist(), chars.tolist())
        row = list(range(len(chars) + 1))
        for i, c in enumerate(text.tolist(), 1):
            grown = [i]
            for j, d in enumerate(chars.tolist(), 1):
                grown.append(min(row[j] + 1, grown[-1] + 1, row[j - 1] + (c != d)))
            row = grown
        pinned = dc.aligned(text, chars, -len(text), len(text) + len(chars) + 1)
        assert pinned[: len(chars) + 1].tolist() == row


def test_short_items():
    index = dc.Index([(1, "Yes!"), (2, "no"), (3, "a1 b2"), (None, "no"), (5, "...")])
    texts = ["oh YES, well", "yesterday not a1  b2", "no", "a1", "", "no way; no"]
    got = {(d, index.ids[i]): span for d, i, span, _ in dc.searched(index, texts)}
    assert got == {(0, 1): (0, 3, 6), (1, 3): (0, 14, 20), (2, 2): (0, 0, 2), (2, None): (0, 0, 2), (5, 2): (0, 0, 2), (5, None): (0, 0, 2)}


def test_one_character_in_bounded_memory():
    import tracemalloc

    index = dc.Index([(1, "0" * 300), (2, "0" * 100 + "1")])
    text = "word " + "0" * 60_000 + " word"
    tracemalloc.start()
    got = dc.searched(index, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(i, span) for _, i, span, _ in got] == [(0, (0, 5, 125)), (1, (1, 5, 105))] and peak < 600 << 20
