"""Whitening: rank-one updates and combined spectra against a plain eigendecomposition, and the query against numpy."""

import math

import numpy as np
import pytest

from quire.llm import queries
from quire.llm import spectral_whitening as sw

SMALL = "/root/testdata/sf0.001"


def same_matrix(w, u, m):
    scale = max(1.0, np.abs(m).max())
    assert np.abs(u.T @ u - np.eye(len(w))).max() < 1e-12
    assert np.abs((u * w) @ u.T - m).max() < 1e-12 * scale
    assert (np.diff(w) >= 0).all()


@pytest.mark.parametrize("d", [1, 2, 5, 33])
def test_rank_one_updates(d):
    rng = np.random.default_rng(d)
    w, u, m = np.zeros(d), np.eye(d), np.zeros((d, d))
    for i in range(40):
        v = rng.normal(size=d) * 10 ** rng.uniform(-6, 3)
        if i % 5 == 0:
            v[rng.integers(0, d)] = 0  # and vectors that meet few axes
        if i % 7 == 0:
            v = u[:, rng.integers(0, d)] * 2.5
        if i % 9 == 0:
            v = np.zeros(d)
        w, u = sw.rank_one(w, u, v)
        m += np.outer(v, v)
        same_matrix(w, u, m)


def test_equal_and_close_values():
    w = np.array([1.0, 1.0, 1.0 + 1e-15, 2.0, 2.0 + 1e-9, 5.0, 5.0])
    u = np.linalg.qr(np.random.default_rng(1).normal(size=(7, 7)))[0]
    v = u @ np.array([1, 2, 3, 1e-17, 1, 0, 4.0])
    same_matrix(*sw.rank_one(w, u, v), (u * w) @ u.T + np.outer(v, v))


@pytest.mark.parametrize("rows,d", [(500, 6), (3, 6), (1, 4), (40, 40)])
def test_spectra_of_parts(rows, d):
    rng = np.random.default_rng(rows)
    x = rng.integers(-300, 300, (rows, d)) + 1000
    whole = None
    for part in np.array_split(x, 7):
        one = sw.Spectrum(d)
        for block in np.array_split(part, 2):
            one.add(block)
        if whole is None:
            whole = one
        else:
            whole.merge(one)
    assert whole.n == rows and (whole.sums == x.sum(0)).all()
    same_matrix(whole.w, whole.u, (x - x.mean(0)).T @ (x - x.mean(0)))


def plain(rows, keep=4):
    """(n, {(vec_id, place): deviation}, eigenvalues, shares, whitened up to sign) by numpy."""
    x = [(i, tuple(math.floor(256 * float(c)) + 0 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({v for _, v in x}), dtype=np.int64)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:keep], u[:, ::-1][:, :keep]
    return n, x, sums, e, e / np.trace(cov), u


def check(got, rows, keep=4):
    n, x, sums, e, share, u = plain(rows, keep)
    keep = len(e)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert len(got) == keep * len(x) and {i for i, _ in x} == set(by)
    sign = {}
    for i, v in x:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(v, sums, strict=True))
        proj = (np.array(v) - sums / n) @ u / np.sqrt(e)
        for k in range(keep):
            some = [r for r in by[i] if r.component == k + 1]
            assert some and all(r.n == n for r in some)
            assert deviation in {r.deviation for r in some}
            near = [r for r in some if abs(abs(r.whitened) - abs(proj[k])) < 1e-8 * max(1, abs(proj[k]))]
            assert near and all(abs(r.explained - share[k]) < 1e-12 and r.identity_error < 1e-9 for r in some)
            if len(some) == 1 and abs(proj[k]) > 1e-3:
                assert sign.setdefault(k, np.sign(some[0].whitened * proj[k])) == np.sign(some[0].whitened * proj[k])


def test_query_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check(queries.op13_spectral_whitening(spark, SMALL).collect(), rows)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(sw, "FAN_IN", 2)
    monkeypatch.setattr(sw, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(90)]
    hot = [(1000 + i, good[0][1]) for i in range(60)]  # one vector fills many rows
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0]), (2003, [math.nan] * 5), (2004, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    odd = [(2005, [1.0, 2.0]), (2006, [1.0] * 9)]
    schema = "vec_id long, embedding array<double>, component string"
    make = lambda rows: spark.createDataFrame([(i, v, "x") for i, v in rows], schema).repartition(7)
    check(sw.whitened(make(good + hot + bad + odd)).collect(), good + hot)
    check(sw.whitened(make([*good, (3, good[7][1])])).collect(), [*good, (3, good[7][1])])
    check(sw.whitened(make([(i, v[:2]) for i, v in good])).collect(), [(i, v[:2]) for i, v in good])
    null_id = sw.whitened(make([*good, (None, good[1][1])])).where("vec_id is null").collect()
    assert [r.component for r in sorted(null_id, key=lambda r: r.component)] == [1, 2, 3, 4]
    assert sw.whitened(make(bad)).count() == 0 and sw.whitened(make([])).count() == 0


def test_no_spread(spark):
    schema = "vec_id long, embedding array<float>"
    one = sw.whitened(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).collect()
    assert len(one) == 4 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in one)
    line = sw.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(10)], schema)).collect()
    assert len(line) == 30
    for r in line:
        assert (r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9
    assert abs(next(r.explained for r in line if r.component == 1) - 1) < 1e-12


def test_long_numbers(spark):
    rows = [(i, [i * 1e12, 1.0]) for i in range(40)]
    got = {r.vec_id: r.deviation for r in sw.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == dict.fromkeys(range(40))
    rows = [(i, [i * 1e6, 1.0]) for i in range(10)]
    got = {r.vec_id: r.deviation for r in sw.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (10 * 256 * i * 10**6 - 45 * 256 * 10**6) ** 2 if (10 * i - 45) ** 2 * (256 * 10**6) ** 2 < 1 << 63 else None for i in range(10)}
