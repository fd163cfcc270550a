"""The smoothing spline held against its definition: knots, the residual bound, and the least sum of jumps."""

import numpy as np
import pytest

from pathloom.operators import spline


def lines(seed, n):
    rng = np.random.default_rng(seed)
    return np.cumsum(rng.normal(0, 1, (n, 3)), axis=0)


def parameters(points):
    length = np.r_[0.0, np.cumsum(np.sqrt((np.diff(points, axis=0) ** 2).sum(axis=1)))]
    return length / length[-1]


def dense(knots, u):
    first, values = spline.basis(knots, u)
    out = np.zeros((len(u), len(knots) - 4))
    for j in range(4):
        out[np.arange(len(u)), first + j] = values[:, j]
    return out


def test_basis_and_jumps():
    knots = np.r_[[0.0] * 4, 0.2, 0.45, 0.7, [1.0] * 4]
    u = np.linspace(0, 1, 41)
    b = dense(knots, u)
    assert b.min() >= 0 and np.allclose(b.sum(axis=1), 1)
    greville = np.array([knots[i + 1 : i + 4].mean() for i in range(7)])
    assert np.allclose(b @ greville, u)  # a straight line is reproduced
    jumps = np.zeros((3, 7))
    for n, row in enumerate(spline.jumps(knots)):
        jumps[n, n : n + 5] = row
    cubic = np.linalg.lstsq(b, u**3 - 2 * u, rcond=None)[0]
    assert np.allclose(jumps @ cubic, 0, atol=1e-9)  # one cubic has no jumps
    eps, scale, c = 1e-3, 4.0, np.random.default_rng(1).normal(size=7)

    def third(x):
        return np.array([-1, 3, -3, 1]) @ dense(knots, x + eps * np.array([-1.5, -0.5, 0.5, 1.5])) @ c / eps**3

    for n, knot in enumerate((0.2, 0.45, 0.7)):
        step = third(knot + 0.01) - third(knot - 0.01)
        assert abs(step) == pytest.approx(abs((jumps @ c)[n]) * 6 * scale**3, rel=1e-3)


@pytest.mark.parametrize(("seed", "n"), [(2, 9), (6, 14), (3, 20), (4, 60), (5, 150)])
def test_residuals_meet_the_bound_with_the_least_jumps(seed, n):
    points = lines(seed, n)
    u = parameters(points)
    knots, c = spline.smoothed(u, points, 0.2)
    b = dense(knots, u)
    assert len(knots) > 8
    total = ((b @ c - points) ** 2).sum()
    assert total == pytest.approx(0.2, rel=0.0011)
    rows = spline.jumps(knots)
    d = np.zeros((len(rows), b.shape[1]))
    for k, row in enumerate(rows):
        d[k, k : k + 5] = row
    # the minimum of jumps under the bound: the gradients of both are opposite, with one factor for all
    data, bend = b.T @ (b @ c - points), d.T @ (d @ c)
    factor = -(data * bend).sum() / (bend * bend).sum()
    assert factor > 0 and np.allclose(data, -factor * bend, atol=1e-6 * np.abs(data).max() + 1e-8)


def test_banded_solution_equals_a_dense_one():
    points = lines(7, 40)
    u = parameters(points)
    knots = np.r_[[0.0] * 4, u[[5, 9, 14, 20, 21, 30]], [1.0] * 4]
    fit, b = spline.Fit(knots, u, points), dense(knots, u)
    assert np.allclose(fit.coefficients(), np.linalg.lstsq(b, points, rcond=None)[0], atol=1e-7)
    d = np.zeros((6, b.shape[1]))
    for k, row in enumerate(spline.jumps(knots)):
        d[k, k : k + 5] = row
    assert np.allclose(fit.coefficients(0.7), np.linalg.lstsq(np.vstack([b, d / 0.7]), np.vstack([points, np.zeros((6, 3))]), rcond=None)[0], atol=1e-7)


def test_a_cubic_that_meets_the_bound_is_taken():
    t = np.linspace(0, 1, 12)
    points = np.stack([t, t**2, 0 * t], axis=1)
    knots, c = spline.smoothed(parameters(points), points, 0.2)
    assert len(knots) == 8
    out = spline.curve(points)
    assert (out[0] == points[0]).all() and (out[-1] == points[-1]).all() and np.abs(out - points).max() < 0.2


def test_what_stays_as_it_is():
    few, same = lines(1, 3), np.repeat(lines(1, 1), 9, axis=0)
    assert (spline.curve(few) == few).all() and (spline.curve(same) == same).all()
    bad = lines(2, 9)
    bad[4, 1] = np.nan
    assert np.isnan(spline.curve(bad)[4, 1])
    four = np.array([[0, 0, 0], [5, 0, 0], [5, 5, 0], [0, 5, 0.0]])
    assert np.allclose(spline.smoothed(parameters(four), four, 0.2)[1].shape, (4, 3))  # a cubic goes through four points
    twice = np.repeat(lines(3, 6), 2, axis=0)
    assert spline.curve(twice).shape == twice.shape


def test_polylines_side_by_side_are_the_same(spark, monkeypatch):
    """Polylines whose systems are solved together, cut by Arrow batches, come out as each alone, to the last bit; few steps of Python for all."""
    from pathloom.operators import folds

    held = {k: lines(k, n) for k, n in enumerate((4, 5, 9, 33, 33, 120, 2, 64))}
    alone = {k: spline.curve(p) for k, p in held.items()}
    counts, own = [], spline.factored
    monkeypatch.setattr(spline, "factored", lambda bands: (counts.append(bands.shape[2]), own(bands))[1])
    for k, p in zip(held, spline.curves(list(held.values()))):
        assert np.array_equal(p, alone[k])
    assert max(counts) > 1 and sum(counts) > 1.5 * len(counts)
    rows = [(k, n, *map(float, v)) for k, p in held.items() for n, v in enumerate(p)] + [(None, 0, 1.0, 2.0, 3.0), (None, 1, None, 2.0, 3.0)]
    frame = spark.createDataFrame(rows, "path_id long, seq long, x double, y double, z double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (7, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = sorted(((r.path_id, r.seq, r.x, r.y, r.z) for r in folds.smooth(frame).collect()), key=lambda r: (r[0] is None, r[0], r[1]))
            assert got[-2:] == rows[-2:]
            for k in held:
                assert np.array_equal([r[2:] for r in got if r[0] == k], alone[k])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
