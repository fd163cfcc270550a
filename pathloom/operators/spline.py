"""Smoothing curves by a bound on the residuals, after P. Dierckx, Curve and Surface Fitting with Splines (1993).

The smoothest cubic spline through a polyline's neighbourhood whose squared distances from its vertices sum to `bound`: knots
are put where the residuals are largest until a least-squares spline meets the bound, then the weight of the jumps of
the third derivative at the knots is found, by rational interpolation, for which the sum equals the bound (to a thousandth)."""

from __future__ import annotations

from collections.abc import Generator

import numpy as np

K = 3
TOLERANCE, ROUNDS = 0.001, 20


def basis(knots: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First coefficient and the K + 1 basis values at each u."""
    first = np.clip(np.searchsorted(knots, u, "right") - 1, K, len(knots) - K - 2)
    values = np.zeros((len(u), K + 1))
    values[:, 0] = 1.0
    for degree in range(1, K + 1):
        saved = np.zeros(len(u))
        for r in range(degree):
            right, left = knots[first + r + 1], knots[first + 1 - degree + r]
            term = values[:, r] / (right - left)
            values[:, r] = saved + (right - u) * term
            saved = (u - left) * term
        values[:, degree] = saved
    return first - K, values


def jumps(knots: np.ndarray) -> np.ndarray:
    """Jumps of the third derivative at each inner knot, one row for a knot, over the K + 2 coefficients from its number on."""
    inner = np.arange(K + 1, len(knots) - K - 1)
    scale = (len(inner) + 1) / (knots[-1] - knots[0])
    rows = np.zeros((len(inner), K + 2))
    for j in range(K + 2):
        own = (inner - K - 1 + j)[:, None] + np.arange(K + 2)  # the knots of this coefficient, the inner one at K + 1 - j
        gaps, product = knots[inner][:, None] - knots[own], 1.0
        for k in range(K + 2):
            product = product if k == K + 1 - j else product * gaps[:, k]
        rows[:, j] = (knots[own[:, -1]] - knots[own[:, 0]]) / (product * scale**K)
    return rows


def banded(starts: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The bands of the normal matrix of rows that begin at starts: bands[d, i] stands at (i + d, i)."""
    bands, width = np.zeros((rows.shape[1], n)), rows.shape[1]
    for d in range(width):
        for j in range(width - d):
            np.add.at(bands[d], starts + j, rows[:, j] * rows[:, j + d])
    return bands


def factored(bands: np.ndarray) -> np.ndarray:
    """Cholesky factors of banded matrices (band, column, matrix), in the same form."""
    out, (width, n) = bands.copy(), bands.shape[:2]
    for i in range(n):
        out[0, i] = np.sqrt(np.maximum(out[0, i], 1e-300))
        reach = min(width - 1, n - 1 - i)
        out[1 : reach + 1, i] /= out[0, i]
        for d in range(1, reach + 1):
            out[: reach + 1 - d, i + d] -= out[d, i] * out[d : reach + 1, i]
    return out


def solved(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions (column, coordinate, matrix) to right hand sides of that form."""
    x, (width, n) = right.copy(), factor.shape[:2]
    for i in range(n):
        x[i] /= factor[0, i]
        for d in range(1, min(width, n - i)):
            x[i + d] -= factor[d, i] * x[i]
    for i in range(n - 1, -1, -1):
        for d in range(1, min(width, n - i)):
            x[i] -= factor[d, i] * x[i + d]
        x[i] /= factor[0, i]
    return x


def answer(asked: list[tuple[Fit, float]]) -> list[np.ndarray]:
    """The coefficients of each fit for its weight. Systems of about one size are solved together: ends are aligned, and a smaller one begins with
    columns of the unit matrix, which change nothing in it."""
    found: list = [None] * len(asked)
    sizes = np.array([fit.n for fit, _ in asked])
    for power in set((bits := np.ceil(np.log2(sizes)).astype(int)).tolist()):
        own = np.flatnonzero(bits == power)
        n, (fit, _) = sizes[own].max(), asked[own[0]]
        bands, right = np.zeros((K + 2, n, len(own))), np.zeros((n, fit.right.shape[1], len(own)))
        bands[0] = 1.0
        for at, k in enumerate(own):
            fit, p = asked[k]
            bands[:, n - fit.n :, at], right[n - fit.n :, :, at] = fit.system(p), fit.right
        with np.errstate(over="ignore", invalid="ignore"):
            factor = factored(bands)
            x = solved(factor, right)
        for at, k in enumerate(own):
            fit = asked[k][0]
            fit.diagonal, found[k] = factor[0, n - fit.n :, at].copy(), x[n - fit.n :, :, at].copy()
    return found


def together(runs: list[Generator]) -> list:
    """What each of the runs returns; they ask for (fit, weight), and all that ask at one time are answered at once."""
    out: list = [None] * len(runs)
    told: dict[int, np.ndarray | None] = dict.fromkeys(range(len(runs)))
    while told:
        asked = {}
        for k, c in told.items():
            try:
                asked[k] = runs[k].send(c)
            except StopIteration as end:
                out[k] = end.value
        told = dict(zip(asked, answer(list(asked.values())))) if asked else {}
    return out


class Fit:
    """Splines over one vector of knots, to points at u."""

    def __init__(self, knots: np.ndarray, u: np.ndarray, points: np.ndarray):
        self.knots, self.points, self.n = knots, points, len(knots) - K - 1
        self.first, self.values = basis(knots, u)
        bands = banded(self.first, self.values, self.n)
        self.bands = np.vstack([bands, np.zeros((1, self.n))])
        self.right = np.zeros((self.n, points.shape[1]))
        for j in range(K + 1):
            np.add.at(self.right, self.first + j, self.values[:, j, None] * points)
        self.bends = None

    def system(self, p: float) -> np.ndarray:
        """The bands for jumps that weigh 1 / p squared; p infinite: least squares alone."""
        if p == np.inf:
            return self.bands
        if self.bends is None:
            self.bends = banded(np.arange(len(self.knots) - 2 * (K + 1)), jumps(self.knots), self.n) if len(self.knots) > 2 * (K + 1) else np.zeros_like(self.bands)
        return self.bands + self.bends / p**2

    def coefficients(self, p: float = np.inf) -> np.ndarray:
        """Of the spline that weighs the jumps by 1 / p squared."""
        return answer([(self, p)])[0]

    def residuals(self, c: np.ndarray) -> np.ndarray:
        """The squared distance of each point."""
        fitted = sum(self.values[:, j, None] * c[self.first + j] for j in range(K + 1))
        return ((fitted - self.points) ** 2).sum(axis=1)


def per_interval(knots: np.ndarray, u: np.ndarray, squares: np.ndarray) -> list[float]:
    """Residuals of each interval between knots; a point on an inner knot counts half to both sides."""
    inner = knots[K + 1 : -K - 1]
    at = np.searchsorted(inner, u, "right")
    sums = np.bincount(at, squares, len(inner) + 1)
    on = np.flatnonzero(np.isin(u, inner))
    np.subtract.at(sums, at[on], squares[on] / 2)
    np.add.at(sums, at[on] - 1, squares[on] / 2)
    return sums.tolist()


def smoothed(u: np.ndarray, points: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots and coefficients of the smoothest spline whose squared residuals sum to bound (or less, if a cubic alone does)."""
    return together([_smoothed(u, points, bound)])[0]


def _smoothed(u: np.ndarray, points: np.ndarray, bound: float) -> Generator:
    """smoothed(), as a run of together()."""
    m, slack = len(u), TOLERANCE * bound
    inner, inside = [], [m - 2]  # inner knots as numbers of points; points strictly inside each interval
    added, before, first = 0, 0.0, None
    while True:
        knots = np.r_[np.repeat(u[0], K + 1), u[inner], np.repeat(u[-1], K + 1)]
        fit = Fit(knots, u, points)
        c = yield fit, np.inf
        squares = fit.residuals(c)
        total = float(squares.sum())
        first = total if first is None else first
        over = total - bound
        if abs(over) < slack or (over < 0 and not inner):
            return knots, c
        if over < 0:
            break
        if len(inner) >= m - K - 1:  # no spline comes nearer
            return knots, c
        if not added:
            added = 1
        else:
            wanted = int(added * over / (before - total)) if before - total > slack else 2 * added
            added = min(2 * added, max(wanted, added // 2, 1))
        before, share = total, per_interval(knots, u, squares)
        for _ in range(added):
            open_ = [k for k in range(len(share)) if inside[k]]
            if not open_:
                break
            worst = max(open_, key=lambda k: share[k])
            low, high = inside[worst] // 2, inside[worst] - inside[worst] // 2 - 1  # the middle point becomes a knot
            begin = inner[worst - 1] if worst else 0
            whole, many = share[worst], inside[worst]
            inner.insert(worst, begin + low + 1)
            inside[worst : worst + 1] = [low, high]
            share[worst : worst + 1] = [whole * low / many, whole * high / many]
            if len(inner) >= m - K - 1:
                inner = list(range(2, m - 2))  # as many knots as an interpolating spline has
                break
    return knots, (yield from _weighed(fit, first - bound, over, bound))


def _weighed(fit: Fit, above: float, below: float, bound: float) -> Generator:
    """Coefficients for the weight at which the residuals sum to bound; above and below: what is over the bound without knots, and with them."""
    slack = TOLERANCE * bound
    p1, f1, p3, f3 = 0.0, above, np.inf, below
    p, low_found, high_found = fit.n / float(fit.diagonal.sum()), False, False
    for _ in range(ROUNDS):
        c = yield fit, p
        f2 = float(fit.residuals(c).sum()) - bound
        if abs(f2) < slack:
            break
        p2 = p
        if not high_found and f2 - f3 <= slack:  # p is too large
            p3, f3, p = p2, f2, p * 0.04
            p = 0.9 * p1 + 0.1 * p2 if p <= p1 else p
            continue
        high_found |= f2 < 0
        if not low_found and f1 - f2 <= slack:  # p is too small
            p1, f1, p = p2, f2, p / 0.04
            p = 0.1 * p2 + 0.9 * p3 if np.isfinite(p3) and p >= p3 else p
            continue
        low_found |= f2 > 0
        if not f3 < f2 < f1:
            break
        if np.isfinite(p3):
            h1, h2, h3 = f1 * (f2 - f3), f2 * (f3 - f1), f3 * (f1 - f2)
            p = -(p1 * p2 * h3 + p2 * p3 * h1 + p3 * p1 * h2) / (p1 * h1 + p2 * h2 + p3 * h3)
        else:
            p = (p1 * (f1 - f3) * f2 - p2 * (f2 - f3) * f1) / ((f1 - f2) * f3)
        if f2 >= 0:
            p1, f1 = p2, f2
        else:
            p3, f3 = p2, f2
    return c


def curve(points: np.ndarray, bound: float = 0.2, near: float = 1e-6) -> np.ndarray:
    """As many points on the smoothed polyline, equally spaced over its chord length, both ends kept.

    Points that lie within `near` of the one before do not count; fewer than four that count, or a value that is not finite: the points as they are."""
    return curves([points], bound, near)[0]


def curves(lines: list[np.ndarray], bound: float = 0.2, near: float = 1e-6) -> list[np.ndarray]:
    """curve() of each polyline, to the last bit; their systems are solved side by side."""
    return together([_curve(points, bound, near) for points in lines])


def _curve(points: np.ndarray, bound: float, near: float) -> Generator:
    if len(points) < 4 or not np.isfinite(points).all():
        return points
    kept = points[np.r_[True, np.sqrt((np.diff(points, axis=0) ** 2).sum(axis=1)) > near]]
    if len(kept) < 4:
        return points
    length = np.r_[0.0, np.cumsum(np.sqrt((np.diff(kept, axis=0) ** 2).sum(axis=1)))]
    knots, c = yield from _smoothed(length / length[-1], kept, bound)
    first, values = basis(knots, np.linspace(0.0, 1.0, len(points)))
    out = sum(values[:, j, None] * c[first + j] for j in range(K + 1))
    out[0], out[-1] = points[0], points[-1]
    return out
