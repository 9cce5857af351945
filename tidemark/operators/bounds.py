"""Lower bounds of a curve fit's residual sum over boxes of slope and midpoint, and searches that rest on them.

Residuals are vectors weighted by the number of observations of a day. Over a cell of half widths (hb, hc) around (b, c) the
curve leaves its linear expansion by at most ``s`` on each day, with the second derivatives' greatest sizes over the range of
``slope * (day - midpoint)`` in the cell. So no curve of the cell comes nearer to the data than the best linear one, its
steps bounded by the cell and its asymptotes by their box, less ``a * |s|``. A second bound does without derivatives: the
curve stays within ``w`` of the central one. Both are proofs, up to rounding.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 2000
#: Part of the sum of squares below which residuals are rounding.
ROUNDING = 1e-9
#: Where the second derivative of the unit curves is greatest by size, to both sides of 0.
_PEAK = {"Logistic": float(np.log(2 + np.sqrt(3))), "Gompertz": float(np.log((3 + np.sqrt(5)) / 2))}


def derivatives(model: str, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unit curve at ``u = slope * (day - midpoint)`` and its first two derivatives."""
    u = np.clip(u, -500, 500)
    if model == "Logistic":
        f = 1 / (1 + np.exp(-u))
        first = f * (1 - f)
        return f, first, first * (1 - 2 * f)
    e = np.exp(-u)
    f = np.exp(-e)
    first = np.where(f > 0, f * e, 0.0)
    return f, first, np.where(f > 0, first * (e - 1), 0.0)


def _greatest(model: str, low: np.ndarray, high: np.ndarray):
    """The curve at both ends of ranges of u, and the greatest first and second derivative (by size) inside."""
    at_low, at_high = derivatives(model, low), derivatives(model, high)
    slope = np.where((low <= 0) & (high >= 0), derivatives(model, np.zeros(1))[1], np.maximum(at_low[1], at_high[1]))
    bend = np.maximum(np.abs(at_low[2]), np.abs(at_high[2]))
    for peak in (-_PEAK[model], _PEAK[model]):
        bend = np.where((low <= peak) & (high >= peak), np.abs(derivatives(model, np.array([peak]))[2]), bend)
    return at_low[0], at_high[0], slope, bend


@dataclass
class Moments:
    """Weighted products of the data ``y``, the directions ``p`` and ``q``, the curve ``f`` and ``1``, for many cells."""

    of: dict[tuple[str, str], np.ndarray]

    def __getitem__(self, pair: tuple[str, str]) -> np.ndarray:
        return self.of[pair] if pair in self.of else self.of[pair[::-1]]

    def without(self, k: str, left: str) -> Moments:
        """Products of the ``left`` vectors with their part along ``k`` taken out."""
        own = self[k, k]
        share = np.where(own > 0, 1 / np.where(own > 0, own, 1), 0)
        return Moments({(i, j): self[i, j] - self[i, k] * self[j, k] * share for n, i in enumerate(left) for j in left[n:]})

    def shifted(self, k: str, by: np.ndarray | float, left: str) -> Moments:
        """Products of the ``left`` vectors with ``by * k`` taken from the data."""
        out = {(i, j): self[i, j] for n, i in enumerate(left) for j in left[n:]}
        out["y", "y"] = self["y", "y"] - 2 * by * self["y", k] + by * by * self[k, k]
        for j in left:
            if j != "y":
                out["y", j] = self["y", j] - by * self[k, j]
        return Moments(out)

    def nearest(self, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least squared distance of y from ``e p + g q`` with both factors within +-``reach``, and the factors."""
        rr, rp, rq, pp, pq, qq = (self[k] for k in (("y", "y"), ("y", "p"), ("y", "q"), ("p", "p"), ("p", "q"), ("q", "q")))
        det = pp * qq - pq * pq
        solid = det > 1e-12 * pp * qq
        e, g = ((x / np.where(solid, det, 1)) for x in (qq * rp - pq * rq, pp * rq - pq * rp))
        inside = solid & (np.abs(e) <= reach) & (np.abs(g) <= reach)
        options = [(np.where(inside, e, 0.0), np.where(inside, g, 0.0), inside)]
        for edge in (-reach, reach):
            options.append((edge, np.clip((rq - edge * pq) / np.where(qq > 0, qq, 1), -reach, reach), True))
            options.append((np.clip((rp - edge * pq) / np.where(pp > 0, pp, 1), -reach, reach), edge, True))
        best = np.full(rr.shape, np.inf), np.zeros_like(rr), np.zeros_like(rr)
        for e, g, valid in options:
            value = rr - 2 * (e * rp + g * rq) + e * e * pp + 2 * e * g * pq + g * g * qq
            better = valid & (value < best[0])
            best = tuple(np.where(better, new, old) for new, old in zip((value, e, g), best))
        return np.maximum(best[0], 0.0), best[1], best[2]


def _nearest_within(m: Moments, k: str, bounds: tuple, reach: np.ndarray) -> np.ndarray:
    """Least squared distance of y from ``a k + e p + g q`` with ``a`` within its bounds.

    The problem is convex: where the best free ``a`` passes a bound, the best ``a`` within them is that bound.
    """
    low, e, g = m.without(k, "ypq").nearest(reach)
    a = (m["y", k] - e * m["p", k] - g * m["q", k]) / np.where(m[k, k] > 0, m[k, k], 1)
    for bad, edge in ((a > bounds[1], bounds[1]), (a < bounds[0], bounds[0])):
        if bad.any():
            low = np.where(bad, m.shifted(k, edge, "ypq").nearest(reach)[0], low)
    return low


def _linear_distance(box, m: Moments, reach: np.ndarray) -> np.ndarray:
    """Least squared distance of the data from the linear expansion, asymptotes in their box."""
    if box.d is None:
        return _nearest_within(m, "f", (box.a[0], reach), reach)
    level = m.without("1", "ypqf")
    low, e, g = level.without("f", "ypq").nearest(reach)
    a = (level["y", "f"] - e * level["p", "f"] - g * level["q", "f"]) / np.where(level["f", "f"] > 0, level["f", "f"], 1)
    d = (m["y", "1"] - e * m["p", "1"] - g * m["q", "1"] - a * m["f", "1"]) / m["1", "1"]
    passed = [a < box.a[0], a > box.a[1], d < box.d[0], d > box.d[1]]
    edges = np.full(low.shape, np.inf)
    for bad, k, other, value, bounds in zip(passed, "ff11", "11ff", (*box.a, *box.d), (box.d, box.d, box.a, box.a)):
        if bad.any():  # one of the bounds that were passed holds
            edge = _nearest_within(m.shifted(k, float(value), "ypq" + other), other, bounds, reach)
            edges = np.where(bad, np.minimum(edges, edge), edges)
    return np.where(np.any(passed, axis=0), edges, low)


def lower_bounds(box, model: str, days: tuple, cells: tuple, best: float, asymptotes) -> tuple[np.ndarray, ...]:
    """For cells (b0, b1, c0, c1): RSS, a and d at the centre, the centre, and what no curve of the cell goes below.

    The bound holds for curves with an RSS of at most ``best``, which is all a search needs to know.
    """
    x, n, sy, syy = days
    b0, b1, c0, c1 = cells
    b, c, hb, hc = (b0 + b1) / 2, (c0 + c1) / 2, ((b1 - b0) / 2)[:, None], ((c1 - c0) / 2)[:, None]
    t, near, far = (x[None, :] - at[:, None] for at in (c, c1, c0))
    f, slope, _ = derivatives(model, b[:, None] * t)
    low = np.where(near >= 0, b0[:, None], b1[:, None]) * near
    high = np.where(far >= 0, b1[:, None], b0[:, None]) * far
    f_low, f_high, steepest, bend = _greatest(model, low, high)
    total, mean = n.sum(), sy / n
    spread, size = max(0.0, float((syy - sy * mean).sum())), float(n @ (mean * mean))
    rss, a, d = asymptotes(box, total, f @ n, (f * f) @ n, sy.sum(), f @ sy, syy.sum())
    rss = np.where(np.isnan(rss), np.inf, rss)
    w = np.sqrt(np.square(np.maximum(f_high - f, f - f_low)) @ n)
    between = max(0.0, size - sy.sum() ** 2 / total)
    if box.d is None:  # a |f| exceeds the data by no more than the residual
        length, data = np.sqrt((f_low * f_low) @ n), np.sqrt(size)
    else:  # the same with the level taken out
        length, data = np.sqrt(np.maximum((f * f) @ n - (f @ n) ** 2 / total, 0)) - w, np.sqrt(between)
    most = np.where(length > 0, (data + np.sqrt(best)) / np.where(length > 0, length, 1), np.inf)
    reach = np.clip(most, box.a[0], box.a[1])
    # a central curve that is 0 on all days has no best asymptote and tells nothing
    plain = np.maximum(np.sqrt(np.maximum(np.where(np.isfinite(rss), rss, spread) - spread, 0)) - reach * w, 0)
    step = np.maximum(np.abs(near), np.abs(far)) * hb + b1[:, None] * hc
    s = np.sqrt(np.square(0.5 * bend * step * step + steepest * hb * hc) @ n)
    vectors = {"p": slope * t * hb, "q": -slope * b[:, None] * hc, "f": f, "1": np.ones_like(f)}
    names = list(vectors)
    of = {(i, j): (vectors[i] * vectors[j]) @ n for k, i in enumerate(names) for j in names[k:]}
    of |= {("y", i): v @ sy for i, v in vectors.items()} | {("y", "y"): np.full(len(b), size)}
    linear = np.maximum(np.sqrt(_linear_distance(box, Moments(of), reach)) - reach * s, 0)
    return rss, a, d, b, c, np.maximum(np.square(np.maximum(plain, linear)) + spread - ROUNDING * size, 0)


def _bounded(box, model, days, cells, best, asymptotes):
    parts = [lower_bounds(box, model, days, tuple(v[i:i + CHUNK] for v in cells), best, asymptotes)
             for i in range(0, len(cells[0]), CHUNK)]
    return tuple(map(np.concatenate, zip(*parts)))


def _cells(edges_b: np.ndarray, edges_c: np.ndarray) -> tuple[np.ndarray, ...]:
    kb, kc = len(edges_b) - 1, len(edges_c) - 1
    return (np.repeat(edges_b[:-1], kc), np.repeat(edges_b[1:], kc), np.tile(edges_c[:-1], kb), np.tile(edges_c[1:], kb))


def prove(box, model: str, days: tuple, best: tuple, tolerance: float, most: int, polish, asymptotes, start: int = 24):
    """Branch and bound over the whole box: the best fit found and a sum of squares that no curve of the box goes below.

    ``best`` is (a, b, c, d, rss, ...) of a first search. Cells that may hold a fit better by more than ``tolerance`` of the
    RSS are quartered; where a centre is better, ``polish(candidate, half_b, half_c)`` improves it before the bounds are read.
    The search ends when no cell is left, or when ``most`` cells have been bounded: then the proven sum lies further
    below.
    """
    size = float(days[3].sum())
    margin = lambda rss: max(tolerance * rss, 2 * ROUNDING * size)
    cells = _cells(np.linspace(*box.b, start + 1), np.linspace(*box.c, start + 1))
    bounded, proven, low = 0, best[4], np.zeros(1)
    while len(cells[0]):
        if bounded + len(cells[0]) > most:
            return best, min(proven, float(low.min()))
        bounded += len(cells[0])
        rss, a, d, b, c, low = _bounded(box, model, days, cells, best[4], asymptotes)
        i = int(np.argmin(rss))
        if rss[i] < best[4] - margin(best[4]):
            best = polish((a[i], b[i], c[i], d[i], rss[i]), cells[1][i] - cells[0][i], cells[3][i] - cells[2][i])
        keep = low < best[4] - margin(best[4])
        proven = min(proven, float(low[~keep].min(initial=np.inf)))
        low, (b0, b1, c0, c1) = low[keep], (v[keep] for v in cells)
        mb, mc = (b0 + b1) / 2, (c0 + c1) / 2
        cells = tuple(map(np.concatenate, ((b0, b0, mb, mb), (mb, mb, b1, b1), (c0, mc, c0, mc), (mc, c1, mc, c1))))
        low = np.tile(low, 4)
    return best, proven


def best_on_lattice(box, model: str, days: tuple, steps: tuple[int, int], tie_digits: int, asymptotes):
    """``a, b, c, d, rss`` of the best of the box's ``steps`` lattice points and the number of points looked at.

    Blocks of points are left out where their bound shows that each is worse than a point already seen; ties go to the
    smallest slope, then midpoint, as in a search of all points.
    """
    (nb, nc), x, n, sy, syy = steps, *days
    slopes = box.b[0] + (box.b[1] - box.b[0]) * np.arange(nb) / (nb - 1)
    middles = box.c[0] + (box.c[1] - box.c[0]) * np.arange(nc) / (nc - 1)
    size, seen, best, found = 16, 0, np.inf, []
    at = np.stack(np.meshgrid(np.arange(0, nb, size), np.arange(0, nc, size), indexing="ij"), -1).reshape(-1, 2)
    while True:
        last = np.minimum(at + size, [nb, nc]) - 1
        middle = (at + last) // 2
        f = derivatives(model, slopes[middle[:, :1]] * (x[None, :] - middles[middle[:, 1:]]))[0]
        rss, a, d = asymptotes(box, n.sum(), f @ n, (f * f) @ n, sy.sum(), f @ sy, syy.sum())
        rss = np.where(np.isnan(rss), np.inf, rss)
        seen += len(at)
        found.append(np.stack([a, slopes[middle[:, 0]], middles[middle[:, 1]], d, rss], axis=1))
        best = min(best, float(rss.min()))
        if size == 1:
            break
        if np.isfinite(best):
            low = _bounded(box, model, days, (slopes[at[:, 0]], slopes[last[:, 0]], middles[at[:, 1]], middles[last[:, 1]]),
                           best + 10.0**-tie_digits, asymptotes)[5]
            at = at[low <= best + 10.0**-tie_digits]
        size //= 2
        at = np.concatenate([at, at + [0, size], at + [size, 0], at + [size, size]])
        at = at[(at < [nb, nc]).all(axis=1)]
    found = np.concatenate(found)
    if not np.isfinite(best):
        return None, seen
    order = np.lexsort((found[:, 2], found[:, 1], np.round(found[:, 4], tie_digits)))
    return tuple(found[order[0]]), seen
