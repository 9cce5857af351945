"""Leading eigenpairs of a symmetric matrix: tridiagonal form, bisection by Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

CLUSTER = 1e-3
_TINY = np.finfo(float).tiny
_EPS = np.finfo(float).eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, subdiagonal and the Householder reflections (first row, unit normal) that lead to them."""
    a = np.array(matrix, float)
    n, mirrors = len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.abs(x).max()
        if np.abs(x[1:]).max() <= _TINY:
            continue
        x /= size
        length = np.sqrt(x @ x)
        x[0] += np.copysign(length, x[0])
        u = x / np.sqrt(x @ x)
        rest = a[k + 1:, k + 1:]
        p = rest @ u
        w = p - (u @ p) * u
        rest -= 2 * np.outer(u, w) + 2 * np.outer(w, u)
        a[k + 1:, k] -= 2 * u * (u @ a[k + 1:, k])
        mirrors.append((k + 1, u))
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_counts(diagonal: np.ndarray, below: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each value of ``at``: negative pivots of T - at."""
    square = np.concatenate([[0.0], below * below])
    floor = _EPS * max(1.0, float(square.max(initial=0))) * _TINY**0.5 + _TINY
    pivot, count = np.ones(len(at)), np.zeros(len(at), np.int64)
    for d, s in zip(diagonal, square):
        pivot = d - at - s / pivot
        pivot = np.where(np.abs(pivot) < floor, -floor, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, below: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` greatest eigenvalues, greatest first, by bisection to the last bit that the matrix determines."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], below])) + np.abs(np.concatenate([below, [0.0]]))
    scale = float((np.abs(diagonal) + reach).max())
    low = np.full(count, (diagonal - reach).min() - _EPS * scale)
    high = np.full(count, (diagonal + reach).max() + _EPS * scale)
    wanted = n - 1 - np.arange(count)  # eigenvalues that lie below the one looked for
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high) & (high - low > _EPS * scale / 8)).any():
            return middle
        under = sturm_counts(diagonal, below, middle) <= wanted
        low, high = np.where(under, middle, low), np.where(under, high, middle)


def _solver(diagonal: np.ndarray, below: np.ndarray, value: float, scale: float):
    """Solves (T - value) x = y by elimination with row exchanges; zero pivots become tiny ones."""
    n = len(diagonal)
    d, up, far = diagonal - value, np.append(below, 0.0), np.zeros(n)
    d, up = d.tolist(), up.tolist()
    far, factor, swapped = far.tolist(), [0.0] * n, [False] * n
    least = _EPS * scale
    for i in range(n - 1):
        if abs(d[i]) >= abs(below[i]):
            if abs(d[i]) < least:
                d[i] = least
            factor[i] = below[i] / d[i]
            d[i + 1] -= factor[i] * up[i]
        else:
            swapped[i], factor[i] = True, d[i] / below[i]
            d[i], over = below[i], up[i]
            up[i], d[i + 1] = d[i + 1], over - factor[i] * d[i + 1]
            far[i], up[i + 1] = up[i + 1], -factor[i] * up[i + 1]
    if abs(d[-1]) < least:
        d[-1] = least

    def solve(y: np.ndarray) -> np.ndarray:
        x = y.tolist()
        for i in range(n - 1):
            if swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor[i] * x[i]
        for i in range(n - 1, -1, -1):
            value = x[i]
            if i + 1 < n:
                value -= up[i] * x[i + 1]
            if i + 2 < n:
                value -= far[i] * x[i + 2]
            x[i] = value / d[i]
        return np.array(x)

    return solve


def inverse_iteration(diagonal: np.ndarray, below: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix for eigenvalues given greatest first.

    Vectors of values closer than ``CLUSTER`` times the matrix's size are made orthogonal to each other in every round.
    """
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], below])) + np.abs(np.concatenate([below, [0.0]]))
    scale = max(float((np.abs(diagonal) + reach).max()), _TINY)
    rng, out, first = np.random.default_rng(7), np.zeros((n, len(values))), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * scale:
            first = k
        close = out[:, first:k]
        solve = _solver(diagonal / scale, below / scale, value / scale, 1.0)
        x = rng.normal(size=n)
        for _ in range(rounds):
            for _ in range(2):  # a second pass removes what rounding left of the first
                x = x - close @ (close.T @ x)
            size = np.sqrt(x @ x)
            x = solve(x / size)
            x /= np.abs(x).max()
        for _ in range(2):
            x = x - close @ (close.T @ x)
        out[:, k] = x / np.sqrt(x @ x)
    return out


def leading_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` greatest eigenvalues, greatest first, and their unit eigenvectors as columns.

    The first of a vector's greatest entries by size is positive.
    """
    n = len(matrix)
    count = min(count, n)
    if not count:
        return np.zeros(0), np.zeros((n, 0))
    diagonal, below, mirrors = tridiagonal(matrix)
    values = leading_values(diagonal, below, count)
    vectors = inverse_iteration(diagonal, below, values)
    for row, u in reversed(mirrors):
        vectors[row:] -= 2 * np.outer(u, u @ vectors[row:])
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[top, np.arange(count)] < 0, -1.0, 1.0)
